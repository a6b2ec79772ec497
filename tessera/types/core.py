"""The descriptor of a column's type: an Arrow type and what is known about its values."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa


@dataclass(frozen=True)
class FieldType:
    arrow_type: pa.DataType
    null_ratio: float = 0.0
    cardinality_estimate: int | None = None
    sample_count: int = 0
    confidence: float = 1.0
    semantic: str | None = None
    pii_class: str | None = None
    source_path: str | None = None
    min_value: Any = None
    max_value: Any = None
    description: str | None = None
    tags: tuple[str, ...] = ()

    def evolve(self, **changes: Any) -> FieldType:
        return replace(self, **changes)

    @property
    def is_nullable(self) -> bool:
        return self.null_ratio > 0

    @property
    def is_list(self) -> bool:
        return is_list(self.arrow_type)

    @property
    def is_struct(self) -> bool:
        return pa.types.is_struct(self.arrow_type)

    @property
    def is_null(self) -> bool:
        return pa.types.is_null(self.arrow_type)

    @property
    def is_union(self) -> bool:
        return bool(self.semantic) and self.semantic.startswith("union:")


def is_list(t: pa.DataType) -> bool:
    return pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t)


def fields_of(t: pa.StructType) -> list[pa.Field]:
    return [t.field(i) for i in range(t.num_fields)]
