"""Places in nested schemas: ``customer.address.city``, ``items[].sku``, ``matrix[][]``."""

from __future__ import annotations

import re
from dataclasses import dataclass

ELEMENT = "[]"


@dataclass(frozen=True)
class PathSegment:
    """A field's name, or the elements of an array."""

    kind: str
    name: str = ""

    def __post_init__(self) -> None:
        if self.kind not in ("field", "array_element"):
            raise ValueError(f"a segment is a field or an array_element, not {self.kind!r}")

    def __str__(self) -> str:
        return ELEMENT if self.kind == "array_element" else self.name


@dataclass(frozen=True)
class Path:
    segments: tuple[PathSegment, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Path:
        """From the text that str() gives; empty text is the root."""
        found = []
        for part in text.split(".") if text else []:
            name, marks = re.fullmatch(r"(.*?)((?:\[\])*)", part, re.DOTALL).groups()
            if name:
                found.append(PathSegment("field", name))
            found += [PathSegment("array_element")] * (len(marks) // 2)
        return cls(tuple(found))

    @classmethod
    def root(cls) -> Path:
        return cls()

    def append(self, name: str) -> Path:
        return Path((*self.segments, PathSegment("field", name)))

    __truediv__ = append

    def array_element(self) -> Path:
        return Path((*self.segments, PathSegment("array_element")))

    def is_descendant_of(self, other: Path) -> bool:
        n = len(other.segments)
        return len(self.segments) > n and self.segments[:n] == other.segments

    def is_root(self) -> bool:
        return not self.segments

    @property
    def parent(self) -> Path:
        return Path(self.segments[:-1])

    @property
    def depth(self) -> int:
        return len(self.segments)

    def __str__(self) -> str:
        out = ""
        for s in self.segments:
            out += str(s) if s.kind == "array_element" or not out else f".{s}"
        return out


Path.ROOT = Path()
