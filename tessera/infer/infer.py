"""Schemas from documents.

Observing is distributed: documents become (path, kind, value) counts, combined in each batch and then by Spark; only a row per path and kind
reaches the driver, which joins the kinds of each path in a way that no order can change.
"""

from __future__ import annotations

import math
import warnings
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EmptySourceError
from tessera.infer.observe import LIST, MAX_DEPTH, NULL, OBSERVATION, SKIPPED, STRUCT, observe, observe_json
from tessera.pii.detect import count_values, detect_pii, matched
from tessera.pii.patterns import shapes
from tessera.schema import Schema
from tessera.types import FieldType, decode, from_spark
from tessera.types.lattice import MAX_UNION_MEMBERS, join_all
from tessera.types.semantic import ENUM

#: A string column with fewer values than this, seen more often than that, is an enum.
ENUM_VALUES, ENUM_SAMPLES = 50, 200

_NUMBERS = ("int64", "float64", "decimal128(38,18)")


def confidence(n: int, null_ratio: float) -> float:
    """How far n observations can be trusted, from 0 to 1."""
    return min(1.0, (1 - math.exp(-n / 50)) * (1 - 0.5 * null_ratio)) if n else 0.0


@dataclass
class Kind:
    n: int = 0
    first: int = 1 << 62
    values: int = 0
    low: float | None = None
    high: float | None = None
    shapes: dict[str, int] = field(default_factory=dict)


def summarize(observations: DataFrame, locale: str) -> dict[str, dict[str, Kind]]:
    """path -> kind -> Kind, in one aggregate."""
    known = shapes(locale)
    number = F.when(F.col("kind").isin(*_NUMBERS), F.col("value").try_cast("double"))
    top = F.col("kind").eqNullSafe("string") & ~F.col("path").rlike(r"[.\[]")
    aggs = [F.sum("n").alias("n"), F.min("first").alias("first"), F.approx_count_distinct("value", 0.01).alias("values"), F.min(number).alias("low"), F.max(number).alias("high")]
    aggs += [F.sum(F.when(top, matched(F.col("value"), s) * F.col("n"))).alias(f"_{s.label}") for s in known]
    out: dict[str, dict[str, Kind]] = defaultdict(dict)
    for r in observations.groupBy("path", "kind").agg(*aggs).collect():  # a row per path and kind
        out[r.path][r.kind] = Kind(r.n, r["first"], r["values"], r.low, r.high, {s.label: r[f"_{s.label}"] or 0 for s in known})
    return dict(out)


def summarize_local(seen: dict, locale: str) -> dict[str, dict[str, Kind]]:
    """The same from observations in hand."""
    known = shapes(locale)
    out: dict[str, dict[str, Kind]] = defaultdict(lambda: defaultdict(Kind))
    for (path, kind, value), (n, first) in seen.items():
        k = out[path][kind]
        k.n, k.first, k.values = k.n + n, min(k.first, first), k.values + (value is not None)
        if kind in _NUMBERS:
            k.low, k.high = (f(x for x in (old, float(value)) if x is not None) for f, old in ((min, k.low), (max, k.high)))
        elif kind == "string" and "." not in path and "[" not in path:
            for label, hit in count_values([value], known)[1].items():
                k.shapes[label] = k.shapes.get(label, 0) + hit * n
    return {p: dict(kinds) for p, kinds in out.items()}


def told(seen: dict[str, dict[str, Kind]], name: str) -> dict[str, dict[str, Kind]]:
    """What was seen, without the count of documents that were left out, of which it warns."""
    left_out = seen.get("", {}).get(SKIPPED)
    if left_out is None:
        return seen
    warnings.warn(f"{name}: {left_out.n} documents are no objects, or nested more than {MAX_DEPTH} deep, and were left out", stacklevel=3)
    rest = {kind: k for kind, k in seen[""].items() if kind != SKIPPED}
    return {p: kinds for p, kinds in {**seen, "": rest}.items() if kinds}


def _first(kinds: dict[str, Kind]) -> int:
    return min(k.first for k in kinds.values())


def build(name: str, seen: dict[str, dict[str, Kind]], max_union_members: int = MAX_UNION_MEMBERS, order: str = "document") -> Schema:
    """The schema for the kinds seen at each path.

    A path that had a list is a list, else one that had an object is a struct, else its type is that of its scalars joined.  Null ratios are over what was
    observed at a path, explicit nulls among it; an absent key isn't observed.
    """
    children: dict[str, list[str]] = defaultdict(list)
    for path in seen:
        if not path.endswith("[]"):
            children[path.rpartition(".")[0] if "." in path else ""].append(path)

    def key(path: str):
        nested = STRUCT in seen[path] or LIST in seen[path]
        return (order == "depth" and nested, _first(seen[path]))

    def type_of(path: str) -> tuple[pa.DataType, str | None]:
        kinds = seen.get(path, {})
        if LIST in kinds:
            return pa.list_(type_of(path + "[]")[0]), None
        if STRUCT in kinds:
            return pa.struct([pa.field(p[len(path) + 1 :], type_of(p)[0]) for p in sorted(children[path], key=key)]), None
        return join_all([decode(k) for k in kinds if k not in (NULL, "empty")], max_union_members)

    def describe(path: str) -> FieldType:
        kinds = seen[path]
        arrow, semantic = type_of(path)
        n = sum(k.n for k in kinds.values())
        ratio = kinds[NULL].n / n if NULL in kinds else 0.0
        scalar = [k for kind, k in kinds.items() if kind not in (NULL, STRUCT, LIST)]
        cardinality = sum(k.values for k in scalar) if scalar else None
        if semantic is None and pa.types.is_string(arrow) and cardinality is not None and cardinality < ENUM_VALUES and n > ENUM_SAMPLES:
            semantic = ENUM
        whole = int if pa.types.is_integer(arrow) else float
        lows, highs = [k.low for k in scalar if k.low is not None], [k.high for k in scalar if k.high is not None]
        bounds = {"min_value": whole(min(lows)), "max_value": whole(max(highs))} if lows and (pa.types.is_integer(arrow) or pa.types.is_floating(arrow)) and all(map(math.isfinite, (*lows, *highs))) else {}
        return FieldType(arrow, null_ratio=ratio, cardinality_estimate=cardinality, sample_count=n, confidence=confidence(n, ratio), semantic=semantic, source_path=path, **bounds)

    return Schema(name, tuple((p, describe(p)) for p in sorted(children[""], key=key)))


def sample(texts: DataFrame, size: int | None, seed: int | None) -> DataFrame:
    """At most `size` rows of (number, value): those of least hash of their number, so a uniform sample that a seed repeats on the same files; all of a smaller table.

    Of n hashes, which are uniform, a few more than `size` lie below a bound that n tells (fewer: a chance of 1e-9); all others stay in their tasks.
    """
    if size is None:
        return texts
    order, n = F.xxhash64(F.lit(seed or 0), "number"), texts.count()
    share = (size + 6 * math.sqrt(size) + 20) / max(n, 1)
    near = texts if share >= 1 else texts.where(order < int((share - 0.5) * (1 << 64)))
    return near.orderBy(order, "number").limit(size)


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{df.columns[0]}`").cast("string").alias("value"))


def infer(documents: Any, name: str = "inferred", sample_size: int | None = 2000, seed: int | None = None, detect_pii: bool = True, pii_locale: str = "in", max_union_members: int = MAX_UNION_MEMBERS, fail_on_empty: bool = True, order: str = "document") -> Schema:
    """The schema of documents: an iterable of dicts, a source, a DataFrame of JSON text (one string column), or a typed DataFrame.

    sample_size: how many documents are looked at; None: all.  order: fields by first sight ("document"), or scalars before structs and lists ("depth").
    """
    if hasattr(documents, "dataframe"):
        documents = documents.dataframe(SparkSession.active())
    if isinstance(documents, DataFrame):
        if documents.dtypes == [(documents.columns[0], "string")]:
            rows = sample(_texts(documents).where("value is not null"), sample_size, seed)
            seen = summarize(rows.mapInPandas(observe_json, OBSERVATION), pii_locale)
        else:
            return infer_typed(documents, name, detect_pii, pii_locale, fail_on_empty)
    else:
        held = list(_reservoir(documents, sample_size, seed))
        seen = summarize_local(observe(enumerate(held)), pii_locale)
    seen = told(seen, name)
    if not seen:
        if fail_on_empty:
            raise EmptySourceError(f"{name}: no documents")
        return Schema(name)
    schema = build(name, seen, max_union_members, order)
    if not detect_pii:
        return schema
    counts = {n: (seen[n]["string"].n, seen[n]["string"].shapes) for n in schema.field_names if "string" in seen[n]}
    return _detect(schema, counts, pii_locale)


def _detect(schema: Schema, counts, locale: str) -> Schema:
    return detect_pii(schema, locale=locale, counts=counts)


def _reservoir(documents: Iterable[dict], size: int | None, seed: int | None) -> list[dict]:
    """A uniform sample in one pass: each document gets a random key, the `size` smallest stay, in input order."""
    import heapq
    import random

    if size is None:
        return list(documents)
    rng = random.Random(seed)
    kept: list[tuple[float, int, dict]] = []
    for i, doc in enumerate(documents):
        item = (-rng.random(), -i, doc)
        if len(kept) < size:
            heapq.heappush(kept, item)
        elif item[:2] > kept[0][:2]:
            heapq.heapreplace(kept, item)
    return [doc for _, _, doc in sorted(kept, key=lambda x: -x[1])]


def infer_typed(df: DataFrame, name: str, pii: bool = True, locale: str = "in", fail_on_empty: bool = True) -> Schema:
    """The schema of typed columns with their statistics: one aggregate over the whole table."""
    known = shapes(locale) if pii else []
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"{i}|full"))
        if isinstance(f.dataType, T.ArrayType):
            aggs.append(F.max(F.size(c)).alias(f"{i}|values"))
        elif not isinstance(f.dataType, (T.StructType, T.MapType)):
            aggs.append(F.approx_count_distinct(c, 0.01).alias(f"{i}|values"))
        if isinstance(f.dataType, T.NumericType):
            aggs += [F.min(c).alias(f"{i}|low"), F.max(c).alias(f"{i}|high")]
        if isinstance(f.dataType, T.StringType):
            aggs += [F.sum(matched(c, s)).alias(f"{i}|{s.label}") for s in known]
    row = df.agg(*aggs).first().asDict()
    n = row["n"]
    if not n and fail_on_empty:
        raise EmptySourceError(f"{name}: no rows")
    fields, counts = [], {}
    for i, f in enumerate(df.schema.fields):
        full, values = row[f"{i}|full"], row.get(f"{i}|values")
        ratio = 1 - full / n if n else 0.0
        text = isinstance(f.dataType, T.StringType)
        semantic = ENUM if text and values is not None and values < ENUM_VALUES and n > ENUM_SAMPLES else None
        fields.append((f.name, FieldType(from_spark(f.dataType), null_ratio=ratio, cardinality_estimate=values, sample_count=n, confidence=confidence(n, ratio), semantic=semantic, source_path=f.name, min_value=row.get(f"{i}|low"), max_value=row.get(f"{i}|high"))))
        if text and known:
            counts[f.name] = (full, {s.label: row[f"{i}|{s.label}"] or 0 for s in known})
    schema = Schema(name, tuple(fields))
    return _detect(schema, counts, locale) if pii else schema
