"""Arrow types as text, as stored schemas have them: ``list<struct<sku:string,price:decimal128(38,18)>>``."""

from __future__ import annotations

import re

import pyarrow as pa

from tessera.types.core import fields_of, is_list

# The names of types in stored schemas.
_PLAIN = {
    "null": pa.null(), "bool": pa.bool_(),
    "int8": pa.int8(), "int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(),
    "uint8": pa.uint8(), "uint16": pa.uint16(), "uint32": pa.uint32(), "uint64": pa.uint64(),
    "float16": pa.float16(), "float32": pa.float32(), "float64": pa.float64(),
    "string": pa.string(), "large_string": pa.large_string(), "binary": pa.binary(), "large_binary": pa.large_binary(),
    "date32": pa.date32(), "date64": pa.date64(),
}
#: Arrow's own spellings, which also occur in the names of unions.
_SPELLINGS = {"double": "float64", "float": "float32", "halffloat": "float16", "date32[day]": "date32", "date64[ms]": "date64"}
_NAMES = {t: name for name, t in _PLAIN.items()}


def encode(t: pa.DataType) -> str:
    if t in _NAMES:
        return _NAMES[t]
    if is_list(t):
        return f"list<{encode(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{encode(f.type)}" for f in fields_of(t)) + ">"
    if pa.types.is_map(t):
        return f"map<{encode(t.key_type)},{encode(t.item_type)}>"
    if pa.types.is_timestamp(t):
        return f"timestamp[{t.unit},{t.tz}]" if t.tz else f"timestamp[{t.unit}]"
    if pa.types.is_duration(t):
        return f"duration[{t.unit}]"
    if pa.types.is_time(t):
        return f"time{t.bit_width}[{t.unit}]"
    if pa.types.is_decimal(t):
        return f"decimal128({t.precision},{t.scale})"
    return str(t)


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that aren't inside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([":
            depth += 1
        elif c in ">)]":
            depth -= 1
        elif c == mark and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]] if text else []


def decode(text: str) -> pa.DataType:
    """The type; text that isn't known is a string, as in stored schemas of newer versions."""
    text = _SPELLINGS.get(text.strip(), text.strip())
    if text in _PLAIN:
        return _PLAIN[text]
    if m := re.fullmatch(r"(list|struct|map)<(.*)>", text, re.DOTALL):
        inner = split_top(m[2])
        if m[1] == "list":
            return pa.list_(decode(m[2]))
        if m[1] == "map" and len(inner) == 2:
            return pa.map_(decode(inner[0]), decode(inner[1]))
        if m[1] == "struct":
            named = [part.partition(":") for part in inner]
            return pa.struct([pa.field(name.strip(), decode(kind)) for name, _, kind in named])
    if m := re.fullmatch(r"timestamp\[(s|ms|us|ns)(?:,\s*(?:tz=)?(.+))?\]", text):
        return pa.timestamp(m[1], m[2])
    if m := re.fullmatch(r"duration\[(s|ms|us|ns)\]", text):
        return pa.duration(m[1])
    if m := re.fullmatch(r"time(32|64)\[(s|ms|us|ns)\]", text):
        return pa.time32(m[2]) if m[1] == "32" else pa.time64(m[2])
    if m := re.fullmatch(r"decimal(?:128)?\((\d+),\s*(-?\d+)\)", text):
        return pa.decimal128(int(m[1]), int(m[2]))
    return pa.string()
