from tessera.types.codec import decode, encode
from tessera.types.core import FieldType
from tessera.types.interop import from_arrow_field, from_spark, to_arrow_field, to_spark
from tessera.types.lattice import join, join_all, meet, resolve_union, subsumes
from tessera.types.semantic import ALL_SEMANTICS

__all__ = ["ALL_SEMANTICS", "FieldType", "decode", "encode", "from_arrow_field", "from_spark", "join", "join_all", "meet", "resolve_union", "subsumes", "to_arrow_field", "to_spark"]
