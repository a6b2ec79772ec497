from tessera.schema.path import Path, PathSegment
from tessera.schema.schema import Schema, type_from_json, type_to_json

__all__ = ["Path", "PathSegment", "Schema", "type_from_json", "type_to_json"]
