from tessera.pii.detect import count_columns, detect_pii
from tessera.pii.names import class_of_name
from tessera.pii.patterns import shapes

detect_pii_from_field_name = class_of_name

__all__ = ["class_of_name", "count_columns", "detect_pii", "detect_pii_from_field_name", "shapes"]
