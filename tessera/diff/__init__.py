from tessera.diff.compare import SchemaChange, SchemaDiff, diff

__all__ = ["SchemaChange", "SchemaDiff", "diff"]
