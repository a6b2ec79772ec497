from tessera.ddl.dialects import DIALECTS, DDLOptions, get_dialect
from tessera.ddl.script import DDLScript, compile_ddl, compile_migration

__all__ = ["DIALECTS", "DDLOptions", "DDLScript", "compile_ddl", "compile_migration", "get_dialect"]
