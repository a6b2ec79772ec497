from tessera.operators.table import GroupedTable, Table, WindowTable

__all__ = ["GroupedTable", "Table", "WindowTable"]
