from tessera.functions.expression import Expression, col, lit, star
from tessera.functions.library import avg_, call, coalesce, concat, count_, count_distinct_, date_trunc, if_, length, max_, min_, sum_, to_date

__all__ = ["Expression", "avg_", "call", "coalesce", "col", "concat", "count_", "count_distinct_", "date_trunc", "if_", "length", "lit", "max_", "min_", "star", "sum_", "to_date"]
