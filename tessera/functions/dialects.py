"""What differs between the SQL dialects that queries are written in."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str
    quote: str = '"'
    #: How `*` without some columns is written; None: not at all.
    star_except: str | None = "EXCEPT"
    concat_skips_null: bool = True
    has_ilike: bool = True
    contains: str = "CONTAINS({0}, {1})"
    date_trunc: str = "DATE_TRUNC({unit}, {0})"
    #: x / 0 is infinite or NaN by itself.
    divides_by_zero: bool = False
    float_type: str = "DOUBLE PRECISION"
    text_type: str = "VARCHAR"

    def ident(self, name: str) -> str:
        return self.quote + name.replace(self.quote, self.quote * 2) + self.quote


DIALECTS = {
    d.name: d
    for d in (
        Dialect("duckdb", star_except="EXCLUDE", divides_by_zero=True, float_type="DOUBLE"),
        Dialect("postgres", star_except=None, contains="(POSITION({1} IN {0}) > 0)"),
        Dialect("redshift", star_except="EXCLUDE", concat_skips_null=False, contains="(POSITION({1} IN {0}) > 0)"),
        Dialect("bigquery", quote="`", concat_skips_null=False, has_ilike=False, contains="(STRPOS({0}, {1}) > 0)", date_trunc="TIMESTAMP_TRUNC({0}, {bare})", float_type="FLOAT64", text_type="STRING"),
        Dialect("snowflake", star_except="EXCLUDE", concat_skips_null=False, float_type="DOUBLE"),
        Dialect("databricks", quote="`", concat_skips_null=False, float_type="DOUBLE", text_type="STRING"),
    )
}
DIALECTS["postgresql"] = DIALECTS["postgres"]


def get_dialect(name: str) -> Dialect:
    try:
        return DIALECTS[name.lower()]
    except KeyError:
        raise ValueError(f"no dialect {name!r}; there are {', '.join(sorted(DIALECTS))}") from None
