"""Commands: infer, ddl, normalize, diff, lineage, test."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tessera.ddl import DDLOptions, compile_ddl
from tessera.diff import diff
from tessera.normalize import normalize
from tessera.quality import generate_tests
from tessera.schema import Schema


def _schema(path: str) -> Schema:
    return Schema.from_json(json.loads(Path(path).read_text()))


def _out(text: str, path: str | None) -> None:
    if path:
        Path(path).write_text(text + "\n")
    else:
        print(text)


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def cmd_infer(a: argparse.Namespace) -> int:
    from tessera.infer import infer
    from tessera.sources import JSONSource, ParquetSource

    spark = _spark()
    source = ParquetSource(a.file) if a.file.endswith(".parquet") else JSONSource(a.file)
    schema = infer(source.dataframe(spark), name=a.name or Path(a.file).stem, sample_size=a.sample_size or None, seed=a.seed, detect_pii=not a.no_pii, pii_locale=a.locale)
    _out(json.dumps(schema.to_json(), indent=2), a.output)
    return 0


def cmd_ddl(a: argparse.Namespace) -> int:
    _out(compile_ddl(_schema(a.schema), a.dialect, DDLOptions(if_not_exists=a.if_not_exists)).to_sql(), a.output)
    return 0


def cmd_normalize(a: argparse.Namespace) -> int:
    _out(compile_ddl(normalize(_schema(a.schema), a.strategy), a.dialect).to_sql(), a.output)
    return 0


def cmd_diff(a: argparse.Namespace) -> int:
    found = diff(_schema(a.old), _schema(a.new))
    lines = [f"[{c.severity.upper()}] {c.description}" for c in found.changes if a.safe or c.severity != "safe"]
    _out("\n".join(lines) if lines else "no changes", a.output)
    return int(found.has_breaking_changes)


def cmd_lineage(a: argparse.Namespace) -> int:
    graph = normalize(_schema(a.schema), a.strategy).lineage
    _out(graph.to_dot() if a.format == "dot" else json.dumps(graph.to_openlineage(), indent=2), a.output)
    return 0


def cmd_test(a: argparse.Namespace) -> int:
    tests = generate_tests(_schema(a.schema), a.sensitivity)
    _out(json.dumps([{"name": t.name, "path": str(t.path), "kind": t.kind, "severity": t.severity, "description": t.description, "sql": t.sql_template, "metadata": t.metadata} for t in tests], indent=2, default=str), a.output)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tessera", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(command_name: str, run, /, *positional: str, **options: dict) -> None:
        p = commands.add_parser(command_name, help=run.__name__[4:])
        for x in positional:
            p.add_argument(x)
        for x, how in options.items():
            p.add_argument("--" + x.replace("_", "-"), **how)
        p.add_argument("--output", "-o")
        p.set_defaults(run=run)

    dialect, flag, strategy = {"default": "duckdb"}, {"action": "store_true"}, {"default": "1nf"}
    command("infer", cmd_infer, "file", name={}, sample_size={"type": int, "default": 2000}, seed={"type": int}, no_pii=flag, locale={"default": "in"}, dialect=dialect)
    command("ddl", cmd_ddl, "schema", dialect=dialect, if_not_exists=flag)
    command("normalize", cmd_normalize, "schema", strategy=strategy, dialect=dialect)
    command("diff", cmd_diff, "old", "new", safe={"action": argparse.BooleanOptionalAction, "default": True})
    command("lineage", cmd_lineage, "schema", format={"choices": ["dot", "openlineage"], "default": "dot"}, strategy=strategy)
    command("test", cmd_test, "schema", sensitivity={"type": float, "default": 1.0})
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
