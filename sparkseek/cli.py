"""The command line: compile, sql, conform, schema and introspect.

    python -m sparkseek.cli VERB [--option=value ...] [search text]

Options stand before the search text, which may begin with a hyphen.  A schema is a
preset's name or a descriptor file; a table is a Parquet path.
"""

from __future__ import annotations

import dataclasses
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import introspect
from .operators.search import conform, search
from .plans.compiler import CompileError, compile_query, warning_comment
from .plans.schema import Schema, SchemaError, load, preset, preset_names

VERBS = ("compile", "sql", "conform", "schema", "introspect")


def _options(args: list[str]) -> tuple[dict[str, str], list[str]]:
    options: dict[str, str] = {}
    while args and args[0].startswith("--"):
        head, *args = args
        if head == "--":
            break
        name, _, value = head[2:].partition("=")
        options[name] = value or "yes"
    return options, args


def schema_of(options: dict[str, str]) -> Schema:
    name = options.get("schema") or os.environ.get("SEARCH_SCHEMA") or preset_names()[0]
    if name in preset_names():
        return preset(name)
    with open(name, encoding="utf-8") as file:
        return load(file.read())


def _table(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    if "table" not in options:
        raise CompileError("give --table=PATH")
    return spark.read.parquet(options["table"])


def _shown(df: DataFrame) -> list[str]:
    return [json.dumps(r.asDict(), default=str, ensure_ascii=False) for r in df.toLocalIterator()]


def run(verb: str, args: list[str], spark: SparkSession) -> tuple[list[str], list[str], int]:
    """(lines of output, lines of remarks, exit code)."""
    options, rest = _options(args)
    text = " ".join(rest)
    if verb == "introspect":
        return _introspect(options, rest, spark)
    schema = schema_of(options)
    if verb == "schema":
        return [json.dumps(dataclasses.asdict(schema), indent=1) if "json" in options else schema.describe()], [], 0
    if verb == "conform":
        with open(text, encoding="utf-8") as file:
            spec = json.load(file)
        rows = conform(spark, _table(spark, options), schema, spec["cases"] if isinstance(spec, dict) else spec).collect()
        failed = sum(r["result"] == "FAIL" for r in rows)
        return [f"{r['result']} {r['case_name']}: {r['actual']}, {r['baseline']}, {r['witness']}" for r in rows], [f"{len(rows) - failed} of {len(rows)} passed"], int(failed > 0)
    compiled = compile_query(text, schema)
    remarks = [] if "quiet" in options else compiled.warnings
    if verb == "compile":
        out = str([(f.name, token, boost) for f, token, boost in compiled.ranked]) if "score-expr" in options else str(compiled.predicate)[8:-2]
        return [out], remarks, 0
    rows = search(_table(spark, options), schema, text, int(options.get("limit", 100)), "score" in options)
    comment = warning_comment(compiled.warnings)
    return ([comment] if comment else []) + _shown(rows), remarks, 0


def _introspect(options: dict[str, str], rest: list[str], spark: SparkSession) -> tuple[list[str], list[str], int]:
    step = rest[0] if rest else ""
    df = _table(spark, options)
    if step == "probe":
        return [f"{f.name} {introspect.kind_of(f.dataType)}" for f in df.schema] + [f"digest {introspect.digest(df)}"], [], 0
    if step == "profile":
        return _shown(introspect.profile(df)), [], 0
    if step == "build":
        spec = introspect.build(df, options.get("name", ""), tuple(x for x in options.get("bags", "").split(",") if x), options.get("body", ""), options.get("time", ""), "aliases" in options)
        try:
            notes = list(load(spec).notes)
        except SchemaError as error:
            return [json.dumps(spec, indent=1)], [str(error)], 1
        return [json.dumps(spec, indent=1)], notes, 0
    if step == "verify":
        rows = introspect.drift(df, schema_of(options), options.get("digest", "")).collect()
        return [f"{r['level']}: {r['subject']}: {r['finding']}" for r in rows], [], int(any(r["level"] == "drift" for r in rows))
    raise CompileError("introspect takes probe, profile, build or verify")


def main(args: list[str]) -> int:
    if not args or args[0] not in VERBS:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out, remarks, code = run(args[0], args[1:], spark)
    except (CompileError, SchemaError, OSError) as error:
        out, remarks, code = [], [str(error)], 1
    print(*out, sep="\n") if out else None
    print(*remarks, sep="\n", file=sys.stderr) if remarks else None
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
