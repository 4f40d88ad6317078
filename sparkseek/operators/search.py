"""Searches over a DataFrame: filter, projection, order, limit and BM25 score."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.compiler import Compiled, CompileError, compile_query
from ..plans.schema import Schema

K1, B = 1.2, 0.75


def matching(df: DataFrame, schema: Schema, query: str) -> DataFrame:
    return df.where(compile_query(query, schema).predicate)


def searched(schema: Schema, query: str) -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform``."""
    return lambda df: matching(df, schema, query)


def bm25(df: DataFrame, schema: Schema, compiled: Compiled) -> DataFrame:
    """``df`` with a ``score`` column over the whole table's statistics; 0 where the
    query has nothing to rank.  The statistics are one row."""
    if not compiled.ranked:
        return df.withColumn("score", F.lit(0.0))
    columns = list(dict.fromkeys((f.column, f.filters) for f, _, _ in compiled.ranked))
    names = {key: f"__tokens{i}" for i, key in enumerate(columns)}
    rows = df
    for (column, filters), name in names.items():
        wanted = [t for f, t, _ in compiled.ranked if (f.column, f.filters) == (column, filters)]
        rows = rows.withColumn(name, F.coalesce(text.Analyzer(filters).column(F.expr(column), wanted), F.array().cast("array<string>")))
    aggregates = [F.count("*").cast("double").alias("__n")]
    aggregates += [F.avg(F.size(n)).alias(f"{n}_avg") for n in names.values()]
    aggregates += [F.count_if(text.has_token(F.col(names[f.column, f.filters]), t)).cast("double").alias(f"__df{i}") for i, (f, t, _) in enumerate(compiled.ranked)]
    rows = rows.crossJoin(F.broadcast(rows.agg(*aggregates)))  # one row of statistics
    score: Column = F.lit(0.0)
    for i, (f, token, boost) in enumerate(compiled.ranked):
        name = names[f.column, f.filters]
        tf = text.term_frequency(F.col(name), token).cast("double")
        idf = F.log(1 + (F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        score = score + boost * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(name) / F.col(f"{name}_avg")))
    return rows.withColumn("score", score).select(*[F.col(f"`{c}`") for c in df.columns], "score")


def search(df: DataFrame, schema: Schema, query: str, limit: int | None = 100, score: bool = False) -> DataFrame:
    """The display fields of matching rows, best or newest first."""
    compiled = compile_query(query, schema)
    rows = bm25(df, schema, compiled) if score else df
    rows = rows.where(compiled.predicate)
    time = schema.declared(schema.time) if schema.time else None
    order = ([F.desc("score")] if score else []) + ([F.expr(time.column).desc()] if time else [])
    if schema.row_key in df.columns:
        order.append(F.col(schema.row_key))
    if order:
        rows = rows.orderBy(*order)
    if limit is not None:
        rows = rows.limit(limit)
    shown = [F.expr(f.column).alias(f.name) for f in schema.display_fields()]
    return rows.select(*shown, *(["score"] if score else []))


_MACRO = re.compile(r"\$__search(?P<kind>_score_expr|_score)?\(")


def _argument(sql: str, at: int) -> tuple[str, int]:
    """The text of a macro's argument from ``at`` on and the place after its bracket.

    In quotes, a doubled quote is one; bare, commas and balanced brackets belong to
    the text.
    """
    if m := re.compile(r"\s*'((?:[^']|'')*)'\s*\)").match(sql, at):
        return m[1].replace("''", "'"), m.end()
    depth, end = 0, at
    while end < len(sql) and (depth or sql[end] != ")"):
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    if end == len(sql):
        raise CompileError("a search macro has no closing bracket")
    return sql[at:end].strip(), end + 1


def expand(spark: SparkSession, sql: str, schema: Schema, df: DataFrame, view: str = "searched") -> DataFrame:
    """SQL over ``df``, called ``view`` in it, with search macros.

    ``$__search(text)`` and ``$__search_score(text)`` stand for the predicate, and
    ``$__search_score_expr(text)`` for the BM25 score, which is 0 where nothing is
    ranked.  No view is left behind.
    """
    parts, at, columns = [], 0, {}
    for m in _MACRO.finditer(sql):
        if m.start() < at:
            continue  # inside the last macro's text
        text, end = _argument(sql, m.end())
        key = ("score" if m["kind"] == "_score_expr" else "search", text)
        name = columns.setdefault(key, f"__{key[0]}_{len(columns)}")
        parts += [sql[at : m.start()], name]
        at = end
    plain = "".join([*parts, sql[at:]])
    for (kind, text), name in columns.items():
        compiled = compile_query(text, schema)
        if kind == "search":
            df = df.withColumn(name, compiled.predicate)
        else:
            own = df.columns
            df = bm25(df.withColumnsRenamed({"score": "__own_score"}), schema, compiled).withColumnRenamed("score", name)
            df = df.withColumnsRenamed({"__own_score": "score"}) if "score" in own else df
    plain = re.sub(rf"(?i)(\b(?:from|join)\s+){re.escape(view)}\b", r"\1{__searched}", plain.replace("{", "{{").replace("}", "}}").replace("{{__searched}}", "{__searched}"))
    return spark.sql(plain, __searched=df)


#: (needs a baseline, needs a witness, test of actual, baseline and witness).  What a
#: count is compared with has to have rows, or the test would say nothing.
COMPARES: dict[str, tuple[bool, bool, Callable[[int, int, int], bool]]] = {
    "executes": (False, False, lambda n, b, w: n >= 0),
    "zero": (False, False, lambda n, b, w: n == 0),
    "nonzero": (False, False, lambda n, b, w: n > 0),
    "eq": (True, False, lambda n, b, w: b > 0 and n == b),
    "ne": (True, False, lambda n, b, w: b > 0 and n != b),
    "le": (True, False, lambda n, b, w: b > 0 and n <= b),
    "lt": (True, False, lambda n, b, w: b > 0 and n < b),
    "ge": (True, False, lambda n, b, w: b > 0 and n >= b),
    "gt": (True, False, lambda n, b, w: b > 0 and n > b),
    "narrows": (True, False, lambda n, b, w: b > 0 and 0 < n <= b),
    "shrinks": (True, False, lambda n, b, w: b > 0 and 0 < n < b),
    "partitions": (True, True, lambda n, b, w: n > 0 and w > 0 and n + w == b),
}


def conform(spark: SparkSession, df: DataFrame, schema: Schema, cases: list[dict]) -> DataFrame:
    """Row-count conformance in one pass: (case_name, actual, baseline, witness, result).

    A case names a query, a compare and what that needs; one that lacks it, or an
    unknown compare, is refused with CompileError.
    """
    for case in cases:
        needs = COMPARES.get(case["compare"])
        if needs is None:
            raise CompileError(f"{case['name']}: unknown compare {case['compare']}")
        for part, needed in zip(("baseline", "witness"), needs, strict=False):
            if needed and case.get(part) is None:
                raise CompileError(f"{case['name']}: {case['compare']} needs a {part}")
    counts, at = [F.count("*").alias("total")], {}
    for case in cases:
        for part in ("query", "baseline", "witness"):
            if (q := case.get(part)) is not None and q not in at:
                at[q] = f"n{len(at)}"
                counts.append(F.count_if(compile_query(q, schema).predicate).alias(at[q]))
    row = df.agg(*counts).first()
    out = []
    for case in cases:
        n, b, w = (row[at[case[p]]] if case.get(p) is not None else None for p in ("query", "baseline", "witness"))
        passed = COMPARES[case["compare"]][2](n, b, w)
        out.append((case["name"], n, b, w, "PASS" if passed else "FAIL"))
    return spark.createDataFrame(out, "case_name string, actual bigint, baseline bigint, witness bigint, result string")
