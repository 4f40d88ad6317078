"""The dashboard workload: counts, histograms, patterns, facets and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import CompileError, compile_query
from ..plans.schema import Schema


def role(schema: Schema, name: str) -> Column:
    """The column of a role; a panel without its role is refused with a reason."""
    if not getattr(schema, name):
        raise CompileError(f"this panel needs the role {name}")
    return F.expr(schema.declared(getattr(schema, name)).column)


def within(df: DataFrame, schema: Schema, start: str, end: str) -> DataFrame:
    ts = role(schema, "time")
    return df.where((ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp")))


def fingerprint(text: Column) -> Column:
    """A line's pattern: long hex runs, then digits, masked."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9a-f]{8,}", "?"), "[0-9]+", "?")


def facet(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return df.groupBy(F.expr(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def facet_last_seen(df: DataFrame, schema: Schema, column: str) -> DataFrame:
    return df.groupBy(F.expr(column).alias("value")).agg(F.count("*").alias("n"), F.max(role(schema, "time")).alias("last_seen"))


def per_minute(df: DataFrame, schema: Schema, severities: dict[str, str], unit: str = "minute") -> DataFrame:
    level = F.lower(role(schema, "severity"))
    counts = [F.count_if(level == value).alias(name) for name, value in severities.items()]
    return df.groupBy(F.date_trunc(unit, role(schema, "time")).alias("bucket")).agg(F.count("*").alias("n"), *counts)


def patterns(df: DataFrame, text: Column, limit: int | None = None) -> DataFrame:
    out = df.groupBy(fingerprint(text).alias("pattern")).agg(F.count("*").alias("n"))
    return out if limit is None else out.orderBy(F.desc("n"), "pattern").limit(limit)


def deltas(df: DataFrame, schema: Schema, pattern: Column, start: str, middle: str, end: str) -> DataFrame:
    """Counts of a pattern in a window and in the equal one before it."""
    now = within(df, schema, middle, end).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n_now"))
    before = within(df, schema, start, middle).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n_before"))
    out = now.join(before, "pattern", "full_outer").na.fill(0, ["n_now", "n_before"])
    return out.withColumn("delta", F.col("n_now") - F.col("n_before"))


def common(df: DataFrame, schema: Schema, query: str, start: str, end: str, facets: dict[str, list] | None = None, excluded: dict[str, list] | None = None, formats: list[str] | None = None) -> DataFrame:
    """The rows of every panel: a window, the search, values of facets, values left
    out (null is not left out) and log formats."""
    out = within(df, schema, start, end).where(compile_query(query, schema).predicate)
    for column, values in (facets or {}).items():
        out = out.where(F.expr(column).isin(values))
    for column, values in (excluded or {}).items():
        out = out.where(~F.coalesce(F.expr(column).isin(values), F.lit(False)))
    return out.where(log_format(schema).isin(formats)) if formats else out


def log_format(schema: Schema, key: str = "format") -> Column:
    """The bag's format; lines from before it was kept are legacy."""
    if not schema.bags:
        raise CompileError("this panel needs a bag")
    bag = F.try_parse_json(F.col(schema.bags[0].column).cast("string"))
    return F.coalesce(F.try_variant_get(bag, f"$.{key}", "string"), F.lit("legacy"))


def errors(df: DataFrame, schema: Schema, levels: tuple[str, ...] = ("error", "fatal", "critical", "panic")) -> DataFrame:
    return df.agg(F.count_if(F.lower(role(schema, "severity")).isin(*levels)).alias("n"))


def emitting(df: DataFrame, column: str) -> DataFrame:
    """How many pods, or whatever the column names, the rows come from."""
    return df.agg(F.countDistinct(F.expr(column)).alias("n"))


def log_lines(df: DataFrame, schema: Schema, limit: int = 1000) -> DataFrame:
    """The newest lines under the names of a log frame."""
    body = F.expr(schema.declared(schema.default).column)
    key = [F.col(schema.row_key)] if schema.row_key in df.columns else []
    rows = df.orderBy(role(schema, "time").desc(), *key).limit(limit)
    return rows.select(role(schema, "time").alias("timestamp"), body.alias("body"), role(schema, "severity").alias("severity"), *[k.cast("string").alias("id") for k in key])


def format_variable(df: DataFrame, schema: Schema, key: str = "format") -> DataFrame:
    return facet(df.withColumn("__format", log_format(schema, key)), "__format", 100)


def exclude_variable(df: DataFrame, column: str, limit: int = 30) -> DataFrame:
    """Values that may be left out, after ``(none)``, which leaves out nothing."""
    none = df.sparkSession.createDataFrame([("(none)", 0)], "value string, n bigint")
    return none.unionByName(facet(df, f"cast({column} as string)", limit))
