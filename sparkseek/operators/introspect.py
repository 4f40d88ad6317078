"""What is in a table: profile, bag keys, a descriptor draft and drift."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import to_instant, to_number
from ..plans.schema import Schema

# Names that suggest a role, best first, and thresholds.
ROLE_NAMES = {
    "body": ["msg", "message", "body", "log", "content", "line"],
    "severity": ["level", "severity", "severity_text", "log_level", "loglevel"],
    "component": ["component", "service", "service_name", "app"],
    "bag": ["kv", "attributes", "attrs", "tags", "labels"],
    "time": ["ts", "timestamp", "time", "event_time", "_timestamp", "created_at"],
}
ALIASES = {"whole record": ["body", "line", "content", "log"], "message": ["msg", "message"]}
SAMPLE, MAX_SEVERITIES, LEAST_FILL, MAX_FACET = 1000, 64, 0.05, 10_000


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType)):
        return "string"
    if isinstance(kind, T.NumericType):
        return "number"
    return "variant" if isinstance(kind, (T.VariantType, T.MapType)) else "other"


def digest(df: DataFrame) -> str:
    """FNV-1a of the sorted ``name:type`` list."""
    value = 0xCBF29CE484222325
    for byte in ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)).encode():
        value = (value ^ byte) * 0x100000001B3 % 2**64
    return f"{value:016x}"


def profile(df: DataFrame) -> DataFrame:
    """One row per column from one pass over the table."""
    parts = []
    for f in df.schema:
        s = F.col(f"`{f.name}`").cast("string") if kind_of(f.dataType) not in ("other", "variant") else F.lit(None).cast("string")
        c = F.col(f"`{f.name}`")
        parts.append(
            F.struct(
                F.lit(f.name).alias("col"), F.count("*").alias("scanned"), F.count(c).alias("non_null"), F.count(to_number(s)).alias("numeric_ok"), F.count(to_instant(s)).alias("timestamp_ok"),
                F.approx_count_distinct(s).alias("approx_distinct"), F.coalesce(F.min(F.length(s)), F.lit(0)).cast("bigint").alias("min_len"), F.coalesce(F.max(F.length(s)), F.lit(0)).cast("bigint").alias("max_len"),
            )
        )
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def bag_keys(df: DataFrame, column: str, limit: int | None = 32, only: list[str] | None = None) -> DataFrame:
    """The most frequent keys of a JSON bag, or ``only`` these: rows, numeric values,
    nested values."""
    bag = F.from_json(F.col(column).cast("string"), "map<string,string>")
    rows = df.select(F.explode(bag).alias("key", "value"))
    if only is not None:
        rows = rows.where(F.col("key").isin(only))
    nested = F.col("value").rlike(r"^\s*[\[{]")
    out = rows.groupBy("key").agg(F.count("*").alias("n"), F.count(to_number(F.col("value"))).alias("numeric_ok"), F.count_if(nested).alias("nested"))
    return out if limit is None else out.orderBy(F.desc("n"), "key").limit(limit)


def row_key_usable(df: DataFrame, column: str, sample: int = 10_000) -> DataFrame:
    rows = df.select(F.col(column).alias("k")).limit(sample)
    out = rows.agg(F.count("*").alias("sampled"), F.countDistinct("k").alias("distinct"), F.count_if(F.col("k").isNull()).alias("nulls"))
    return out.withColumn("usable", (F.col("sampled") == F.col("distinct")) & (F.col("nulls") == 0))


def build(df: DataFrame, table: str = "", bags: tuple[str, ...] = (), body: str = "", confirmed_time: str = "", aliases: bool = False) -> dict:
    """A descriptor draft.

    The body is never guessed beyond the listed names: name it if it has another.  A
    string column becomes the time if every one of SAMPLE values or more is an
    instant, or if it is confirmed.  A lone variant column is a bag whatever its name.
    With ``aliases``, the body answers to the other names of its kind that no column
    has.  Columns that are nearly empty, or nearly unique strings, are not displayed.
    """
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    facts = {r["col"]: r for r in profile(df).collect()}  # a row per column

    def pick(role: str, *allowed: str) -> str:
        return next((c for n in ROLE_NAMES[role] for c in kinds if c.lower() == n and kinds[c] in allowed), "")

    def is_time(name: str) -> bool:
        f = facts[name]
        whole = f["non_null"] > 0 and f["timestamp_ok"] == f["non_null"]
        return whole and (f["non_null"] >= SAMPLE or name == confirmed_time)

    names = [c for n in ROLE_NAMES["time"] for c in kinds if c.lower() == n]
    time = next((c for c in names if kinds[c] == "timestamp" or (kinds[c] == "string" and is_time(c))), "")
    body, severity = body or pick("body", "string"), pick("severity", "string")
    if severity and facts[severity]["approx_distinct"] > MAX_SEVERITIES:
        severity = ""
    variants = [c for c in kinds if kinds[c] == "variant"]
    found = [c for c in kinds if c in bags or (c in variants and (c.lower() in ROLE_NAMES["bag"] or len(variants) == 1))]
    fields = []
    for name, kind in kinds.items():
        if kind in ("other", "variant") or name in found:
            continue
        entry = {"name": name, "kind": "text" if name == body else "timestamp" if name == time else kind}
        if name == time and kind == "string":
            entry |= {"column": f"try_cast({name} as timestamp)", "conversion": True}
        if aliases and name == body:
            taken = {c.lower() for c in kinds}
            entry["aliases"] = [n for group in ALIASES.values() if name.lower() in group for n in group if n not in taken]
        fields.append(entry)

    def shown(name: str) -> bool:
        f = facts[name]
        filled = f["scanned"] == 0 or f["non_null"] >= LEAST_FILL * f["scanned"]
        return filled and not (f["approx_distinct"] > MAX_FACET and 2 * f["approx_distinct"] > f["scanned"])

    component = pick("component", "string")
    display = [c for c in (time, severity, component) if c and (c == time or shown(c))] + ([body] if body else [])
    out = {"table": table, "fields": fields, "bags": [{"column": b} for b in found], "time": time, "severity": severity}
    return out | ({"default": body, "display": display, "indexes": [{"name": "body", "columns": [body]}]} if body else {})


def drift(df: DataFrame, schema: Schema, known: str = "") -> DataFrame:
    """(subject, finding, level) of what the table and the descriptor disagree on.

    ``drift``: a search would fail or miss rows; ``hazard``: a search may mean
    something else than it says; ``limit``: something that no search can reach.
    """
    columns = {f.name: kind_of(f.dataType) for f in df.schema}
    out = []
    for f in schema.fields:
        if f.column not in columns:
            if f.column.isidentifier():
                out.append((f.column, "lost column", "drift"))
            else:
                lost = sorted(_names(f.column) - set(columns))
                out += [(n, f"lost column of the expression of {f.name}", "drift") for n in lost]
        elif (want := "string" if f.kind == "text" else f.kind) != columns[f.column]:
            out.append((f.column, f"declared {want}, found {columns[f.column]}", "drift"))
    used = {f.column for f in schema.fields} | {b.column for b in schema.bags} | {n for f in schema.fields for n in _names(f.column)}
    for c, k in columns.items():
        if k == "other":
            out.append((c, "a type that cannot be searched", "limit"))
        elif c not in used and c != schema.row_key:
            out.append((c, "undeclared column", "drift"))
    for bag in schema.bags:
        if bag.column not in columns:
            out.append((bag.column, "lost bag", "drift"))
            continue
        # Declared keys in any case, however rare.
        wanted = {k.lower() for k in bag.keys}
        every = bag_keys(df, bag.column, None).where(F.lower("key").isin(list(wanted))) if wanted else None
        keys = {r["key"]: r for r in every.collect()} if wanted else {}
        for key, kind in bag.keys.items():
            alike = sorted(k for k in keys if k.lower() == key.lower())
            if key not in keys:
                out.append((f"{bag.column}.{key}", f"case differs: {alike[0]}" if alike else "vanished key", "drift"))
            elif kind == "number" and keys[key]["numeric_ok"] < keys[key]["n"]:
                out.append((f"{bag.column}.{key}", "values that are no numbers", "hazard"))
            if key in keys and keys[key]["nested"]:
                out.append((f"{bag.column}.{key}", "values that are objects or arrays", "limit"))
            if key in columns:
                out.append((f"{bag.column}.{key}", "shadows a column", "hazard"))
    if known and known != digest(df):
        out.append(("table", "digest changed", "drift"))
    return df.sparkSession.createDataFrame(out, "subject string, finding string, level string")


def _names(expression: str) -> set[str]:
    """Names in an expression that are no functions, types or literals."""
    plain = re.sub(r"'(?:[^']|'')*'", " ", expression)
    plain = re.sub(r"(?i)\bas\s+\w+", " ", plain)
    return {n for n in re.findall(r"\b([A-Za-z_]\w*)\b(?!\s*\()", plain) if n.lower() not in ("as", "null", "true", "false", "and", "or", "not", "case", "when", "then", "else", "end", "is", "in")}
