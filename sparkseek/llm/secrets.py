"""Incremental secret scan over a content-addressed blob ledger.

Every version of every text is addressed by the SHA-256 of its bytes.  A ledger
row says that a blob was scanned under one rule at one version, and what was
found; a scan looks only at (blob, rule, version) triples that the ledger lacks
and joins all findings back to every path that ever held the blob.  JVM
expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

LEDGER = "blob string, rule string, version int, spans array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  A leftmost non-overlapping match counts if its
    ``group`` has ``least`` characters or more.  ``hint`` is a cheaper pattern
    found in every text with a match that counts."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


#: The three base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Kinds beyond the base: key blocks and signed web tokens.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
)
RULES = BASE_RULES + MORE_RULES


def address(text: Column) -> Column:
    """The blob id of a text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _pieces(rule: Rule) -> Column:
    """Per match: length of the text before it, its own length, whether it counts."""
    hits = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    before = F.split("text", rule.pattern, -1)
    zipped = F.arrays_zip(
        F.transform(before, lambda x: F.length(x)).alias("gap"),
        F.transform(hits, lambda x: F.length(x)).alias("size"),
        F.transform(group, lambda x: F.length(x) >= rule.least).alias("counts"),
    )
    return F.when(F.col("text").rlike(rule.hint), zipped)


def _scan(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of (blob, text, todo), where ``todo`` lists the kinds to scan."""
    matches = [
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", r.kind), _pieces(r)).alias("pieces"))
        for r in rules
    ]
    rows = blobs.select("blob", "todo", F.explode(F.array(*matches)).alias("m")).where(F.array_contains("todo", F.col("m.rule")))
    rows = rows.select("blob", "m.rule", "m.version", F.posexplode_outer("m.pieces").alias("i", "p"))
    order = Window.partitionBy("blob", "rule").orderBy("i")
    end = F.sum(F.coalesce(F.col("p.gap"), F.lit(0)) + F.coalesce(F.col("p.size"), F.lit(0))).over(order)
    rows = rows.withColumn("end", end)
    span = F.when(F.col("p.counts"), F.struct((F.col("end") - F.col("p.size")).cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")))
    return rows.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, findings of every path) for ``docs`` (doc_id, text).

    Findings hold one row per row of ``docs``: doc_id, blob and ``spans``, an
    array of (kind, start, end) in order of start, then of kind as listed; code
    points, end exclusive.  Null text is empty.  Repeated rows are repeated
    paths.  Ledger rows under another version of a rule are not used, and one held
    twice counts once.
    """
    paths = docs.select("doc_id", address(F.col("text")).alias("blob"))
    texts = docs.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        blobs, known = texts.withColumn("todo", kinds), None
    else:
        known = ledger.where(F.array_contains(current, F.struct("rule", "version"))).dropDuplicates(["blob", "rule", "version"])
        done = known.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        blobs = texts.join(done, "blob", "left").withColumn("todo", F.array_except(kinds, F.coalesce("done", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("todo") > 0)
    fresh = settle(_scan(blobs, rules).select("blob", "rule", "version", "spans"))
    every = fresh if known is None else known.select(fresh.columns).unionByName(fresh)
    return fresh, _findings(paths, every, rules)


def _findings(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    listed = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"), "rule")
    listed = listed.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s.start", rank["rule"].alias("rank"), "s.end", F.col("rule").alias("kind")))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    spans = F.transform(F.coalesce("found", none), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return paths.join(listed, "blob", "left").select("doc_id", "blob", spans.alias("spans"))


def scan_with_ledger(docs: DataFrame, folder: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The findings of :func:`scan` with the ledger kept in ``folder``, which every
    call reads and extends by what it scanned.  Blobs and rule versions that an
    earlier call covered are not scanned again.  A folder without a ledger is an
    empty one; two calls at a time may both scan a blob, which counts once."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    ledger = spark.read.schema(LEDGER).parquet(folder) if there else spark.createDataFrame([], LEDGER)
    fresh, found = scan(docs, ledger, rules)
    fresh.write.mode("append").parquet(folder)
    return found


def digest(findings: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of :func:`scan`'s findings."""
    base = [r.kind for r in BASE_RULES]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind))

    return findings.select(
        "doc_id",
        *[count(k).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
