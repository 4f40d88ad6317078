"""URL filtering by host rules and mined association rules.  JVM code only.

Pages whose address names a labelled document are transactions of URL tokens plus
their label; FP-growth finds token combinations that imply a bad label, pruned by
confidence, support and more general rules, and an inverted index on tokens
matches them.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A mined rule holds for this share of the labelled pages and for so many at least.
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE = 0.002, 3, 0.8
_BAD = "label:bad"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _tokens(pages: DataFrame) -> Column:
    """Distinct URL tokens: host labels, path words, extension, query keys, fragment."""
    names = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("host:"), x))
    words = F.filter(F.split(ascii_lower(F.col("path")), r"[/.]"), lambda x: (x != "") & ~x.rlike(r"\d"))
    query = F.regexp_extract_all(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    return F.array_distinct(
        F.concat(
            names,
            F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
            F.transform(query, lambda x: F.concat(F.lit("key:"), x)),
            F.when(F.col("url").contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def mine(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule_id, tokens, confidence, support) of the rules that imply a bad label.

    A page is labelled by the document that the first number in its path names:
    bad if that is of low quality or toxic.  Rules with a more general rule of at
    least their confidence are pruned.  No labelled page gives no rule.
    """
    spark = pages.sparkSession
    none = "rule_id bigint, tokens array<string>, confidence double, support double"
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) as bigint)")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad")).where("bad IS NOT NULL")
    baskets = pages.select(number.alias("doc_id"), "tokens").join(marks, "doc_id")
    baskets = baskets.select(F.when(F.col("bad") == 1, F.array_append("tokens", F.lit(_BAD))).otherwise(F.col("tokens")).alias("items"))
    n = baskets.count()
    if n < MIN_PAGES:
        return spark.createDataFrame([], none)
    model = FPGrowth(itemsCol="items", minSupport=max(MIN_SUPPORT, MIN_PAGES / n), minConfidence=MIN_CONFIDENCE).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(_BAD)))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    # More general rules: each rule against the rules on its tokens.
    index = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("wide"), F.col("confidence").alias("c"))
    narrow = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(index, "token")
    narrow = narrow.where((F.size("wide") < F.size("tokens")) & (F.size(F.array_except("wide", "tokens")) == 0) & (F.col("c") >= F.col("confidence")))
    rules = rules.join(narrow.select("tokens").distinct(), "tokens", "left_anti")
    return rules.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support")


def _index(mined: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule_id, wanted): each rule under its rarest token among the pages, so
    that a token of every page brings no rule up unless the rule has no other."""
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    places = mined.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(counts, "token")
    # As few rows as the rules have tokens.
    rarest = places.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("rare"), F.any_value("tokens").alias("wanted"))
    return rarest.select("rare.token", "rule_id", "wanted")


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every row of ``pages``.

    The longest fitting rule decides; else a page that holds all tokens of a mined
    rule is blocked, any other allowed.  Null urls and such without ``://`` have an
    empty host and path and are allowed.  Rows that share page_id and url are alike.
    """
    rows = pages.select("page_id", "url")
    host, path = host_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = listed(F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("listed", verdict)
    rows = rows.withColumn("tokens", F.when(F.col("host") != "", _tokens(rows)).otherwise(F.array().cast("array<string>")))
    mined = mine(rows, labels)
    urls = rows.where("listed IS NULL").select("url", "tokens").distinct()
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(_index(mined, urls), "token")
    hits = hits.where(F.size(F.array_except("wanted", "tokens")) == 0).groupBy("url").agg(F.min("rule_id").alias("mined_rule"))
    rows = rows.join(hits, "url", "left")
    found = F.when(F.col("mined_rule").isNotNull() & F.col("listed").isNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", found).alias("verdict"), F.when(F.col("listed").isNull(), F.col("mined_rule")).alias("mined_rule"))
