"""The registered queries of the search engine, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, introspect, panels
from .operators.search import conform, expand, matching, search
from .plans.schema import Schema, load
from .sources import loglines

Query = Callable[[SparkSession, str], DataFrame]


def documents(filters: tuple[str, ...] = ()) -> Schema:
    return load(
        {
            "table": "documents", "default": "text", "row_key": "doc_id", "display": ["doc_id", "lang", "source"],
            "fields": [
                {"name": "text", "kind": "text", "aliases": ["body"]}, {"name": "doc_id", "kind": "number"}, {"name": "lang", "kind": "string"}, {"name": "source", "kind": "string"}, {"name": "n_chars", "kind": "number"},
            ],
            "indexes": [{"name": "idx", "columns": ["text"], "filters": list(filters)}],
        }
    )


def events() -> Schema:
    return load(
        {
            "table": "events", "default": "message", "time": "ts", "severity": "event_type", "row_key": "event_id", "display": ["ts", "event_type", "event_id", "value"],
            "fields": [
                {"name": "message", "column": "event_type", "kind": "text"}, {"name": "event_type", "kind": "string", "aliases": ["level"]}, {"name": "ts", "kind": "timestamp"},
                {"name": "event_id", "kind": "number"}, {"name": "user_id", "kind": "number"}, {"name": "value", "kind": "number"}, {"name": "amount", "column": "cast(value as string)", "kind": "string", "conversion": True},
            ],
            "bags": [{"column": "props", "keys": {"n": "number"}}],
            "indexes": [{"name": "idx", "columns": ["event_type"]}],
        }
    )


def pages() -> Schema:
    return load(
        {
            "table": "pages", "default": "url", "source_file": "url", "row_key": "page_id",
            "fields": [{"name": "url", "kind": "text"}, {"name": "address", "column": "url || ''", "kind": "string"}, {"name": "page_id", "kind": "number"}],
            "indexes": [{"name": "idx", "columns": ["url"]}, {"name": "ng", "kind": "ngram", "columns": ["url"]}],
        }
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _has(word: str) -> str:
    return f"list_contains({_TOKENS}, '{word}')"


def _rows(name: str, source: str, query: str, where: str, schema: Callable[[], Schema] | None = None) -> None:
    """Register a search that returns the row keys."""
    make = schema or {"documents": documents, "events": events, "pages": pages}[source]
    key = {"documents": "doc_id", "events": "event_id", "pages": "page_id"}[source]
    _QUERIES[name] = lambda spark, sf_dir: matching(table(spark, sf_dir, source), make(), query).select(key)
    _SQL[name] = f"SELECT {key} FROM {source} WHERE {where}"


_STOP = lambda: documents(("english_stop",))
_joined = f"(' ' || array_to_string({_TOKENS}, ' ') || ' ')"

for _name, _source, _query, _where in [
    ("empty_matches_all", "events", "", "true"),
    ("term_token", "documents", "therly", _has("therly")),
    ("term_multi_token", "documents", "of-the", f"contains({_joined}, ' of the ')"),
    ("implicit_and", "documents", "of that", f"{_has('of')} AND {_has('that')}"),
    ("explicit_or", "documents", "therly or thble", f"{_has('therly')} OR {_has('thble')}"),
    ("nested_group", "documents", "(therly OR of) lang:en", f"({_has('therly')} OR {_has('of')}) AND lower(lang) = 'en'"),
    ("exclude_beside", "documents", "of -that", f"{_has('of')} AND NOT {_has('that')}"),
    ("exclude_alone", "documents", "-of", f"NOT coalesce({_has('of')}, false)"),
    ("exclude_absent", "documents", "-zzzzqq", "true"),
    ("or_with_negation", "documents", "of OR -that", f"{_has('of')} OR NOT {_has('that')}"),
    ("absent_or_filter", "documents", "zzzzqq OR lang:en", "lower(lang) = 'en'"),
    ("phrase_exact", "documents", '"of the"', f"contains({_joined}, ' of the ')"),
    ("phrase_reversed", "documents", '"the of"', f"contains({_joined}, ' the of ')"),
    ("phrase_empty", "documents", '""', "false"),
    ("phrase_no_token", "documents", '"|"', "contains(text, '|')"),
    ("boost_keeps_rows", "documents", "therly^3", _has("therly")),
    ("fuzzy_1", "documents", "therly~1", f"len(list_filter({_TOKENS}, lambda t: levenshtein(t, 'therly') <= 1)) > 0"),
    ("fuzzy_2", "documents", "therly~2", f"len(list_filter({_TOKENS}, lambda t: levenshtein(t, 'therly') <= 2)) > 0"),
    ("wild_prefix", "documents", "therl*", "regexp_matches(lower(text), '(^|[^a-z0-9])therl[a-z0-9]*([^a-z0-9]|$)')"),
    ("wild_suffix", "documents", "*rerly", "regexp_matches(lower(text), '(^|[^a-z0-9])[a-z0-9]*rerly([^a-z0-9]|$)')"),
    ("wild_infix", "documents", "th*ly", "regexp_matches(lower(text), '(^|[^a-z0-9])th[a-z0-9]*ly([^a-z0-9]|$)')"),
    ("wild_qmark", "documents", "th?s", "regexp_matches(lower(text), '(^|[^a-z0-9])th[a-z0-9]s([^a-z0-9]|$)')"),
    ("wild_spanning", "pages", "*example.org/es*", "lower(url) LIKE '%example.org/es%'"),
    ("regex_ci", "documents", "/Th.{2}re /", "regexp_matches(text, '(?i)Th.{2}re ')"),
    ("regex_case_kept", "documents", "/(?-i)Th.{2}re /", "regexp_matches(text, 'Th.{2}re ')"),
    ("str_eq_ci", "events", "event_type:ERROR", "lower(event_type) = 'error'"),
    ("str_group", "events", "level:(error OR view)", "lower(event_type) IN ('error', 'view')"),
    ("str_wild_anchored", "events", "event_type:s*", "lower(event_type) LIKE 's%'"),
    ("num_eq", "events", "value:12.31", "value = 12.31"),
    ("num_gt", "events", "value:>10", "value > 10"),
    ("num_between_incl", "events", "value:[1 TO 9]", "value BETWEEN 1 AND 9"),
    ("num_between_excl", "events", "value:{1 TO 9}", "value > 1 AND value < 9"),
    ("num_between_half", "events", "value:{1 TO 9]", "value > 1 AND value <= 9"),
    ("num_open", "events", "value:[20 TO *]", "value >= 20"),
    ("ts_bound", "events", "ts:>2024-01-05 12:30:00", "ts > TIMESTAMP '2024-01-05 12:30:00'"),
    ("ts_between", "events", "ts:[2024-01-05 TO 2024-01-09]", "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'"),
    ("ts_zone", "events", "ts:<2024-01-05T08:00:00+08:00", "ts < TIMESTAMP '2024-01-05 00:00:00'"),
    ("exists_field", "events", "event_type:*", "event_type IS NOT NULL AND event_type <> ''"),
    ("bag_eq", "events", "k:26", "json_extract_string(props, '$.k') = '26'"),
    ("bag_num_bound", "events", "props.k:>50", "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50"),
    ("bag_exists", "events", "k:*", "json_extract(props, '$.k') IS NOT NULL"),
    ("bag_case_sensitive", "events", "K:*", "json_extract(props, '$.K') IS NOT NULL"),
    ("bag_missing_negated", "events", "-absent:1", "true"),
    ("string_num_bound_excludes", "pages", "address:>5", "TRY_CAST(url AS DOUBLE) > 5"),
    ("string_as_number", "events", "amount:>20", "value > 20"),
    ("source_file_name", "pages", "474.html", "regexp_matches(lower(url), '(^|[^a-z0-9_.-])474\\.html([^a-z0-9_.-]|\\.[^a-z0-9]|\\.?$)')"),
    ("source_file_position", "pages", "-page.rs:12*", "NOT regexp_matches(lower(url), '(^|[^a-z0-9_.-])page\\.rs:12[0-9]*([^0-9]|$)')"),
]:
    _rows(_name, _source, _query, _where)

_rows("stopword_scan", "documents", "that", "regexp_matches(lower(text), '(^|[^a-z0-9])that([^a-z0-9]|$)')", _STOP)
_rows("phrase_collapsed_one", "documents", '"of ly"', f"{_has('ly')} AND contains(lower(text), 'of ly')", _STOP)
_rows("phrase_collapsed_zero", "documents", '"of that"', "contains(lower(text), 'of that')", _STOP)
_rows("phrase_gap", "documents", '"attion the thanedble"', f"regexp_matches({_joined}, ' attion [^ ]+ thanedble ')", _STOP)


def _query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


@_query(
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS k FROM documents),
    p AS (SELECT doc_id, unnest(k) AS w, unnest(range(len(k))) AS i FROM t)
    SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.w = 'of' AND b.w = 'that' AND abs(b.i - 1 - a.i) <= 2"""
)
def phrase_slop2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "documents"), documents(), '"of that"~2').select("doc_id")


@_query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def neg_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load({"table": "d", "default": "text", "fields": [{"name": "text", "kind": "text"}, {"name": "quality", "kind": "number"}], "indexes": [{"name": "i", "columns": ["text"]}]})
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return matching(rows, schema, "-quality:1").select("doc_id")


@_query(f"SELECT count(*) FILTER (WHERE {_has('of')}) AS n_in, count(*) FILTER (WHERE NOT {_has('of')}) AS n_out, count(*) AS n_all FROM documents")
def partition_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.compiler import compile_query

    count = lambda q, name: F.count_if(compile_query(q, documents()).predicate).alias(name)
    return table(spark, sf_dir, "documents").agg(count("of", "n_in"), count("-of", "n_out"), F.count("*").alias("n_all"))


@_query("SELECT ts, event_type, event_id, value FROM events WHERE lower(event_type) = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def display_newest_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "events"), events(), "level:error", limit=100).withColumn("event_id", F.col("event_id").cast("bigint"))


@_query(
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS k FROM documents),
    s AS (SELECT count(*) AS n, avg(len(k)) AS a, count(*) FILTER (WHERE list_contains(k, 'therly')) AS d1, count(*) FILTER (WHERE list_contains(k, 'thble')) AS d2 FROM t),
    f AS (SELECT doc_id, len(k) AS dl, len(list_filter(k, lambda x: x = 'therly')) AS t1, len(list_filter(k, lambda x: x = 'thble')) AS t2 FROM t)
    SELECT doc_id, round(ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / a)) + 2 * ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS score
    FROM f, s WHERE t1 > 0 OR t2 > 0 ORDER BY score DESC, doc_id LIMIT 20"""
)
def bm25_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search(table(spark, sf_dir, "documents"), documents(), "therly OR thble^2", limit=20, score=True)
    return rows.select("doc_id", F.round("score", 6).alias("score"))


@_query("SELECT event_type AS value, count(*) AS n FROM events WHERE value > 5 GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.facet(matching(table(spark, sf_dir, "events"), events(), "value:>5"), "event_type")


@_query("SELECT event_type AS value, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1")
def facet_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.facet_last_seen(table(spark, sf_dir, "events"), events(), "event_type")


@_query("SELECT date_trunc('minute', ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS views FROM events GROUP BY 1")
def minute_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.per_minute(table(spark, sf_dir, "events"), events(), {"errors": "error", "views": "view"})


_MASK = "regexp_replace(regexp_replace(url, '[0-9a-f]{8,}', '?', 'g'), '[0-9]+', '?', 'g')"


@_query(f"SELECT count(DISTINCT {_MASK}) AS n FROM pages")
def distinct_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").agg(F.countDistinct(panels.fingerprint(F.col("url"))).alias("n"))


@_query(f"SELECT {_MASK} AS pattern, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, pattern LIMIT 50")
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.patterns(table(spark, sf_dir, "pages"), F.col("url"), 50)


@_query(
    """WITH a AS (SELECT event_type || '-' || (user_id % 7) AS pattern, count(*) AS n_now FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-17' GROUP BY 1),
    b AS (SELECT event_type || '-' || (user_id % 7) AS pattern, count(*) AS n_before FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-09' GROUP BY 1)
    SELECT pattern, coalesce(n_now, 0) AS n_now, coalesce(n_before, 0) AS n_before, coalesce(n_now, 0) - coalesce(n_before, 0) AS delta FROM a FULL OUTER JOIN b USING (pattern)"""
)
def event_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.deltas(table(spark, sf_dir, "events"), events(), F.expr("event_type || '-' || (user_id % 7)"), "2024-01-01", "2024-01-09", "2024-01-17")


@_query("SELECT key, count(*) AS n, count(TRY_CAST(json_extract_string(props, key) AS DOUBLE)) AS numeric_ok, CAST(0 AS BIGINT) AS nested FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def bag_key_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.bag_keys(table(spark, sf_dir, "events"), "props")


@_query(
    """SELECT 'event_type' AS col, count(*) AS scanned, count(event_type) AS non_null, count(TRY_CAST(event_type AS DOUBLE)) AS numeric_ok, CAST(min(length(event_type)) AS BIGINT) AS min_len, CAST(max(length(event_type)) AS BIGINT) AS max_len FROM events
    UNION ALL SELECT 'props', count(*), count(props), CAST(0 AS BIGINT), CAST(min(length(props)) AS BIGINT), CAST(max(length(props)) AS BIGINT) FROM events"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.profile(table(spark, sf_dir, "events").select("event_type", "props")).drop("timestamp_ok", "approx_distinct")


@_query("SELECT event_type, count(*) AS n FROM events WHERE event_type LIKE 's%' OR value > 30 GROUP BY 1")
def macro_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(spark, "SELECT event_type, count(*) AS n FROM searched WHERE $__search('level:s* OR value:>30') GROUP BY 1", events(), table(spark, sf_dir, "events"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line of each format per event."""
    e = table(spark, sf_dir, "events")
    day, clock = F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "HH:mm:ss.SSS")
    iso, level = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    user = F.col("user_id").cast("string")
    text = {
        "tidb": F.concat(F.lit("["), day, F.lit(" "), clock, F.lit(" +00:00] ["), level, F.lit('] [file.rs:'), user, F.lit('] ["a '), F.col("event_type"), F.lit(' \\"x\\""] [user='), user, F.lit('] ["a b"="c d"] [user=9'), user, F.lit("]")),
        "klog": F.concat(F.lit("E"), F.date_format("ts", "MMdd HH:mm:ss.SSS"), F.lit("000  1 proxier.go:"), user, F.lit('] "a '), F.col("event_type"), F.lit('" user='), user),
        "zap": F.concat(iso, F.lit("\t"), level, F.lit("\ta "), F.col("event_type"), F.lit('\t{"user":"'), user, F.lit('"}')),
        "tracing": F.concat(iso, F.lit("  "), level, F.lit(" span{x}: target: a "), F.col("event_type")),
        "json": F.concat(F.lit('{"level":"'), F.lower(level), F.lit('","msg":"a '), F.col("event_type"), F.lit('","ts":"'), iso, F.lit('","user":"'), user, F.lit('"}')),
        "raw": F.concat(F.lit("a "), F.col("event_type")),
        "art": F.lit("| a | b |"),
    }
    lines = F.array(*[F.struct(F.lit(k).alias("made"), v.alias("message")) for k, v in text.items()])
    return e.select("event_id", "ts", F.explode(lines).alias("l")).select("event_id", F.col("ts").alias("seen"), "l.*")


_MS = "date_trunc('milliseconds', ts)"
_LEVEL = "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END"


def _parsed(fmt: str, ts: str, level: str, msg: str, user: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = loglines.parse_lines(_lines(spark, sf_dir).where(F.col("made") == fmt), runtime="seen")
        return rows.select("event_id", "format", "ts", "level", "msg", F.col("kv")["user"].alias("user"))

    _QUERIES[f"parse_{fmt}"] = run
    _SQL[f"parse_{fmt}"] = f"SELECT event_id, '{fmt}' AS format, {ts} AS ts, {level} AS level, {msg} AS msg, {user} AS \"user\" FROM events"


_parsed("tidb", _MS, _LEVEL, """'a ' || event_type || ' \\"x\\"'""", "'9' || user_id")
_parsed("klog", "ts", "'ERROR'", "'a ' || event_type", "CAST(user_id AS VARCHAR)")
_parsed("zap", _MS, _LEVEL, "'a ' || event_type", "CAST(user_id AS VARCHAR)")
_parsed("tracing", _MS, _LEVEL, "'span{x}: target: a ' || event_type", "CAST(NULL AS VARCHAR)")
_parsed("json", _MS, _LEVEL, "'a ' || event_type", "CAST(user_id AS VARCHAR)")
_parsed("raw", "ts", "'UNKNOWN'", "'a ' || event_type", "CAST(NULL AS VARCHAR)")


@_query("SELECT f.format, count(*) AS n FROM events, (VALUES ('tidb'), ('klog'), ('zap'), ('tracing'), ('json'), ('raw')) f(format) GROUP BY 1")
def table_art_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = loglines.without_table_art(loglines.parse_lines(_lines(spark, sf_dir), runtime="seen"))
    return rows.groupBy("format").agg(F.count("*").alias("n"))


@_query(None)
def stemmed_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = documents(("english_stop", "english_stemmer"))
    return matching(table(spark, sf_dir, "documents"), schema, "enon").select("doc_id")


_N = lambda where: f"(SELECT count(*) FROM documents WHERE {where})"
_NEAR = f"""(WITH p AS (SELECT doc_id, unnest({_TOKENS}) AS w, unnest(range(len({_TOKENS}))) AS i FROM documents)
    SELECT count(DISTINCT a.doc_id) FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.w = 'of' AND b.w = 'that' AND abs(b.i - 1 - a.i) <= 3)"""


@_query(
    f"""SELECT case_name, actual, baseline, witness, 'PASS' AS result FROM (VALUES
    ('all rows', {_N('true')}, NULL::BIGINT, NULL::BIGINT), ('absent', CAST(0 AS BIGINT), NULL, NULL),
    ('narrows', {_N(f"{_has('of')} AND {_has('that')}")}, {_N(_has('of'))}, NULL),
    ('partition', {_N(_has('of'))}, {_N('true')}, {_N(f"NOT {_has('of')}")}),
    ('absent or x is x', {_N(_has('of'))}, {_N(_has('of'))}, NULL),
    ('slop widens', {_NEAR}, {_N(f"contains({_joined}, ' of that ')")}, NULL),
    ('token within substring', {_N("contains(lower(text), 'of')")}, {_N(_has('of'))}, NULL)) t(case_name, actual, baseline, witness)"""
)
def conformance_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [
        {"name": "all rows", "query": "", "compare": "nonzero"},
        {"name": "absent", "query": "zzzzqq", "compare": "zero"},
        {"name": "narrows", "query": "of that", "baseline": "of", "compare": "narrows"},
        {"name": "partition", "query": "of", "witness": "-of", "baseline": "", "compare": "partitions"},
        {"name": "absent or x is x", "query": "zzzzqq OR of", "baseline": "of", "compare": "eq"},
        {"name": "slop widens", "query": '"of that"~3', "baseline": '"of that"', "compare": "ge"},
        {"name": "token within substring", "query": "/of/", "baseline": "of", "compare": "ge"},
    ]
    return conform(spark, table(spark, sf_dir, "documents"), documents(), cases)


@_query("SELECT * FROM (VALUES ('doc_id', 'number'), ('text', 'text'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'number')) t(name, kind)")
def descriptor_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = introspect.build(table(spark, sf_dir, "documents"), "documents", body="text")
    return spark.createDataFrame([(f["name"], f["kind"]) for f in spec["fields"]], "name string, kind string")


@_query("SELECT * FROM (VALUES ('user_id', 'lost column', 'drift'), ('extra', 'undeclared column', 'drift'), ('props.n', 'vanished key', 'drift')) t(subject, finding, level)")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.drift(table(spark, sf_dir, "events").withColumn("extra", F.lit(1)).drop("user_id"), events())


@_query("SELECT count(*) FILTER (WHERE event_type = 'error') AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-12' AND value > 5")
def panel_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.errors(panels.common(table(spark, sf_dir, "events"), events(), "value:>5", "2024-01-03", "2024-01-12"), events())


@_query("SELECT count(DISTINCT user_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-12' AND event_type IN ('view', 'error') AND user_id % 3 NOT IN (1)")
def panel_emitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.common(table(spark, sf_dir, "events"), events(), "", "2024-01-03", "2024-01-12", {"event_type": ["view", "error"]}, {"user_id % 3": [1]})
    return panels.emitting(rows, "user_id")


@_query("SELECT ts AS timestamp, event_type AS body, event_type AS severity, CAST(event_id AS VARCHAR) AS id FROM events WHERE value > 1 ORDER BY ts DESC, event_id LIMIT 1000")
def panel_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.log_lines(matching(table(spark, sf_dir, "events"), events(), "value:>1"), events())


@_query("SELECT coalesce(json_extract_string(props, '$.k'), 'legacy') AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def panel_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.format_variable(table(spark, sf_dir, "events"), events(), "k")


@_query("SELECT '(none)' AS value, CAST(0 AS BIGINT) AS n UNION ALL (SELECT event_type, count(*) FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)")
def panel_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.exclude_variable(table(spark, sf_dir, "events"), "event_type")


@_query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_has('therly')}) AS ranked FROM documents WHERE {_has('of')} OR {_has('therly')} GROUP BY 1")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT lang, count(*) AS n, count_if($__search_score_expr(therly) > 0) AS ranked FROM searched WHERE $__search_score('of OR therly') GROUP BY 1"
    return expand(spark, sql, documents(), table(spark, sf_dir, "documents"))


@_query(
    f"""WITH p AS (SELECT doc_id, unnest({_TOKENS}) AS w, unnest(range(len({_TOKENS}))) AS i FROM documents)
    SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND levenshtein(a.w, 'of') <= 1 AND levenshtein(b.w, 'thet') <= 1"""
)
def fuzzy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(table(spark, sf_dir, "documents"), documents(), "of-thet~1").select("doc_id")


@_query("SELECT page_id FROM pages WHERE regexp_matches(lower(line), '(^|[^a-z0-9_.-])page\\.rs:1[0-9]*([^0-9]|$)')".replace("FROM pages", "FROM (SELECT page_id, 'at page.rs:' || page_id || ' on ' || url AS line FROM pages)"))
def source_file_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("url", F.expr("'at page.rs:' || page_id || ' on ' || url"))
    return matching(rows, pages(), "page.rs:1*").select("page_id")


@_query("SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) = 26")
def bag_typed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load({"table": "e", "default": "m", "fields": [{"name": "m", "column": "event_type", "kind": "text"}], "bags": [{"column": "props", "keys": {"k": "number"}}], "indexes": [{"name": "i", "columns": ["event_type"]}]})
    return matching(table(spark, sf_dir, "events"), schema, "k:26.0").select("event_id")


def _indexed(name: str, source: str, query: str, same_as: str) -> None:
    """Register a search by way of an index, with the SQL of the same search as a scan."""
    make = {"documents": documents, "events": events, "pages": pages}[source]
    key = {"documents": "doc_id", "events": "event_id", "pages": "page_id"}[source]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return index.search_index(rows, make(), index.build(rows, make()), query).select(key)

    _QUERIES[name] = run
    _SQL[name] = _SQL[same_as]


_indexed("index_semi_join", "documents", "therly", "term_token")
_indexed("index_anti_join", "documents", "-of", "exclude_alone")
_indexed("index_or_filter", "documents", "zzzzqq OR lang:en", "absent_or_filter")
_indexed("index_or_negation", "documents", "of OR -that", "or_with_negation")
_indexed("index_phrase", "documents", '"of the"', "phrase_exact")
_indexed("index_slop", "documents", '"of that"~2', "phrase_slop2")
_indexed("index_bag_path", "events", "k:26", "bag_eq")
_indexed("index_ngram", "pages", "*example.org/es*", "wild_spanning")


@_query(_SQL["bm25_top20"])
def index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    found = index.bm25_index(rows, documents(), index.build(rows, documents()), "therly OR thble^2")
    return found.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), documents(), 'lang:en "of the" -zzzzqq n_chars:>300', limit=100, score=True)
