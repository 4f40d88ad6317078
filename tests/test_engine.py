import json
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from sparkseek import cli
from sparkseek import queries as registered
from sparkseek.functions import stemmer, text
from sparkseek.functions.stemmer import stem
from sparkseek.operators import index, introspect
from sparkseek.operators.search import COMPARES, bm25, conform, matching, search
from sparkseek.plans.compiler import CompileError, compile_query, warning_comment
from sparkseek.plans.grammar import And, Bound, Not, Or, Term, parse
from sparkseek.plans.schema import SchemaError, load, preset, preset_names
from sparkseek.sources import loglines
from sparkseek.streaming import ingest

SF = "/root/testdata/sf0.001"
W = Term


@pytest.mark.parametrize(
    "text, tree",
    [
        ("", None), ("  ", None), ("(", None), ("*", None),
        ("a b", And((W("a"), W("b")))), ("a AND b", And((W("a"), W("b")))), ("a && b", And((W("a"), W("b")))), ("+a +b", And((W("a"), W("b")))),
        ("a or b", Or((W("a"), W("b")))), ("a || b c", Or((W("a"), And((W("b"), W("c")))))),
        ("a -b", And((W("a"), Not(W("b"))))), ("a NOT b", And((W("a"), Not(W("b"))))), ("pd-0", W("pd-0")),
        ("a not b", And((W("a"), W("not", operator_word=True), W("b")))), ("or a", And((W("or", operator_word=True), W("a")))), ("a or", W("a")), ("NOT", W("NOT", operator_word=True)),
        ("f:(a OR g:b)", Or((W("a", "f"), W("b", "g")))), ("f:not", W("not", "f")), ("f:*", W("*", "f", "exists")), ("f:> a", W("a")),
        ('"a b"~2^1.5', W("a b", "", "phrase", 2, 1.5)), ("a~", W("a", fuzzy=1)), ("a^2", W("a", boost=2.0)), ("foo^bar", W("foo^bar")),
        ("n:>=5", Bound("n", ("5", True), None)), ("n:[1 TO 9}", Bound("n", ("1", True), ("9", False))), ("n:{* to 9]", Bound("n", None, ("9", True))),
        ("ts:>2026-08-18 22:30:00 x", And((Bound("ts", ("2026-08-18 22:30:00", False), None), W("x")))),
        ('"msg type":v', W("v", "msg type")), ("http://a.com", W("http://a.com")), ("localhost:3000", W("localhost:3000")), ("foo\\:bar", W("foo:bar")), ("/var/log/pods", W("/var/log/pods")), ("/a b/", W("a b", kind="regex")),
    ],
)
def test_readings(text, tree):
    assert parse(text) == tree


def test_parsing_never_raises():
    rng = random.Random(1)
    for text in ("(" * 5000, "NOT " * 5000 + "a", "-(" * 4000, "f:(" * 4000 + "a", "a or (" * 3000):
        parse(text)
    for _ in range(3000):
        parse("".join(rng.choice('ab:"()[]{}/\\-+~^*?<>= TO AND NOT|&') for _ in range(rng.randint(0, 14))))


@pytest.mark.parametrize("word, want", [("truncating", "truncat"), ("unreachable", "unreach"), ("commands", "command"), ("batches", "batch"), ("happily", "happili"), ("relational", "relat"), ("skies", "sky"), ("hopping", "hop"), ("generously", "generous")])
def test_stems(word, want):
    assert stem(word) == want


def test_every_query_matches_its_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    run, sql = registered.queries(), registered.oracle_sql()
    for name, f in run.items():
        df = f(spark, SF)
        rows = df.collect()
        if name not in sql:
            continue
        found = con.execute(sql[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns), name
        plain = lambda v: round(v, 6) if isinstance(v, float) else v
        key = lambda r: tuple(str(plain(r[c])) for c in sorted(names))
        assert sorted(map(key, rows)) == sorted(key(dict(zip(names, r, strict=True))) for r in found.fetchall()), name


LEAVES = ["of", "therly", "-that", '"of the"', '"of the"~3', "th*ly", "lang:en", "lang:e*", "n_chars:>500", "n_chars:[100 TO 900}", "source:*", "/th.re/", "zzzzqq", "of-the", "therly~1", '"|"']


def test_a_search_and_its_negation_partition_the_table(spark):
    schema = registered.documents(("english_stop",))
    df = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*").unionByName(spark.createDataFrame([(-1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    rng = random.Random(2)
    cases = LEAVES + [f"{a} {b}" for a, b in (rng.sample(LEAVES, 2) for _ in range(8))] + [f"({a}) OR ({b})" for a, b in (rng.sample(LEAVES, 2) for _ in range(8))]
    count = lambda q, name: F.count_if(compile_query(q, schema).predicate).alias(name)
    row = df.agg(F.count("*").alias("n"), *[c for i, q in enumerate(cases) for c in (count(q, f"a{i}"), count(f"NOT ({q})", f"b{i}"))]).first()
    for i, q in enumerate(cases):
        assert row[f"a{i}"] + row[f"b{i}"] == row["n"], q


def test_index_and_scan_give_the_same_rows(spark, tmp_path):
    schema = registered.documents(("english_stop",))
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    df = df.unionByName(spark.createDataFrame([(-1, None, None, None, None)], df.schema))
    index.build(df, schema).write(f"{tmp_path}/index", 2)
    held = index.read(spark, f"{tmp_path}/index")
    late = df.unionByName(df.where("doc_id < 9").withColumn("doc_id", F.col("doc_id") + 10**6))
    keys = lambda rows: sorted(r.doc_id for r in rows.select("doc_id").collect())
    for q in ("of the", "-therly", '"of the"~3', '"of ly"', "(ly OR -er) lang:en", "th*ly OR zzzzqq", '-"er of"', "-(of-the)"):
        assert keys(index.search_index(df, schema, held, q)) == keys(matching(df, schema, q)), q
    assert keys(index.search_index(late, schema, held, "-er", fresh=True)) == keys(matching(late, schema, "-er"))


@pytest.mark.parametrize("query", ["nope:1", "text:>5", "lang:x^2", "n_chars:abc", "n_chars:nan", "n_chars:/1/", "text:/(/"])
def test_refusals(spark, query):
    with pytest.raises(CompileError):
        compile_query(query, registered.documents())


@pytest.mark.parametrize("query", ["ts:2024-01-01", "ts:>2024-01", "ts:>2024-01-05T22"])
def test_instants_have_to_be_complete(spark, query):
    with pytest.raises(CompileError):
        compile_query(query, registered.events())


def test_warnings(spark):
    said = lambda q, s: " ".join(compile_query(q, s).warnings)
    stop = registered.documents(("english_stop",))
    assert "stop word" in said("that", stop) and "within one word" in said("th*", stop) and "matched exactly" in said("lang:en~1", stop)
    assert "nothing to rank" in said("-of", stop) and "searched for as a word" in said("a not b", stop)


@pytest.mark.parametrize(
    "change",
    [
        {"fields": []}, {"default": "nope"}, {"default": "b"}, {"time": "b"}, {"severity": "x"}, {"display": ["x"]}, {"time_zone": "8"}, {"indexes": []}, {"indexes": [{"name": "i"}]}, {"bags": [{}]},
        {"bags": [{"column": "k", "keys": {"a": "text"}}]}, {"bags": [{"column": "k"}, {"column": "k"}]}, {"source_file": "n"}, {"other": 1}, {"indexes": [{"name": "i", "columns": ["a"]}, {"name": "j", "columns": ["a"]}]},
    ],
)
def test_bad_descriptors(change):
    good = {"table": "t", "default": "a", "fields": [{"name": "a", "kind": "text"}, {"name": "b", "kind": "string"}, {"name": "n", "kind": "number"}], "indexes": [{"name": "i", "columns": ["a"]}]}
    assert load(good).notes
    with pytest.raises(SchemaError):
        load(good | change)


def test_presets_load():
    assert [preset(n).default for n in preset_names()] == ["msg", "line"]
    assert "bag kv" in preset("k8s-logs").describe()


def test_bags_and_source_files(spark):
    rows = [('{"a.b": "x", "n": "1"}', "m1", "util.go:12"), ('{"a": {"b": "x"}, "n": "no"}', "see util.go:125", "grpcutil.go:12"), (None, None, None), ('{"n": null}', "util.go", "z")]
    df = spark.createDataFrame(rows, "kv string, msg string, source_file string").selectExpr("*", "'x' as line")
    schema = preset("k8s-logs-line")
    count = lambda q: matching(df, schema, q).count()
    assert (count("kv.a.b:x"), count("n:*"), count("n:>0"), count("N:*")) == (2, 3, 1, 0)
    assert (count("util.go:12"), count("util.go:12*"), count("util.go"), count("-util.go")) == (1, 1, 1, 3)


def test_runs_of_fuzzy_tokens_and_approximate_files(spark):
    rows = [("x pd zero", "a.go"), ("pd 1", "util.go"), ("pe 0", "utils.go"), ("the.is here", "the.it"), ("0 pd", "z")]
    df = spark.createDataFrame(rows, "msg string, source_file string").selectExpr("*", "msg as line", "cast(null as string) as kv")
    schema = preset("k8s-logs-line")
    found = lambda q: {r.msg for r in matching(df, schema, q).collect()}
    assert found("msg:pd-0~1") == {"pd 1", "pe 0"} and found("util.go~1") == {"pd 1", "pe 0"}
    # A file name whose words are stop words in part raises nothing; a named field is its tokens.
    assert found("the.is~1") == {"the.is here"} and found("source_file:util.go") == {"pd 1", "pe 0"}


@pytest.mark.parametrize(
    "compare, counts, want",
    [("narrows", (5, 5, None), True), ("narrows", (0, 5, None), False), ("shrinks", (0, 5, None), False), ("shrinks", (5, 5, None), False), ("shrinks", (3, 5, None), True), ("partitions", (3, 5, 2), True), ("partitions", (3, 2, 2), False), ("partitions", (5, 5, 0), False), ("le", (0, 0, None), False)],
)
def test_compares(compare, counts, want):
    assert COMPARES[compare][2](*counts) == want


def test_a_case_without_what_its_compare_needs_is_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").selectExpr("*", "'x' as lang", "'s' as source", "1 as n_chars")
    for case in ({"compare": "eq"}, {"compare": "partitions", "baseline": "a"}, {"compare": "nope"}):
        with pytest.raises(CompileError):
            conform(spark, df, registered.documents(), [{"name": "c", "query": "a"} | case])


def test_score_order(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, "c c c")], "doc_id long, text string").selectExpr("*", "'x' as lang", "'s' as source", "1 as n_chars")
    got = search(df, registered.documents(), "a", score=True).collect()
    assert [int(r.doc_id) for r in got] == [2, 1] and got[0].score > got[1].score


def test_introspection(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    spec = introspect.build(df.withColumnRenamed("event_type", "msg"), "events", ("props",))
    assert load(spec).default == "msg" and spec["time"] == "ts"
    assert introspect.row_key_usable(df, "event_id").first().usable
    assert {r.finding for r in introspect.drift(df.drop("ts"), registered.events(), "0").collect()} >= {"lost column", "digest changed"}


LINES = [
    ('[2026/08/17 18:07:01.790 +00:00] [INFO] [file.rs:123] ["a [b] \\"c\\""] [k=v] ["x y"=z] [k=w] [region 5]', "tidb", "INFO", 'a [b] \\"c\\"', {"k": "w", "x y": "z", "rest_unparsed": "[region 5]"}),
    ('I0818 22:47:56.829767  1 proxier.go:1494] "msg" key=value two="b c"', "klog", "INFO", "msg", {"key": "value", "two": "b c"}),
    ('2026-08-18T23:23:02.394Z\tERROR\tReconciler error\t{"a":1}', "zap", "ERROR", "Reconciler error", {"a": "1"}),
    ("2026-08-18T23:29:49.785247Z  INFO span{..}: target: message", "tracing", "INFO", "span{..}: target: message", {}),
    ('{"level":"warn","msg":"m","ts":"2026-08-18T23:29:49Z","caller":"x.go:1","k":"v"}', "json", "WARN", "m", {"k": "v"}),
    ("plain text", "raw", "UNKNOWN", "plain text", {}),
    ('[2026-08-17T18:07:01Z] [info] [a.go:1] [bare message] [n=1]', "tidb", "INFO", "bare message", {"n": "1"}),
    ("2026-08-18T23:23:02Z\tWARN\tfirst\tsecond\tthird", "zap", "WARN", "first", {"rest_unparsed": "second third"}),
    ("2026-08-18T23:23:02Z\tWARN\tfirst\t{not json", "zap", "WARN", "first", {"rest_unparsed": "{not json"}),
    ('{"Level":"info","Msg":"m","TS":"2026-08-18T23:29:49Z","Logger":"x","k":"v"}', "json", "INFO", "m", {"k": "v"}),
    ('W0818 22:47:56.829767  1 a.go:7] "said \\"it\\"" done k=v', "klog", "WARN", 'said "it', {"done": "true", "k": "v"}),
    ("E0818 22:47:56.829767  1 a.go:7] plain words", "klog", "ERROR", "plain words", {}),
    ("  | indented", "raw", "UNKNOWN", "| indented", {}),
]


def test_log_formats(spark):
    got = loglines.parse_lines(spark.createDataFrame([(x[0],) for x in LINES], "message string")).collect()
    assert [(r.format, r.level, r.msg, r.kv) for r in got] == [x[1:] for x in LINES]
    assert all(r.ts is not None for r in got[:5]) and got[0].source_file == "file.rs:123" and got[4].source_file == "x.go:1"


def test_the_collector_adds_to_the_bag(spark):
    df = spark.createDataFrame([("plain", "c1", "Svc"), ('{"container":"own","k":"v"}', "c2", "")], "message string, container string, app string")
    got = loglines.parse_lines(df, container="container", service="app").collect()
    assert [r.kv for r in got] == [{"container": "c1", "service": "svc", "format": "raw"}, {"container": "own", "k": "v", "format": "json"}]


def test_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join([x[0] for x in LINES] + ["+---+", "| a |"]) + "\n")
    ingest.write(ingest.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(LINES) - 1  # the indented one draws a table


def test_command_line(spark, tmp_path):
    events = f"{SF}/events.parquet"
    spec = {"table": "e", "default": "m", "time": "ts", "fields": [{"name": "m", "column": "event_type", "kind": "text"}, {"name": "ts", "kind": "timestamp"}], "indexes": [{"name": "i", "columns": ["event_type"]}]}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"name": "some", "query": "error", "compare": "nonzero"}, {"name": "none", "query": "error", "compare": "zero"}]}))
    own = [f"--schema={tmp_path}/s.json", f"--table={events}"]
    out, remarks, code = cli.run("compile", [own[0], "-error", "view"], spark)
    assert "array_contains" in out[0] and "!(" in out[0] and "..." not in out[0] and code == 0 and not remarks
    out, _, code = cli.run("sql", [*own, "--limit=3", "-error"], spark)
    assert "nothing to rank" in out[0] and len(out) == 4 and code == 0
    out, remarks, code = cli.run("conform", [*own, f"{tmp_path}/c.json"], spark)
    assert [x[:4] for x in out] == ["PASS", "FAIL"] and code == 1 and remarks == ["1 of 2 passed"]
    assert json.loads(cli.run("schema", [own[0], "--json"], spark)[0][0])["default"] == "m"
    assert any("event_type string" in x for x in cli.run("introspect", [own[1], "probe"], spark)[0])
    assert json.loads(cli.run("introspect", [own[1], "--body=event_type", "build"], spark)[0][0])["default"] == "event_type"
    assert cli.run("introspect", [*own, "verify"], spark)[2] == 1


def test_comments_cannot_be_closed_early():
    assert warning_comment(["a */ b", "c\nd"]) == "/* search: a * / b; c d */" and warning_comment([]) == ""


def test_driver_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_nothing_imports_the_corpus_operators():
    for base, _, names in os.walk("sparkseek"):
        for name in names:
            if name.endswith(".py") and "llm" not in base.split(os.sep):
                assert not re.search(r"\bllm\b", open(os.path.join(base, name)).read()), name


def test_words_with_a_stem_begin_as_they_may():
    rng = random.Random(4)
    ends = [*(x for x, _ in stemmer._STEP_2 + stemmer._STEP_3), *stemmer._STEP_4, "s", "ies", "ied", "sses", "ed", "ing", "edly", "eedly", "y", "e", "ll", "ly", "bl"]
    words = ["".join(rng.choice("abeilnostyz") for _ in range(rng.randint(0, 5))) + "".join(rng.choices(ends, k=rng.randint(1, 3))) for _ in range(40_000)]
    assert [w for w in [*words, *stemmer._EXCEPTIONS, "日本", "x1s", "a"] if not w.startswith(tuple(stemmer.starts(stem(w))))] == []


def test_only_texts_that_may_have_the_stem_go_to_python(spark, monkeypatch):
    stems = registered.documents(("english_stop", "english_stemmer"))
    lines = ["tying a table", "untied tables", "it ties", "he is happily able to table it", "", None, "a tabled tie", "the tablets", "İtying tables"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string")
    whole = {i: [stem(t) for t in text.words(x or "")] for i, x in enumerate(lines)}
    find = lambda q: {r.doc_id for r in matching(docs, stems, q).collect()}
    for word in ("tie", "ti", "tabl", "happili", "abl", "it"):
        query = text.Analyzer(("english_stop", "english_stemmer")).query(word)
        assert find(word) == {i for i, t in whole.items() if query and query[0][1] in t} or not query
    assert find('"table tie"') == {6} and find("able -tie") == {3} and find("-tie") == set(whole) - find("tie")
    plan = matching(docs, stems, "tie")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ArrowEvalPython|Python", plan) and re.search(r"stems\(.*CASE WHEN.*Contains", plan)


def test_scores_of_stems_count_every_form(spark):
    stems = registered.documents(("english_stop", "english_stemmer"))
    docs = spark.createDataFrame([(1, "tables and tables"), (2, "a table of two tabled chairs"), (3, "chairs"), (4, None)], "doc_id int, text string")
    plain = docs.withColumn("text", F.replace(F.replace(F.replace("text", F.lit("tables"), F.lit("tabl")), F.lit("tabled"), F.lit("tabl")), F.lit("table "), F.lit("tabl ")))
    score = lambda rows, schema, q: {r.doc_id: round(r.score, 9) for r in bm25(rows, schema, compile_query(q, schema)).collect()}
    got = score(docs, stems, "tables")
    assert got == score(plain, registered.documents(), "tabl") and got[1] > got[2] > 0 == got[3] == got[4]


def test_a_ranked_token_costs_one_more_pass_at_most(spark, tmp_path):
    spark.createDataFrame([(1, "one two")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    docs, schema = spark.read.parquet(f"{tmp_path}/docs"), registered.documents()

    def passes(query):
        plan = index.bm25_index(docs, schema, index.build(docs, schema), query)._jdf.queryExecution().optimizedPlan().toString()
        return len(re.findall(r"\bRelation\b", plan))

    assert passes("one OR two OR three") <= passes("one OR two") + 1


@pytest.mark.parametrize("filters", [(), ("english_stop",), ("english_stop", "english_stemmer")])
def test_lookups_beside_the_table_are_those_of_the_whole_index(spark, filters):
    lines = ["tying a table", "Untied tables, the tables", "it ties", "", None, "a tabled tie of the tablets", "İt tying the Tables", "skies and sky"]
    docs, schema = spark.createDataFrame(list(enumerate(lines)), "doc_id int, text string"), registered.documents(filters)
    built = index.build(docs, schema)
    whole = index.Index(built.postings, built.lengths, built.bags, built.grams)
    normal = text.Analyzer(filters).normal
    for words in (["tables"], ["the"], ["tying", "it", "sky"], ["absent"]):
        wanted = [normal(w) for w in words]
        (got, sizes), (want, every) = built.lookup("text", wanted), whole.lookup("text", wanted)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        keys = {r.key for r in got.collect()}
        assert {(r.key, r.length) for r in sizes.collect() if r.key in keys} == {(r.key, r.length) for r in every.collect() if r.key in keys}
    score = lambda held: {r.doc_id: round(r.score, 9) for r in index.bm25_index(docs, schema, held, "tables OR ties^2 OR tables^3").collect()}
    compiled = compile_query("tables OR ties^2 OR tables^3", schema)
    want = {r.doc_id: round(r.score, 9) for r in bm25(docs, schema, compiled).where(compiled.predicate).collect()}
    assert score(built) == score(whole) == want and len(want) >= 2


def test_table_art_goes_before_lines_are_taken_to_pieces(spark):
    lines = ["| a | b |", "+---+", '"| quoted |"', ' "|"', "a | b", "", None, "|", '{"msg":"| in json |"}', '[2024/01/05 12:00:00.000 +00:00] [INFO] [a.rs:1] ["| in tidb |"] [k=v]', "2024-01-05T12:00:00.000Z  INFO | in tracing"]
    rows = loglines.parse_lines(spark.createDataFrame(list(enumerate(lines)), "id int, message string"))
    kept = loglines.without_table_art(rows)
    by_message = {r.id for r in rows.collect() if not (r.format == "raw" and r.msg and r.msg[0] in "|+")}
    assert {r.id for r in kept.collect()} == by_message == {3, 4, 5, 6, 8, 9, 10} | ({3} & by_message)
    plan = kept.groupBy("format").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "map_entries" not in plan and "__parts" not in plan
    assert kept.where("id = 8").first().msg == "| in json |"
