"""Nulls, repeated rows, ties, very long texts, short items and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkseek.llm import decontam, licenses, lm_score, packing, toxicity, url_rules

from .fixtures import documents

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASH = ["a", "b", "left", "right", "words", "found", "item_id", "score", "seed", "positive", "tokens", "rank", "salt", "number", "length", "part", "row_hash", "hash"]


def clashing(df):
    for name in CLASH:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("own"))
    return df


def test_decontamination_judges_every_row_by_itself(spark):
    item = " ".join(WORDS[:14])
    rows = [(None, f"x {item} y", "en", "a"), (None, "a clean text", "en", "a"), (7, f"{item} z", "en", "a"), (7, "another clean text", "en", "a"), (7, f"{item} z", "en", "a"), (8, "word " * 60_000 + item, "en", "a")]
    bench = spark.createDataFrame([("one", item), ("two", "short item"), ("none", None), ("two", "short item"), (None, "omega")], "item_id string, text string")
    docs = clashing(documents(spark, [*rows, (9, "here is a short item too", "en", "a"), (10, "the omega", "en", "a")]))
    found = decontam.contamination(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in found) == [("10", "None"), ("7", "one"), ("7", "one"), ("8", "one"), ("9", "two"), ("9", "two"), ("None", "one")]
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in clean.collect()) == [("7", "another clean text"), ("None", "a clean text")]


def test_decontamination_in_blocks_is_the_same(spark, monkeypatch):
    rng = random.Random(1)
    items = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(20)) for _ in range(12)]
    docs = documents(spark, [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(80)) + (" " + items[i] if i < 12 else ""), "en", "a") for i in range(40)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    key = lambda: sorted((r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect())
    whole = key()
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 5)
    assert key() == whole and {(i, i) for i in range(12)} <= set(whole)
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == set(range(40)) - {d for d, _ in whole}


def test_without_a_toxic_label_nothing_is_toxic(spark):
    docs = clashing(documents(spark))
    for labels in ([], [(i, 1, 0) for i in range(12)], [(None, 1, 1), (3, None, None)]):
        rows = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(rows) == docs.count() and all(r.predicted == 0 and 0 <= r.score < 0.01 for r in rows)
    assert toxicity.toxicity(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_licenses_of_one_family(spark):
    texts = dict(licenses.TEMPLATES)
    rows = [(i, f"before {texts[n]} after", "en", "a") for i, n in enumerate(sorted(texts))]
    names = sorted(texts)
    mit = texts["MIT"].split()
    spread = " ".join(x for w in mit for x in (w, "x"))  # a copy with a word between any two
    rows += [(100, "word " * 77 + spread, "en", "a"), (101, "z " * 200_000 + texts["ISC"], "en", "a"), (102, texts["GPL-2.0"] + " z" * 900 + " " + texts["GPL-3.0"], "en", "a"), (101, texts["ISC"], "en", "a")]
    found = {}
    for r in licenses.licenses(clashing(documents(spark, rows))).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.coverage))
    for i, name in enumerate(names):
        assert (name, 1.0) in found[i], name
        rivals = {n for f in licenses.FAMILIES if name in f for n in f} - {name}
        assert not rivals & {n for n, _ in found[i]}, name
    assert found[100][0][0] == "MIT" and found[100][0][1] >= 0.9 and found[101] == [("ISC", 1.0)] * 2


def test_packing_of_parts_and_clashes(spark, monkeypatch):
    from sparkseek.llm.queries import tokenizer_path

    docs = clashing(documents(spark))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    whole = packing.pack(docs, tokenizer_path(), keep_ids=False)
    want, used = key(whole), whole.select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "PART_PIECES", 3)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    split = packing.pack(docs, tokenizer_path(), keep_ids=False)
    assert key(split) == want and split.select("sequence_id").distinct().count() == used


def test_scores_of_repeats_and_long_texts(spark):
    long = " ".join(WORDS * 4000)
    rows = [(1, "alpha beta gamma", "en", "a"), (1, "alpha beta gamma", "en", "a"), (2, long, "en", "a"), (3, long, "fr", "b"), (None, "alpha", None, None)]
    got = lm_score.pseudo_likelihood(clashing(documents(spark, rows))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 5 and by[1][0] == by[1][1] and by[None][0].n_words == 1
    assert by[2][0].n_words == 80_000 and by[2][0].log_likelihood == pytest.approx(by[3][0].log_likelihood)


def brute_verdicts(pages, rules):
    out = {}
    for page in pages:
        hit = [r.rule_id for r in rules if set(r.tokens) <= set(page.tokens)]
        out[page.page_id] = min(hit, default=None)
    return out


def test_mined_rules_match_every_page_that_holds_their_tokens(spark):
    rng = random.Random(2)
    rows = [(i, f"https://{rng.choice(['a', 'b'])}.org/{rng.choice(['x', 'y', 'z'])}/{i}/{rng.choice(['p', 'q'])}?{rng.choice(['k', 'm'])}=1") for i in range(400)]
    rows += [(1000, None), (1001, "no address"), (1002, "https://a.org/x/1/p?k=" + "1" * 200_000), (3, rows[3][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("token", F.lit("own")).withColumn("rule_id", F.lit("own"))
    bad = lambda u: "/z/" in u and "?k" in u
    labels = spark.createDataFrame([(i, 0 if bad(u) else 1, 0) for i, u in rows[:400]], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels).collect()
    assert len(got) == len(rows)
    host, path = url_rules.host_path(F.col("url"))
    told = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    told = told.withColumn("tokens", F.when(F.col("host") != "", url_rules._tokens(told)).otherwise(F.array().cast("array<string>")))
    rules = url_rules.mine(told, labels).collect()
    want = brute_verdicts(told.collect(), rules)
    assert rules and all(r.mined_rule == want[r.page_id] and r.verdict == ("block" if want[r.page_id] is not None else "allow") for r in got)
    assert all((r.verdict == "block") == bad(dict(rows)[r.page_id]) for r in got if r.page_id < 400)


def test_pipeline_stages_take_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(WORDS[:14]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(80))
    rows = [(None, prose(), None, None), (None, "junk", "en", "a"), (5, prose(), "en", "a"), (5, "junk", "en", "a"), (6, None, "en", "a"), (7, "", "en", "a"), (8, prose() + " " + " ".join(WORDS[:14]), "en", "a")]
    docs = clashing(documents(spark, rows))
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "8", "None"]
    for stage in (corpus_pipeline.line_dedup_stage, corpus_pipeline.near_dedup, corpus_pipeline.decontamination):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left = sorted(str(r.doc_id) for r in out.collect())
        assert left.count("None") >= 1 and ("8" not in left) == (stage is corpus_pipeline.decontamination)
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
