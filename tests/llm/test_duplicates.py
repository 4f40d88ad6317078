import gc
import random
import re
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import common, line_dedup, near_dup
from sparkseek.llm.queries import op3_near_dup, op10_line_dedup

from .fixtures import documents

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingle_set(text, size):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute_components(texts, size):
    sets = {k: shingle_set(t, size) for k, t in texts.items()}
    union = Union()
    keys = [k for k in sorted(sets) if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                union.join(a, b)
    return {k: (len(sets[k]), union.find(k)) for k in texts}


@pytest.mark.parametrize("sf", [SF])
def test_near_duplicates_match_all_pairs(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_near_dup(spark, sf).collect()}
    assert got == brute_components(texts, 2)


def variants(rng, n):
    base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(1, 9)):
            words[at] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(words)


def shared_passage(rng, n):
    """Texts of which a long passage is common, so that many pairs are nearly alike."""
    passage = [f"p{rng.randint(0, 900)}" for _ in range(140)]
    for _ in range(n):
        own = [f"y{rng.randint(0, 10**6)}" for _ in range(rng.randint(15, 30))]
        yield " ".join(passage + own)


def test_a_shared_passage_keeps_every_link(spark):
    rng = random.Random(11)
    texts = dict(enumerate([*shared_passage(rng, 120), *variants(rng, 60)]))
    for i in range(0, 120, 7):
        texts[1000 + i] = texts[i] + " more words"
    rows = [(i, t, "en", "a") for i, t in texts.items()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents(spark, rows), 2).collect()}
    assert got == brute_components(texts, 2)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    test_a_shared_passage_keeps_every_link(spark)


def test_a_large_group_of_variants_keeps_every_link(spark):
    rng = random.Random(7)
    texts = dict(enumerate([*variants(rng, 150), *variants(rng, 40), *(" ".join(f"q{rng.randint(0, 99)}" for _ in range(60)) for _ in range(40))]))
    rows = [(i, t, "en", "a") for i, t in texts.items()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents(spark, rows), 2).collect()}
    assert got == brute_components(texts, 2)


def test_a_searched_bucket_gives_a_link_a_component_only():
    rng = random.Random(5)
    sets = [np.array(sorted({hash(w) % 2**63 for w in zip(x.split(), x.split()[1:])}), np.uint64) for x in [*variants(rng, 90), *shared_passage(rng, 90)]]
    n = len(sets)
    pair = [len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8 for i in range(n) for j in range(i + 1, n)]
    union = Union()
    for (i, j), linked in zip(((i, j) for i in range(n) for j in range(i + 1, n)), pair, strict=True):
        if linked:
            union.join(i, j)
    both, node = [*sets, *sets], np.tile(np.arange(n), 2)
    begin = np.cumsum([0, *map(len, both[:-1])])
    q, t = near_dup._block_links(np.concatenate(both), begin, np.zeros(2 * n), node, np.full(2 * n, -1), node, n)
    got = Union()
    for i, j in zip(node[q].tolist(), node[t].tolist(), strict=True):
        got.join(i, j)
    assert [got.find(i) for i in range(n)] == [union.find(i) for i in range(n)]
    assert len(q) < n < sum(pair)


def test_near_duplicates_awkward_rows(spark):
    rows = near_dup.near_duplicates(documents(spark), 2).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == 13
    assert got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (0, 4, True)
    assert got[6] == (9, 1, False) and got[5] == (1, 5, True) and got[12][1:] == (12, True)
    assert near_dup.near_duplicates(documents(spark, []), 2).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    a, b = near_dup.signature(pool[:2000]), near_dup.signature(pool[500:2500])
    assert abs((a == b).mean() - 0.6) < 0.12


def test_components_of_chains_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (205, 201), (203, 205), (None, 3)]
    random.Random(3).shuffle(chain)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 201: 201, 203: 201, 205: 201}
    empty = spark.createDataFrame([], "src long, dst long")
    assert common.connected_components(empty).collect() == []


def test_components_are_the_same_on_the_driver(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    own = sorted(common.connected_components(edges).collect())
    monkeypatch.setattr(common, "AT_ONCE", 0)
    assert own == sorted(common.connected_components(edges).collect())


def test_few_edges_take_few_steps(spark):
    spark.createDataFrame([(i, i + 1) for i in range(99)], "src long, dst long").createOrReplaceTempView("chain_of_edges")
    spark.sparkContext.setJobGroup("few-edges", "")
    common.connected_components(spark.table("chain_of_edges")).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 12


def test_lines_awkward_rows(spark):
    docs = documents(spark)
    rows = line_dedup.dedup_lines(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in rows} == all_window_lines(texts)
    assert len(rows) == 13 and rows[0].__fields__[: len(docs.columns)] == docs.columns
    got = {r.doc_id: r for r in rows}
    assert (got[8].text, got[8].lines_seen, got[8].lines_dropped) == ("a b\nc d\n", 4, 2)
    assert got[2].text is None and got[3].text == "" and got[4].text == " \n\t "
    assert line_dedup.dedup_lines(documents(spark, [])).collect() == []


def test_lines_clashing_columns(spark):
    docs = documents(spark, [(1, "one two three four five", "en", "a"), (None, "one two three four five", "en", "a"), (2, "one two three four six", "en", "a")])
    names = ["gone", "gone_lines", "text_hash", "text_hash_key", "h", "g", "id", "row", "parts", "pos", "line", "lines_seen", "lines_dropped"]
    for name in names:
        docs = docs.withColumn(name, F.lit("own"))
    rows = line_dedup.dedup_lines(docs)
    assert len(rows.columns) == len(set(rows.columns)) == len(docs.columns)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].lines_dropped == 1 and got[None].lines_dropped == 0 and got[2].gone == got[2].text_hash_key == "own"


def test_fuzzy_lines_keep_the_earliest(spark):
    rng = random.Random(5)
    base = [f"word{rng.randint(0, 10**6)}" for _ in range(40)]
    rows = [(i, "\n".join([" ".join(base[:j] + [f"new{i}"] + base[j + 1 :]), f"own line {i} {rng.random()}"]), "en", "a") for i, j in enumerate(rng.sample(range(40), 12))]
    got = line_dedup.dedup_lines(documents(spark, rows)).orderBy("doc_id").collect()
    assert [r.lines_dropped for r in got] == [0] + [1] * 11


def test_line_dedup_has_no_python_in_its_plan(spark):
    plan = line_dedup.dedup_lines(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("size", [5, 15, 60])
def test_line_bands_find_pairs_near_the_limit(spark, size):
    """Sets of random shingle hashes of similarity 0.8: nearly all such pairs have an equal band."""
    rng = np.random.default_rng(7)
    sides = [0] * (size * 4 // 5) + [1, 2] * (size // 5)
    hashes = rng.integers(-(2**63), 2**63 - 1, (500, size), dtype=np.int64)
    rows = [(pair, side, int(x)) for pair, own in enumerate(hashes) for side, x in zip(sides, own, strict=False)]
    df = spark.createDataFrame(rows, "pair int, side int, x bigint")
    names = [[f"x{q}"] * 2 for q in range(line_dedup.GROUPS)]
    df = df.select("pair", "side", *[line_dedup._turned(F.col("x"), turn).alias(f"x{q}") for q, turn in enumerate(line_dedup._TURNS)])
    signed = lambda gone: df.where(F.col("side") != gone).groupBy("pair").agg(*line_dedup._minima(names)).select("pair", line_dedup._band_keys().alias("keys"))
    both = signed(1).alias("a").join(signed(2).alias("b"), "pair").where(F.arrays_overlap("a.keys", "b.keys"))
    assert both.count() >= 0.98 * 500


def test_short_lines_have_near_copies(spark):
    lines = ["a thonnd in. onwhingon and.", "thonnd in. onwhingon and.", "quite another line", "short", "shore"]
    rows = [(i, line, "en", "a") for i, line in enumerate(lines)]
    got = {r.doc_id: r.lines_dropped for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}


def every_window(line):
    return {line[i : i + 8] for i in range(max(len(line) - 7, 1))}


def all_window_lines(texts):
    """As brute_lines, with the windows at all characters of all lines."""
    normal = lambda x: x.strip(" \t\r\x0b\x0c").lower()
    places, holders, shared, union = {}, {}, {}, Union()
    for doc, text in sorted(texts.items()):
        for pos, line in enumerate((text or "").split("\n")):
            if normal(line):
                places.setdefault(normal(line), (doc, pos))
    sets = {at: every_window(line) for line, at in places.items()}
    for at, windows in sets.items():
        for w in windows:
            holders.setdefault(w, []).append(at)
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            union.join(a, b)
    keep = lambda doc, pos, line: not normal(line) or union.find(places[normal(line)]) == (doc, pos)
    return {doc: None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if keep(doc, i, x)) for doc, text in texts.items()}


def test_lines_match_all_pairs_over_all_windows(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in op10_line_dedup(spark, SF).collect()} == all_window_lines(texts)


def test_lines_that_differ_within_long_words_stay(spark):
    order = "order 1000000{} was paid by customer 2000000{} on the last day of the month of may"
    lines = [order.format(*x) for x in (("0017365", "0931554"), ("9482201", "7118290"))]
    lines += ["ofthonreat ernterea thtieati thlyor thount ingedre, the.", "ofthonreat ernterea thtieati thlyor thount ingedre, ble."]
    lines += ["日本語のテスト😀 " * 3 + x for x in ("abcdefghijklmnopqrstuvwxyz\r0123456789", "abcdefghijklmnopqrstuvwxyz\r012345678x")]
    texts = dict(enumerate(lines))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, [(i, x, "en", "a") for i, x in texts.items()])).collect()}
    assert got == all_window_lines(texts) and [i for i in got if not got[i]] == [3, 5]


def test_only_lines_with_a_copy_leave_the_first_pass(spark):
    rng = random.Random(17)
    own = [" ".join(f"word{rng.randint(0, 10**6)}" for _ in range(12)) for _ in range(300)]
    rows = [(i, "\n".join([x, "found everywhere", *([own[0] + " more"] if i == 7 else [])]), "en", "a") for i, x in enumerate(own)]
    every = line_dedup._lines(documents(spark, rows))
    signed = common.settle(line_dedup._signed(every))
    held = common.settle(line_dedup._held(signed, line_dedup._members(signed)))
    found = line_dedup._found(every, held).collect()
    assert held.count() == 3 and sum(r.line is not None for r in found) <= 4
    assert 302 <= len(found) <= 310 and {r.line for r in found if r.line} >= {own[0], own[0] + " more"}


def test_bit_tables_let_every_member_through(spark):
    for n in (0, 1, 5000, 100_000):
        rows = spark.range(2 * n + 10).select(F.xxhash64("id").alias("h"), (F.col("id") < n).alias("member"))
        got = common.has_bit(rows, "h", common.bit_table(rows.where("member").select("h")))
        let = got.agg(F.count("*"), F.count_if(F.col("member") & F.col("bit")), F.count_if(~F.col("member") & F.col("bit"))).first()
        assert let[0] == 2 * n + 10 and let[1] == n and let[2] <= 0.13 * n + 5


def line_family(rng, n):
    """Copies of one line with from three to thirty words of its hundred replaced."""
    base = [f"word{rng.randint(0, 10**6)}" for _ in range(100)]
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(100), 3 + 27 * i // n):
            words[at] = f"new{rng.randint(0, 10**6)}"
        yield " ".join(words)


def test_tables_of_bits_tell_far_lines_apart_and_lose_no_link(spark):
    lines = dict(enumerate([*line_family(random.Random(3), 80), "short", "shorter", "-" * 300]))
    rows = line_dedup._tables(spark.createDataFrame(list(lines.items()), "node bigint, line string")).collect()
    bits = {r.node: [r[f"w{i}"] % 2**64 for i in range(line_dedup.WORDS)] for r in rows}
    sets = {i: every_window(x) for i, x in lines.items()}
    far = let = 0
    for i in lines:
        for j in range(i):
            shared, windows = len(sets[i] & sets[j]), max(len(lines[i]) - 7, 1) + max(len(lines[j]) - 7, 1)
            near = 180 * sum((x ^ y).bit_count() for x, y in zip(bits[i], bits[j], strict=True)) <= 20 * windows
            alike = shared / (len(sets[i]) + len(sets[j]) - shared)
            assert near or alike < 0.8
            far, let = far + (alike < 0.6), let + (alike < 0.6 and near)
    assert len(bits) == len(lines) and far > 1000 and let < 0.01 * far


def test_an_open_bucket_is_dealt_once_and_loses_no_link(spark):
    lines = dict(enumerate(line_family(random.Random(8), 60), 1))
    texts = spark.createDataFrame([(i, [7, 9], x) for i, x in lines.items()], "node bigint, keys array<bigint>, line string")
    rows = spark.createDataFrame([(7, i, 0.3, i, 1) for i in lines], "key bigint, node bigint, apart double, own bigint, led bigint")
    found = line_dedup._search(rows, texts)
    got = {(r.a, r.b) for r in found.collect()}
    sets = {i: every_window(x) for i, x in lines.items()}
    want = {(i, j) for j in lines for i in range(1, j) if 1.8 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]))}
    assert want and got >= want and len(got) <= 1.3 * len(want) + 5
    dealt = re.findall(r"\n\W*(ReusedExchange|Exchange hashpartitioning\(key|Join|SortMergeJoin|ShuffledHashJoin)", found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    assert "ReusedExchange" in dealt, dealt


def test_files_of_finished_steps_go_before_the_texts_are_dealt(spark, monkeypatch):
    """Only the marked lines are held while the documents are shuffled."""
    held = []
    monkeypatch.setattr(line_dedup, "settle", lambda df: held.append(weakref.ref(out := common.settle(df))) or out)
    rng = random.Random(4)
    rows = [(i, "\n".join([x, "found everywhere"]), "en", "a") for i, x in enumerate(line_family(rng, 30))]
    extra = line_dedup.duplicate_lines(documents(spark, rows))
    gc.collect()
    assert len(held) >= 7 and sum(x() is not None for x in held) <= 1
    assert extra.count() >= 29
