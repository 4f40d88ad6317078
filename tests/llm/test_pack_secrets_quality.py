import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkseek.llm import packing, quality, secrets
from sparkseek.llm.queries import op5_secrets, op7_quality, tokenizer_path

from .fixtures import ROWS, documents

SF = "/root/testdata/sf0.001"


def test_pack_round_trip(spark):
    exact = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(documents(spark), tokenizer_path()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text, *_ in ROWS:
        want = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        copies = sum(1 for x in ROWS if x[0] == doc_id)
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        if copies == 1:
            assert [x for r in pieces for x in r.ids] == want
            assert [r.piece for r in pieces] == list(range(len(pieces)))
            assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert all(r.length == 2048 for r in pieces if r.piece)
        assert len(pieces) == copies * -(-len(want) // 2048)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_ids_are_the_librarys_own():
    exact, fast = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    texts = ["a <|endoftext|> b", "don't  stop\n\n 123 émile ŸȀ ɏ", "x" * 5000, " " * 300 + "\t\t!!??...", "Ünïcode 日本語 🙂 \u0130 ʼn", "\x00\x1f\x7f\xa0 ­"]
    for text in texts:
        assert packing.TextEncoder.ids(fast, text).tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_pack_empty_table(spark):
    assert packing.pack(documents(spark, []), tokenizer_path()).collect() == []


def brute_secrets(text):
    text = text or ""
    spans = []
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    n = Counter(k for _, k, _ in spans)
    joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest()


@pytest.mark.parametrize("make", ["fixture", "table"])
def test_secrets_match_a_plain_scan(spark, make):
    docs = documents(spark) if make == "fixture" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = (secrets.digest(secrets.scan(docs)[1]) if make == "fixture" else op5_secrets(spark, SF)).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute_secrets(texts[r.doc_id]), r.doc_id


def test_secrets_scan_only_what_the_ledger_lacks(spark):
    docs = documents(spark)
    first, all_found = secrets.scan(docs)
    again, found = secrets.scan(docs, first)
    assert again.count() == 0
    key = lambda df: sorted(map(tuple, secrets.digest(df).collect()))
    assert key(found) == key(all_found)
    bumped = tuple(r if r.kind != "hex" else secrets.Rule(r.kind, r.pattern, r.group, r.least, r.hint, 2) for r in secrets.RULES)
    fresh, found = secrets.scan(docs, first, bumped)
    assert {(r.rule, r.version) for r in fresh.collect()} == {("hex", 2)}
    assert key(found) == key(all_found)
    assert secrets.scan(documents(spark, []))[1].count() == 0


def test_secrets_ledger_is_kept_and_extended(spark, tmp_path):
    docs, place = documents(spark), f"{tmp_path}/ledger"
    want = sorted(map(tuple, secrets.digest(secrets.scan(docs)[1]).collect()))
    half = docs.where("doc_id < 8")
    secrets.scan_with_ledger(half, place)
    before = spark.read.parquet(place).count()
    assert sorted(map(tuple, secrets.digest(secrets.scan_with_ledger(docs, place)).collect())) == want
    after = spark.read.parquet(place).count()
    assert after > before
    assert sorted(map(tuple, secrets.digest(secrets.scan_with_ledger(docs, place)).collect())) == want
    assert spark.read.parquet(place).count() == after


def test_a_ledger_row_held_twice_counts_once(spark):
    docs = documents(spark)
    first, found = secrets.scan(docs)
    again = secrets.scan(docs, first.unionByName(first))[1]
    assert sorted(map(tuple, secrets.digest(again).collect())) == sorted(map(tuple, secrets.digest(found).collect()))


def test_secrets_added_kinds(spark):
    docs = documents(spark, [(1, "x -----BEGIN RSA PRIVATE KEY----- y", "en", "a")])
    assert secrets.digest(secrets.scan(docs)[1]).first().spans == "pem:2:33"


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


@pytest.mark.parametrize("make", ["fixture", "table"])
def test_quality_base_statistics(spark, make):
    docs = documents(spark) if make == "fixture" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = (quality.judge(docs) if make == "fixture" else op7_quality(spark, SF)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_rejects_junk_and_keeps_clean(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 300))), "en", f"s{i % 2}") for i in range(500)]
    rows += [(900 + i, " ".join(word() + "###" for _ in range(100)), "en", "s0") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality.judge(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(500)) and not any(kept[900 + i] for i in range(20))


def brute_determinant(x):
    """The estimate of the least determinant from the same starts, on one machine."""
    d, floors = x.shape[1], np.array(quality.FLOORS)
    middle = np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    apart = np.quantile(np.abs(x - middle), 0.5, axis=0, method="inverted_cdf")
    out = []
    for precision in (np.diag(1 / floors**2), np.diag(1 / ((1.4826 * apart) ** 2 + floors**2)), np.zeros((d, d))):
        centre = middle
        for _ in range(quality.STEPS):
            gap = x - centre
            distance = np.einsum("ij,jk,ik->i", gap, precision, gap)
            core = x[distance <= np.quantile(distance, quality.CORE, method="inverted_cdf")]
            centre = core.mean(axis=0)
            scatter = quality.CONSISTENCY * np.cov(core.T, bias=True) + np.diag(floors**2)
            precision = np.linalg.inv(scatter)
        out.append((np.linalg.slogdet(scatter)[1], centre, scatter))
    return min(out, key=lambda o: o[0])[1:]


def test_estimates_match_plain_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [0.3, 2, 0.2] + [1, 5, 0.4]
    x[:40] += [3, 20, 0]
    rows = spark.createDataFrame([(*map(float, r), "en", "a") for r in x], "f_symbols double, f_word_length double, f_repeats double, lang string, source string")
    got = quality.fit(rows).where("level = 0").first()
    centre, scatter = brute_determinant(x)
    assert got.rows == 300 and np.allclose(got.centre, centre, atol=0.02) and np.allclose(np.reshape(got.scatter, (3, 3)), scatter, rtol=0.1, atol=0.02)
    assert abs(quality.CUTOFF - 44.841) < 0.01 and abs(quality.CONSISTENCY - 1.609) < 0.001


def test_small_groups_have_a_verdict_of_the_method(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.integers(60, 200))), ["en", "fr"][i % 2], f"s{i % 30}") for i in range(150)]
    rows += [(900, " ".join(word() + "###" for _ in range(100)), "en", "s0"), (901, " ".join(word() + "###" for _ in range(100)), None, None)]
    kept = {r.doc_id: r.kept for r in quality.judge(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(150)) and not kept[900]


def test_quality_empty_table(spark):
    assert quality.judge(documents(spark, [])).collect() == []
