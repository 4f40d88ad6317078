"""Near-duplicate documents by circulant MinHash.

Two permutations give all coordinates of a signature: the first scatters the
shingles over a circle of 2**32 places, the second is read from as many starting
points as there are coordinates, each shifted by one place.  Documents with equal
shingle sets form classes; the class representatives are banded, candidate pairs
are confirmed on full shingle sets, and links are joined into components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, settle
from .linking import PERCENT, RING, link
from .textkernel import Words, mix64, shingles, slices, utf8

#: Bands and rows of a band: a pair of similarity 0.8 shares no band with
#: probability (1 - 0.8**5)**32, three in a million.
BANDS, ROWS = 32, 5
#: Rows of a block when a bucket is searched.
BLOCK = 2048
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit places, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set of mixed 64-bit shingle hashes."""
    places = (mix64(shingle_set ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_SHIFTS), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(places), 512):
        np.minimum(out, _second(places[at : at + 512, None] - _SHIFTS[None, :]).min(axis=0), out=out)
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        for i in range(b - a):
            yield shingles(words.hash[words.row_words[i] : words.row_words[i + 1]], size)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, band keys; no words: nulls."""
    bound_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys = [], [], []
            for found in _sets(batch.column(1), size):
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(bands(signature(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def _compare(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Sizes of intersection and union of the full shingle sets of each pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            shared, either = [], []
            keys = batch.column(0).to_pylist()
            for i, (key, right) in enumerate(zip(keys, _sets(batch.column(3), size), strict=True)):
                if key != last or left is None:
                    last, left = key, next(_sets(batch.column(2).slice(i, 1), size))
                n = len(np.intersect1d(left, right, assume_unique=True))
                shared.append(n)
                either.append(len(left) + len(right) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "shared", "either"])

    kind = texts.schema["node"].dataType.simpleString()
    rows = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    return rows.select("a", "b", "left", "right").mapInArrow(compare, f"a {kind}, b {kind}, shared bigint, either bigint")


def _block_links(flat: np.ndarray, begin: np.ndarray, apart: np.ndarray, own: np.ndarray, led: np.ndarray, node: np.ndarray, queries: int) -> tuple:
    """Places of query and target of links that join all components of the block
    that any link joins; queries come first.  ``flat`` has the sets one after the
    other, each from its ``begin`` on."""
    size = np.diff(np.append(begin, len(flat)))
    code = np.unique(flat, return_inverse=True)[1]
    marked = np.zeros(len(flat), bool)
    inside, own, found = own == led, own.copy(), []
    for q in range(queries):
        t = np.arange(queries, len(node))
        t = t[(own[t] != own[q]) & (np.abs(apart[t] - apart[q]) <= RING) & (inside[t] | (node[q] < node[t]))]
        t = t[100 * np.minimum(size[t], size[q]) >= PERCENT * np.maximum(size[t], size[q])]
        if not len(t):
            continue
        mine = code[begin[q] : begin[q] + size[q]]
        marked[mine] = True
        first = np.cumsum(size[t]) - size[t]
        at = np.arange(size[t].sum()) + np.repeat(begin[t] - first, size[t])
        shared = np.add.reduceat(marked[code[at]], first, dtype=np.int64)
        marked[mine] = False
        t = t[100 * shared >= PERCENT * (size[t] + size[q] - shared)]
        for joined, x in zip(*np.unique(own[t], return_index=True), strict=True):
            found.append((q, t[x]))
            own[own == joined] = own[q]
    return tuple(np.array(found, int).reshape(-1, 2).T)


def _search(rows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links (a, b) left to find: in each bucket with members outside the leader's
    component, these against all members, in blocks, by their full sets.  A block
    gives a link for each two components that it joins, so at most one a member."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in _sets(batch.column(1), size)], pa.binary())], ["node", "hashes"])

    hot = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("own") != F.col("led")).alias("open")).where("open")
    rows = rows.join(hot.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key")
    wanted = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "text")
    rows = rows.join(wanted.mapInArrow(full, f"node {texts.schema['node'].dataType.simpleString()}, hashes binary"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["key", "i", "j", "role", "node", "own", "led", "apart", "hashes"]
    # A query meets each block, and each query's block meets all others.
    asked = F.struct(F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("role"))
    meant = F.struct(F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("role"))
    rows = rows.withColumn("as", F.explode(F.when(F.col("own") != F.col("led"), F.array(asked, meant)).otherwise(F.array(meant)))).select("*", "as.*")
    rows = rows.select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(table: pa.Table) -> pa.RecordBatch:
            value = {c: table[c].to_numpy() for c in names[:8]}
            sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
            a, b = [], []
            edge = np.flatnonzero((np.diff(value["key"]) != 0) | (np.diff(value["i"]) != 0) | (np.diff(value["j"]) != 0)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(sets)], strict=True):
                queries = int((value["role"][lo:hi] == 0).sum())
                begin = np.cumsum([0, *map(len, sets[lo : hi - 1])])
                q, t = _block_links(np.concatenate(sets[lo:hi]), begin, *(value[c][lo:hi] for c in ("apart", "own", "led", "node")), queries)
                a.append(np.minimum(value["node"][lo + q], value["node"][lo + t]))
                b.append(np.maximum(value["node"][lo + q], value["node"][lo + t]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = np.stack([held[c].to_numpy() for c in names[:3]])
            edge = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0))
            if len(edge):  # the last group may go on in the next batch
                yield close(held.slice(0, int(edge[-1]) + 1))
                held = held.slice(int(edge[-1]) + 1)
        if held is not None and held.num_rows:
            yield close(held)

    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every row of ``docs``.

    Words are lower-cased (A-Z) and ``size`` words make a shingle; documents are
    linked if their sets' Jaccard similarity is 0.8 or more.  ``class_id`` is the
    least doc_id with the same set, ``component_id`` the least one reachable over
    links.  Null and wordless texts have no shingle, are linked with nothing and
    kept.  Rows that share a doc_id are one document; a null doc_id is linked
    with nothing and kept.
    """
    signed = settle(signatures(docs, size))
    real = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = settle(real.groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    heads = real.join(classes, (real["doc_id"] == classes["class_id"]) & (real["digest"] == classes["digest"]))
    heads = heads.select(F.col("doc_id").alias("node"), "bands").distinct()
    keys = heads.select(F.explode("bands").alias("key"), "node")
    buckets = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    members = settle(keys.join(buckets, "key"))
    involved = members.select("node").distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(involved, "node", "left_semi")
    texts = settle(texts.dropDuplicates(["node"]))
    found = link(members, lambda pairs: _compare(pairs, texts, size), lambda rows: _search(rows, texts, size))
    named = signed.join(classes, "digest", "left").join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    # Texts of one doc_id may differ; the document has the least of their components.
    component = F.least(F.coalesce("component", "class_id", "doc_id"), F.col("doc_id"))
    return named.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
