"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The items' word n-grams are looked up in every document; how many documents hold
each tells the rare ones, which seed candidate places.  A place is scored by local
alignment of the item's words with the words around it, so edited and paraphrased
copies count as far as they agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches
from .textkernel import _ODD, Words, mix64, slices, utf8

#: Words of a seed; documents and items are compared in lower case (A-Z).  A shorter
#: item is a seed as a whole.
SEED = 3
#: A seed is rare in its item if it is among the rarer half of the item's seeds, or
#: in at most one document of RARE_ONE_IN.
RARE_ONE_IN = 1000
#: Alignment scores of a word: match, mismatch, gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A document is contaminated if an alignment reaches this share of a full match.
THRESHOLD = 0.5
#: Items of a block.  A pass over the documents holds one block of items.
BLOCK_ITEMS = 100_000


def _grams(words: np.ndarray, size: int = SEED) -> np.ndarray:
    if len(words) < size or not size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = words[:n] if size == SEED else words[:n] ^ np.uint64(size)
        for i in range(1, size):
            out = mix64(out * _ODD + words[i : i + n])
    return out


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each row."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        for i in range(b - a):
            yield words.hash[words.row_words[i] : words.row_words[i + 1]]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment in ``text``."""
    m, n = len(item), len(text)
    score = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    best = (0, 0, 0)
    steps = GAP * np.arange(n + 1)
    for i in range(m):
        diagonal = score[:-1] + np.where(text == item[i], MATCH, MISMATCH)
        up = score[1:] + GAP
        take = diagonal >= up
        here = np.concatenate(([0], np.maximum(np.where(take, diagonal, up), 0)))
        begin = np.concatenate(([0], np.where(take, start[:-1], start[1:])))
        begin = np.where(here > 0, begin, np.arange(n + 1))
        # Gaps along the text: the running maximum of the score freed of its gap cost.
        free = here - steps
        reach = np.maximum.accumulate(free)
        source = np.maximum.accumulate(np.where(free == reach, np.arange(n + 1), 0))
        score, start = reach + steps, begin[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top)
    return best


class _Items:
    """A block of items, with their seeds sorted by hash."""

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        grams = [_grams(w, min(SEED, len(w))) for w in self.words]
        self.sizes = sorted({min(SEED, len(w)) for w in self.words})
        self.item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        self.at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        self.seeds, self.seed = np.unique(every, return_inverse=True)

    def seeds_in(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, seed numbers) of the seeds found."""
        every = []
        for size in self.sizes:
            grams = _grams(words, size)
            found = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
            places = np.flatnonzero(self.seeds[found] == grams)
            every.append((places, found[places]))
        return tuple(np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *every, strict=True))

    def keep(self, rare: np.ndarray) -> None:
        """Keep the occurrences (item, at) marked rare."""
        self.item, self.at, self.seed = self.item[rare], self.at[rare], self.seed[rare]
        order = np.argsort(self.seed, kind="stable")
        self.item, self.at, self.seed = self.item[order], self.at[order], self.seed[order]
        self.bounds = np.searchsorted(self.seed, np.arange(len(self.seeds) + 1))

    def matches(self, words: np.ndarray) -> Iterator[tuple]:
        """(item id, share of a full match, first word, word after the last)."""
        places, seeds = self.seeds_in(words)
        wanted: dict[int, set[int]] = {}
        for place, seed in zip(places.tolist(), seeds.tolist(), strict=True):
            for k in range(self.bounds[seed], self.bounds[seed + 1]):
                wanted.setdefault(int(self.item[k]), set()).add(place - int(self.at[k]))
        for item, starts in wanted.items():
            own = self.words[item]
            slack = max(8, len(own) // 2)
            best, done = (0.0, 0, 0), -1
            for start in sorted(starts):
                if start <= done:
                    continue
                lo, hi = max(0, start - slack), min(len(words), start + len(own) + 2 * slack)
                done = start + slack  # later starts up to here are inside this window
                window = words[lo:hi]
                # No alignment can match more words than the two have in common.
                if np.isin(own, window).sum() < THRESHOLD * len(own):
                    continue
                score, a, b = align(own, window)
                best = max(best, (score / (MATCH * len(own)), lo + a, lo + b))
            if best[0] >= THRESHOLD:
                yield self.ids[item], *best


def _blocks(benchmark: DataFrame, size: int) -> Iterator[_Items]:
    """The items in blocks; one without words can be in no document."""
    held: list[tuple] = []
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        words = next(_texts(pa.array([row["text"]])))
        if len(words):
            held.append((row["item_id"], words))
        if len(held) == size:
            yield _Items(held)
            held = []
    if held:
        yield _Items(held)


def _document_counts(docs: DataFrame, items: _Items) -> tuple[np.ndarray, int]:
    """In how many documents each seed of the block occurs; how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(items.seeds), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for words in _texts(batch.column(0)):
                total[np.unique(items.seeds_in(words)[1])] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], ["seed", "n"])

    counts = docs.select("text").mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(len(items.seeds), np.int64), 0
    for row in counts.toLocalIterator():  # as many rows as the block has seeds, at most
        if row["seed"] < 0:
            rows = row["n"]
        else:
            out[row["seed"]] = row["n"]
    return out, rows


def _prepared(docs: DataFrame, benchmark: DataFrame) -> Iterator[_Items]:
    """The blocks, each with the seeds that are rare among ``docs``."""
    for items in _blocks(benchmark, BLOCK_ITEMS):
        counts, rows = _document_counts(docs, items)
        each = counts[items.seed]
        order = np.lexsort((each, items.item))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(items.item[order], items.item[order])
        size = np.bincount(items.item, minlength=len(items.ids))[items.item]
        items.keep((2 * rank <= size) | (each * RARE_ONE_IN <= rows))
        yield items


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): every document and item with
    an alignment of THRESHOLD or more, at its best place.

    ``score`` is the alignment score over that of the whole item.  Null and empty
    texts and items match nothing; repeated documents and items give repeated rows;
    ids may be of any type, null too.  Items are held in blocks of BLOCK_ITEMS, each
    with its own pass, so memory stays bounded.  The seeds of a block are the small
    side of the join and go to the tasks as sorted arrays, SEED times eight bytes a
    word; passages are probed where they are read and never shuffled.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word bigint, end_word bigint"
    types = [f.type for f in to_arrow_schema(benchmark.select("item_id").schema)]
    out = spark.createDataFrame([], schema)
    for items in _prepared(docs, benchmark):

        def find(batches: Iterator[pa.RecordBatch], items: _Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[list] = [[], [], [], [], []]
                for doc_id, words in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                    for match in items.matches(words):
                        for column, value in zip(found, (doc_id, *match), strict=True):
                            column.append(value)
                kinds = (batch.column(0).type, *types, pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], ["doc_id", "item_id", "score", "first_word", "end_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(find, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage.  Each row is judged by
    its own text, whatever its doc_id."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    out = docs
    for items in _prepared(docs, benchmark):

        def clean(batches: Iterator[pa.RecordBatch], items: _Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [next(items.matches(words), None) is None for words in _texts(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
