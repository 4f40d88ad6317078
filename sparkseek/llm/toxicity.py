"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts drawn from all that may be learned
from are the unlabelled.
A numpy classifier minimises prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives)); where the second risk falls below zero, a step raises it
alone.  The prior is the share of toxic rows among the labelled ones, as labels are
given to documents at random; no label tells the unlabelled apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .textkernel import Words, mix64, slices, utf8

#: Hash buckets of words, and the bounds of the training sample.
BUCKETS = 1 << 18
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
#: Training texts that a word needs to have a strength, and edges of the strengths.
LEAST_TEXTS, EDGES = 4, (1.0, 2.0, 3.0, 4.0)
STEPS, RATE, DECAY = 800, 0.03, 1e-3
#: The log odds of every text where there is nothing to learn from.
NOTHING = -30.0
_MINIMA = 12
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20


def _features(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct buckets of the words of each text, in lower case without punctuation."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        words = Words(_TO_SPACE[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], lower=True)
        buckets = (mix64(words.hash) >> np.uint64(46)).astype(np.int32)
        for i in range(b - a):
            yield np.unique(buckets[words.row_words[i] : words.row_words[i + 1]])


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """``rows`` without copies and near copies: no two share a band of minima."""
    seen: set[tuple] = set()
    out = []
    for row in rows:
        if not len(row):
            continue
        hashes = mix64(row.astype(np.uint64)[:, None] * np.uint64(_MINIMA + 1) + np.arange(_MINIMA, dtype=np.uint64))
        low = hashes.min(axis=0).reshape(-1, 3)
        bands = {(i, *band) for i, band in enumerate(low.tolist())}
        if not bands & seen:
            out.append(row)
        seen |= bands
    return out


class Classifier:
    """Word strengths, then a logistic model of how a text's words spread over them.

    A bucket's strength is the log ratio of its share of positives to its share of
    negatives, the latter from unlabelled texts less the prior times the former; a
    standard error is taken off first, so that rare words stay weak.
    """

    def __init__(self) -> None:
        self.strength = np.zeros(BUCKETS, np.float32)
        self.weight = np.zeros(len(EDGES) + 3)
        self.bias = NOTHING

    def set_strength(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> None:
        p = np.bincount(np.concatenate([*positive, np.empty(0, np.int32)]), minlength=BUCKETS)
        u = np.bincount(np.concatenate([*unlabelled, np.empty(0, np.int32)]), minlength=BUCKETS)
        share = np.maximum(p - np.sqrt(p), 0) / max(len(positive), 1)
        other = np.maximum(u / max(len(unlabelled), 1) - prior * share, 0) + 2 / max(len(unlabelled), 1)
        strength = np.log(np.maximum(share, 1e-9) / other)
        self.strength = np.where((p >= LEAST_TEXTS) & (strength > 0), strength, 0).astype(np.float32)

    def spread(self, rows: list[np.ndarray]) -> np.ndarray:
        """Per text: log counts of words beyond each edge, greatest strength, sum of
        the five greatest, log of the number of words."""
        out = np.zeros((len(rows), len(EDGES) + 3))
        for i, row in enumerate(rows):
            if len(row):
                s = self.strength[row]
                s = np.sort(s[s > 0])[::-1]
                out[i, : len(EDGES)] = np.log1p([(s > e).sum() for e in EDGES])
                out[i, len(EDGES) :] = (s[0] if len(s) else 0, s[:5].sum() / 5, np.log(len(row)) / 5)
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return self._risk(self.spread(rows))

    def _risk(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 0) -> Classifier:
        positive, unlabelled = _distinct(positive), _distinct(unlabelled)
        # Strengths of one half are used on the other, so that they are not flattered.
        xp, xu = [], []
        for part in range(2):
            self.set_strength(positive[part::2], unlabelled[part::2], prior)
            xp.append(self.spread(positive[1 - part :: 2]))
            xu.append(self.spread(unlabelled[1 - part :: 2]))
        xp, xu = np.concatenate(xp), np.concatenate(xu)
        self.set_strength(positive, unlabelled, prior)
        if not len(xp) or not len(xu):
            return self
        self.bias = -1.0
        first, second = np.zeros(len(self.weight) + 1), np.zeros(len(self.weight) + 1)
        for step in range(1, STEPS + 1):
            sp, su = self._risk(xp), self._risk(xu)
            # Logistic losses: -log s for a positive, -log(1 - s) for a negative.
            excess = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
            # Below zero the negative risk is raised and the positive one left out.
            sign, positive_part = (1, sp - 1) if excess >= 0 else (-1, 0.0)
            gp = prior * (positive_part - sign * sp) / len(xp)
            gu = sign * su / len(xu)
            g = np.append(gp @ xp + gu @ xu + DECAY * self.weight, gp.sum() + gu.sum())
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.weight = self.weight - move[:-1]
            self.bias -= float(move[-1])
        return self


def held_out() -> Column:
    """Whether a document is never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame) -> tuple[Classifier, float]:
    """A classifier and the class prior, from rows that are not held out.

    At most MAX_POSITIVE confirmed toxic and MAX_UNLABELLED documents of any kind are
    used, the first of each by a hash of their ids.  Without a positive there is
    nothing to learn and every score is next to 0.  Rows that share a doc_id count
    once in the sample, each with its own text; null texts are empty.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    positive = known.where("toxic = 1").select("doc_id").orderBy(order).limit(MAX_POSITIVE).withColumn("positive", F.lit(True))
    others = docs.where(~held_out()).select("doc_id").distinct()  # positives among them, as the risk assumes
    others = others.orderBy(order).limit(MAX_UNLABELLED).withColumn("positive", F.lit(False))
    sample = positive.unionByName(others)  # MAX_POSITIVE + MAX_UNLABELLED rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_features(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["positive", "words"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "positive").mapInArrow(features, "positive boolean, words array<int>")
    sets: dict[bool, list[np.ndarray]] = {True: [], False: []}
    table = rows.toArrow()
    words = table["words"].combine_chunks()
    for flag, row in zip(table["positive"].to_pylist(), words, strict=True):
        sets[flag].append(row.values.to_numpy())
    if not sets[True] or not sets[False]:
        return Classifier(), prior
    return Classifier().fit(sets[True], sets[False], prior), prior


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score of every row; a text without words gets the bias alone."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(rows).astype(float))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.  Neither labels, nor
    language, source or doc_id are inputs of a score.  Null and empty texts have the
    score of a text without words, repeated rows score alike, a null doc_id is not
    held out, and an empty table gives none.
    """
    bound_batches(docs.sparkSession)
    model, _ = train(docs, labels)
    rows = score(docs, model)
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
