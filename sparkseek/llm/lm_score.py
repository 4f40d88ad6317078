"""Language-model scores by masked pseudo-likelihood.

A small network reads the two words on each side of a masked one and gives the
probability of the word, as that of the way to it in a binary tree; each step
depends on the context.  Frequent words are leaves of their own, all others share
small leaves, in which they go by their counts over the whole corpus.  Every executor task trains on its own share of the windows and the
parameters are averaged, so what is gathered grows with the input but no text
reaches the driver.  A document's score is the sum over its words; the shares of
words beyond the listed ones are joined, once a document and word.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, settle
from .textkernel import Words, mix64, slices, utf8

#: Words that are leaves of their own, slots of all others (a power of two), words
#: that share a leaf below a slot on average, at most, and nodes below the slots.
LISTED, SLOTS, SHARED, BELOW = 65_536, 1024, 16, 65_536
#: The most visited nodes, which a step computes for all its windows by matrix products.
BUSY = 127
#: Buckets of context words, hidden units, words on each side.
CONTEXT, HIDDEN, SIDE = 2048, 16, 2
#: Rounds of averaging, which share all windows out among them; learning rate; windows of a step.
ROUNDS, RATE, BATCH = 2, 0.05, 2048
#: Parameters that travel together when they are averaged.
PIECE = 1024


def _blocks(column: pa.Array) -> Iterator[Words]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        yield Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the exact count of every word of the corpus, by its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _blocks(batch.column(0)):
                found, n = np.unique(words.hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _slot(bits: int) -> Column:
    return F.expr(f"shiftrightunsigned(word, {64 - bits})")


SLOT_BITS = SLOTS.bit_length() - 1


class Steps(NamedTuple):
    """The ways to a batch of words, in three parts.

    The ``busy`` nodes come as a table with a row for each word: twice the column in
    that range, plus the side; the column behind the last stands for no step.  Then
    single steps (``place`` of the word, ``node``, ``side``), of which those of the
    word ``own`` begin at ``first``, and for the words ``rest`` tables of the nodes
    and sides ``below`` their slots.
    """

    busy: slice
    table: np.ndarray
    own: np.ndarray
    first: np.ndarray
    place: np.ndarray
    node: np.ndarray
    side: np.ndarray
    rest: np.ndarray
    below: np.ndarray
    below_side: np.ndarray


class Vocabulary:
    """A Huffman tree over the listed words and the slots of all others.

    Below a slot the tree goes on by ``depth`` bits of the word's hash; ``depth``
    grows with the number of words.  A node's prior is the log odds of its sides'
    counts.  Words of one leaf below a slot go by their counts.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, slots: np.ndarray, slot_counts: np.ndarray, depth: int):
        order = np.argsort(words)
        self.words, self.depth = words[order], depth
        self.slot_leaf = np.zeros(SLOTS, np.int64)
        self.slot_leaf[slots] = len(words) + np.arange(len(slots))
        weight = np.concatenate((counts[order], slot_counts)).astype(float)
        n = len(weight)
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        total = np.concatenate((weight, np.zeros(max(n - 1, 0))))
        up, right = np.full(len(total), -1), np.zeros(len(total), bool)
        odds = np.zeros(max(n - 1, 0))
        for node in range(n, 2 * n - 1):
            (x, i), (y, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i] = up[j] = node
            right[j] = True
            odds[node - n] = np.log(y / x)
            heapq.heappush(heap, (x + y, node))
        nodes, sides, at = [], [], np.arange(n)
        while len(at) and (up[at] >= 0).any():  # as often as the tree is deep
            nodes.append(up[at] - n)
            sides.append(right[at])
            at = np.where(up[at] >= 0, up[at], at)
        nodes, sides = (np.array(x).reshape(len(nodes), n).T for x in (nodes, sides))
        self.inner = len(odds)
        # Nodes are made from the least to the most visited one, so a way ends in its busy part.
        self.busy = slice(max(0, self.inner - BUSY), self.inner)
        code = 2 * nodes + sides
        on = nodes >= self.busy.start
        pad = 2 * (self.busy.stop - self.busy.start)
        table = np.sort(np.where(on, code - 2 * self.busy.start, pad), axis=1)  # no step comes last
        self.table = np.ascontiguousarray(table[:, : on.sum(axis=1).max(initial=0)], np.int16)
        on = (nodes >= 0) & ~on
        self.length = on.sum(axis=1)
        self.begin = np.cumsum(self.length) - self.length
        self.code = code[on].astype(np.int32)
        self.prior = np.concatenate((odds, np.zeros(BELOW if depth else 0))).astype(np.float32)

    def listed(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each word in the Huffman tree, and whether the word is listed."""
        leaf = self.slot_leaf[(words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        if not len(self.words):
            return leaf, np.zeros(len(words), bool)
        # Words are hashes: few listed ones share their first 18 bits.
        n = np.bincount((self.words >> np.uint64(46)).astype(np.int64), minlength=1 << 18)
        at = (np.cumsum(n) - n).take((words >> np.uint64(46)).astype(np.int64))
        np.minimum(at, len(self.words) - 1, out=at)
        for _ in range(n.max() - 1):
            at += self.words.take(at) < words
            np.minimum(at, len(self.words) - 1, out=at)
        hit = self.words.take(at) == words
        return np.where(hit, at, leaf), hit

    def paths(self, words: np.ndarray, leaf: np.ndarray, hit: np.ndarray) -> Steps:
        """All steps to each word."""
        length = self.length.take(leaf)
        first = np.cumsum(length) - length
        place = np.repeat(np.arange(len(words)), length)
        code = self.code.take(np.arange(len(place)) + (self.begin.take(leaf) - first).take(place))
        own = np.flatnonzero(length)
        rest = np.flatnonzero(~hit) if self.depth else np.empty(0, np.int64)
        t = np.arange(1, self.depth + 1, dtype=np.uint64)
        prefix = words[rest, None] >> (np.uint64(64 - SLOT_BITS) - t)
        below = mix64((prefix >> np.uint64(1)) * np.uint64(64) + t) % np.uint64(BELOW)
        table = self.table.take(leaf, 0).astype(np.int64)
        return Steps(self.busy, table, own, first[own], place, (code >> 1).astype(np.int64), (code & 1).astype(np.float32), rest, self.inner + below.astype(np.int64), (prefix & np.uint64(1)).astype(np.float32))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The tree, and (word, log_share) of every word beyond the list: the exact
    share of its count in its leaf's."""
    listed = counts.orderBy(F.desc("n"), "word").limit(LISTED).toArrow()  # LISTED rows at most
    words, n = listed["word"].to_numpy(), listed["n"].to_numpy()
    rest = counts.where(F.lit(False))
    if len(n) == LISTED:
        edge, last = int(n[-1]), int(words[n == n[-1]].max())
        rest = counts.where((F.col("n") < edge) | ((F.col("n") == edge) & (F.col("word") > last)))
    slots = rest.groupBy(_slot(SLOT_BITS).alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).orderBy("slot").collect()
    others = sum(row["words"] for row in slots)
    depth = max(0, int(np.ceil(np.log2(max(others, 1) / SLOTS / SHARED))))
    leaf = rest.select("word", "n", _slot(SLOT_BITS + depth).alias("leaf"))
    shares = leaf.join(leaf.groupBy("leaf").agg(F.sum("n").alias("total")), "leaf").select("word", (F.log("n") - F.log("total")).alias("log_share"))
    tree = Vocabulary(words.view(np.uint64), n, np.array([r["slot"] for r in slots], np.int64), np.array([r["n"] for r in slots], np.int64), depth)
    return tree, shares


def _pairs(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as rows of half as many pairs, which numpy adds at once."""
    return rows.view(np.complex64)


def _at(rows: np.ndarray) -> np.ndarray:
    """Places of the pairs of some rows of hidden units in the flat table."""
    return (rows.reshape(-1, 1) * (HIDDEN // 2) + np.arange(HIDDEN // 2)).reshape(-1)


class Network:
    """One table of hidden inputs per context place, then a logistic unit per node
    of the vocabulary's tree."""

    def __init__(self, prior: np.ndarray, flat: np.ndarray | None = None, seed: int = 0):
        shapes = ((2 * SIDE, CONTEXT + 1, HIDDEN), (HIDDEN,), (len(prior), HIDDEN), (len(prior),))
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            flat = np.concatenate((np.random.default_rng(seed).normal(0, 0.1, sum(sizes[:3])), prior))
        ends = np.cumsum(sizes)
        self.flat = flat.astype(np.float32)
        self.table, self.shift, self.out, self.prior = (self.flat[e - s : e].reshape(shape) for e, s, shape in zip(ends, sizes, shapes, strict=True))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Hidden units for (n, 2 * SIDE) buckets."""
        places = np.ascontiguousarray(context.T, np.intp)
        h = self.shift + self.table[0].take(places[0], 0)
        for p in range(1, 2 * SIDE):
            h += self.table[p].take(places[p], 0)
        return np.tanh(h)

    def busy(self, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
        """Units and priors of the busy nodes, and a last one that is surely passed on the left."""
        n = steps.busy.stop - steps.busy.start
        out, prior = np.zeros((n + 1, HIDDEN), np.float32), np.full(n + 1, -100, np.float32)
        out[:n], prior[:n] = self.out[steps.busy], self.prior[steps.busy]
        return out, prior

    def score(self, context: np.ndarray, steps: Steps) -> np.ndarray:
        """Log probability of the leaf at the end of each window's path."""

        def cost(z: np.ndarray, side: np.ndarray) -> np.ndarray:
            return np.log(1 + np.exp(np.clip(z * (1 - 2 * side), -30, 80)))

        h = self.hidden(context)
        out, prior = self.busy(steps)
        column = steps.table >> 1
        z = (h @ out.T).reshape(-1).take(column + len(prior) * np.arange(len(h))[:, None]) + prior.take(column)
        total = cost(z, (steps.table & 1).astype(np.float32)).sum(axis=1, dtype=float)
        z = np.einsum("ij,ij->i", self.out.take(steps.node, 0), h.take(steps.place, 0)) + self.prior.take(steps.node)
        total += np.bincount(steps.place, cost(z, steps.side), minlength=len(h))
        z = np.einsum("ijk,ik->ij", self.out.take(steps.below, 0), h.take(steps.rest, 0)) + self.prior.take(steps.below)
        total[steps.rest] += cost(z, steps.below_side).sum(axis=1, dtype=float)
        return -total

    def step(self, context: np.ndarray, steps: Steps) -> None:
        if not len(context):
            return

        def slope(z: np.ndarray, side: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(z, -30, 30))) - side

        h = self.hidden(context)
        out, prior = self.busy(steps)
        column = steps.table >> 1
        at = column + len(prior) * np.arange(len(h))[:, None]
        z = (h @ out.T).reshape(-1).take(at) + prior.take(column)
        busy = np.zeros((len(h), len(prior)), np.float32)
        busy.reshape(-1)[at] = slope(z, (steps.table & 1).astype(np.float32))
        back = busy @ out

        weights, inputs = self.out.take(steps.node, 0), h.take(steps.place, 0)
        single = slope(np.einsum("ij,ij->i", weights, inputs) + self.prior.take(steps.node), steps.side)
        if len(single):
            weights *= single[:, None]
            back[steps.own] += np.add.reduceat(_pairs(weights), steps.first).view(np.float32)

        weights, own = self.out.take(steps.below, 0), h.take(steps.rest, 0)
        below = slope(np.einsum("ijk,ik->ij", weights, own) + self.prior.take(steps.below), steps.below_side)
        back[steps.rest] += np.einsum("ij,ijk->ik", below, weights)

        back *= (1 - h * h) / len(h)

        # Seldom visited nodes take smaller steps, as one visit says little.
        visits = np.bincount(column.reshape(-1), minlength=len(prior))[:-1]
        rate = (RATE * 10 / (visits + 8)).astype(np.float32)
        self.out[steps.busy] -= (h.T @ busy).T[:-1] * rate[:, None]
        self.prior[steps.busy] -= (np.ones(len(h), np.float32) @ busy)[:-1] * rate
        node = np.concatenate((steps.node, steps.below.reshape(-1)))
        if len(node):
            visits = np.bincount(node).take(node)
            single = np.concatenate((single, below.reshape(-1))) * (RATE * 10 / (visits + 8)).astype(np.float32)
            inputs = np.concatenate((inputs, np.repeat(own, steps.below.shape[1], axis=0)))
            inputs *= single[:, None]
            np.subtract.at(_pairs(self.out).reshape(-1), _at(node), _pairs(inputs).reshape(-1))
            np.subtract.at(self.prior, node, single)
        self.shift -= RATE * 10 * back.sum(axis=0)
        back *= RATE * 200
        for p in range(2 * SIDE):
            np.subtract.at(_pairs(self.table[p]).reshape(-1), _at(context[:, p].astype(np.intp)), _pairs(back).reshape(-1))


def _contexts(words: Words) -> np.ndarray:
    """Context buckets of every word; beyond a text's ends the extra bucket."""
    n = len(words.hash)
    bucket = (mix64(words.hash) % np.uint64(CONTEXT)).astype(np.int32)
    row = np.repeat(np.arange(len(words.row_words) - 1), np.diff(words.row_words))
    out = np.full((n, 2 * SIDE), CONTEXT, np.int32)
    for p, gap in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -gap), n - max(0, gap)
        if a < b:
            same = row[a:b] == row[a + gap : b + gap]
            out[a:b, p] = np.where(same, bucket[a + gap : b + gap], CONTEXT)
    return out


def _picked(words: Words, turn: int) -> np.ndarray:
    """The windows of a round: every ROUNDS-th word of each text, so that the rounds hold each word once."""
    at = np.arange(len(words.hash)) - np.repeat(words.row_words[:-1], np.diff(words.row_words))
    return np.flatnonzero(at % ROUNDS == turn)


def train(docs: DataFrame, words: Vocabulary) -> Network:
    """Parameters averaged over all tasks, weighted by their windows."""
    model = Network(words.prior)
    for turn in range(ROUNDS):
        flat = model.flat

        def fit(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, turn: int = turn) -> Iterator[pa.RecordBatch]:
            own, seen = Network(words.prior, flat), 0
            for batch in batches:
                for block in _blocks(batch.column(0)):
                    picked = _picked(block, turn)
                    if not len(picked):
                        continue
                    order = picked[np.random.default_rng(0).permutation(len(picked))]
                    context, target = _contexts(block).take(order, 0), block.hash[order]
                    leaf, listed = words.listed(target)
                    for at in range(0, len(order), BATCH):
                        some = slice(at, at + BATCH)
                        own.step(context[some], words.paths(target[some], leaf[some], listed[some]))
                    seen += len(picked)
            if seen:
                gap = (own.flat - flat) * np.float32(seen)
                at = [i for i in range(0, len(gap), PIECE) if gap[i : i + PIECE].any()]
                yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([np.float64(seen).tobytes(), *(gap[i : i + PIECE].tobytes() for i in at)], pa.binary())], ["at", "sums"])

        def add(table: pa.Table) -> pa.Table:
            at = table["at"][0].as_py()
            total = sum(np.frombuffer(x.as_py(), np.float64 if at < 0 else np.float32).astype(float) for x in table["sums"])
            return pa.table({"at": pa.array([at], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

        sums = docs.select("text").mapInArrow(fit, "at bigint, sums binary").groupBy("at").applyInArrow(add, "at bigint, sums binary").toArrow()
        found = dict(zip(sums["at"].to_pylist(), sums["sums"].to_pylist(), strict=True))  # one row per PIECE parameters
        if found:
            seen = np.frombuffer(found.pop(-1))[0]
            new = flat.astype(float)
            for at, total in found.items():
                new[at : at + PIECE] += np.frombuffer(total) / seen
            model = Network(words.prior, new)
    return model


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood of every row.

    Texts without words have 0 words, a sum of 0.0 and a null mean.  Repeated rows
    score alike.
    """
    bound_batches(docs.sparkSession)
    word_n = settle(word_counts(docs))
    words, shares = vocabulary(word_n)
    flat = train(docs, words).flat

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(words.prior, flat)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, sums, at_row, others, times = [], [], [], [], []
            for block in _blocks(batch.column(1)):
                n = len(block.hash)
                leaf, listed = words.listed(block.hash)
                total, context = np.empty(n), _contexts(block)
                for at in range(0, n, BATCH):
                    part = slice(at, at + BATCH)
                    total[part] = model.score(context[part], words.paths(block.hash[part], leaf[part], listed[part]))
                running = np.concatenate(([0.0], np.cumsum(total)))
                counts.append(np.diff(block.row_words))
                sums.append(np.diff(running[block.row_words]))
                begin = row
                row += len(block.row_words) - 1
                # Words beyond the list, once a row, for the join with their counts.
                place = np.repeat(np.arange(begin, row), np.diff(block.row_words))[~listed]
                word = block.hash[~listed]
                order = np.lexsort((word, place))
                place, word = place[order], word[order]
                first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (word[1:] != word[:-1])))[: len(word)])
                at_row.append(place[first])
                others.append(word[first].view(np.int64))
                times.append(np.diff(np.append(first, len(word))))
            if not batch.num_rows:
                continue
            counts, sums, at_row, others, times = (np.concatenate(x) for x in (counts, sums, at_row, others, times))
            heads = np.arange(row - batch.num_rows, row)
            # A row's own record has no word, but a hash to spread it by.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(heads, at_row)),
                    pa.array(np.append(mix64(heads.astype(np.uint64)).view(np.int64), others)),
                    pa.array(np.append(np.zeros(len(heads), np.int64), times)),
                    pa.concat_arrays([batch.column(0), pa.nulls(len(times), batch.column(0).type)]),
                    pa.array(np.append(counts, np.zeros(len(times), np.int64)).astype(np.int64)),
                    pa.array(np.append(sums, np.zeros(len(times)))),
                ],
                ["row", "word", "times", "doc_id", "n_words", "part"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(scored, f"row bigint, word bigint, times bigint, doc_id {kind}, n_words bigint, part double")
    rows = rows.join(shares, "word", "left")
    # log_share is null only for a row's own record, whose hash is no word.
    value = F.col("part") + F.col("times") * F.when(F.col("times") > 0, F.col("log_share")).otherwise(0.0)
    rows = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum(value).alias("log_likelihood")).drop("row")
    return rows.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
