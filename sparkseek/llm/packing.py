"""Best-fit packing of tokenised documents into fixed-length sequences.

Lengths are whole numbers up to the capacity, so a packing problem of any size
is a histogram of at most ``capacity`` counts.  The driver solves that histogram
(Martello-Toth dominance reduction, then best fit in decreasing order) into a
placement table of runs; the executors number the pieces of each length and look
their places up.  No list of documents leaves the executors.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, settle

CAPACITY = 2048
#: Pieces of one length are numbered in parts of about so many pieces, split by a hash.
PART_PIECES = 1 << 18
#: Rows of the placement tables up to which they are broadcast, 64 bytes each.
BROADCAST_ROWS = 1 << 18

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters the two libraries' Unicode tables may differ.
_UNCOMMON = re.compile("[^\t\n\r -~À-ɏ]")


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TextEncoder:
    """Ids of a byte-level BPE vocabulary file, as the ``tokenizers`` library gives
    them without added special tokens; a special string in a text is its token.

    Common Latin text without such a string goes through the faster of two engines
    that share the file's vocabulary; any other text through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = [x["content"] for x in spec.get("added_tokens", [])]
        special = {x["content"] for x in spec.get("added_tokens", []) if x.get("special")}
        self._uncommon = re.compile("|".join([_UNCOMMON.pattern, *map(re.escape, added)]))
        symbols = _bytes_of_symbols()
        ranks = {bytes(symbols[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self._fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._uncommon.search(text):
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32[, ids].

    A document is its ids followed by ``end_id``.  One longer than ``capacity``
    is cut into whole pieces of ``capacity`` ids after a first piece with the
    remainder.  Null or empty text is the single id ``end_id``.  Repeated rows
    are documents of their own; other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).ids
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (start, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = ids[start:end]
                    row = (doc_id, piece, start, end - start, zlib.crc32(part.tobytes()), part.view(np.int32) if keep_ids else None)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names[:n])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


class _Lengths:
    """Counts of the lengths not placed yet, with their sorted keys."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.taken = dict.fromkeys(self.left, 0)
        self.keys = sorted(self.left)

    def take(self, length: int, n: int) -> int:
        """Take n pieces; their first number among those of this length."""
        first = self.taken[length]
        self.taken[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.keys.pop(bisect_left(self.keys, length))
        return first


def _dominant(lengths: _Lengths, j: int, room: int) -> list[int] | None:
    """The lengths that dominate all others with one piece of length ``j`` and
    ``room`` beside it; None if no set does.

    One set dominates another if the other's pieces can be shared out among its
    own without overfilling any of them.
    """

    def count(x: int) -> int:
        return lengths.left.get(x, 0) - (x == j)

    if room == 0 or count(room) > 0:
        return [room] if room else []
    keys = [x for x in lengths.keys[: bisect_right(lengths.keys, room)] if count(x) > 0]
    if not keys:
        return []
    best = keys[-1]
    smallest = [x for x in keys[:3] for _ in range(min(count(x), 3))][:3]
    if len(smallest) < 2 or sum(smallest[:2]) > room:
        return [best]  # no two fit beside j
    if len(smallest) > 2 and sum(smallest) <= room:
        return None  # three may fit: not decided
    # Pairs at most.  The greatest sum of two that fit, by two pointers.
    low, high, top = 0, len(keys) - 1, 0
    while low <= high:
        pair = keys[low] + keys[high]
        if pair > room or (low == high and count(keys[low]) < 2):
            high -= 1
        else:
            top = max(top, pair)
            low += 1
    if best >= top:
        return [best]
    # The largest with the largest beside it: dominates if no two above that one fit.
    beside = next((x for x in reversed(keys) if best + x <= room and (x != best or count(x) > 1)), None)
    if beside is None:
        return None
    above = [x for x in keys if x > beside][:2]
    two = [x for x in above for _ in range(min(count(x), 2))][:2]
    return None if len(two) > 1 and sum(two) <= room else [best, beside]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Place ``counts[length]`` pieces of each length.

    Returns runs (length, first, last, sequence, per, offset) and the number of
    sequences: piece number r of a length, with first <= r < last, goes to
    sequence + (r - first) // per at offset + (r - first) % per * length.
    """
    lengths, runs, sequences = _Lengths(counts), [], 0

    def fix(parts: list[int], bins: int) -> None:
        """Fill ``bins`` new sequences with one piece of each of ``parts``."""
        nonlocal sequences
        at = 0
        for length in parts:
            first = lengths.take(length, bins)
            runs.append((length, first, first + bins, sequences, 1, at))
            at += length
        sequences += bins

    # Dominance: of the sets that a piece j can be with, one that is no worse than
    # every other is fixed for good; then the smaller instance is looked at again.
    changed = True
    while changed:
        changed = False
        for j in sorted(lengths.left, reverse=True):
            while j in lengths.left and (found := _dominant(lengths, j, capacity - j)) is not None:
                parts = [j, *found]
                fix(parts, min(lengths.left[x] // parts.count(x) for x in parts))
                changed = True

    # Best fit, decreasing; groups of alike sequences move as one.
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, last: int) -> None:
        if first < last and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, last))

    for length in sorted(lengths.left, reverse=True):
        while length in lengths.left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, last = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, first = capacity, sequences
                last = first + -(-lengths.left[length] // (capacity // length))
                sequences = last
            per = room // length
            n = min(lengths.left[length], per * (last - first))
            full, rest = divmod(n, per)
            number = lengths.take(length, n)
            if full:
                runs.append((length, number, number + full * per, first, per, capacity - room))
                put(room - per * length, first, first + full)
            if rest:
                runs.append((length, number + full * per, number + n, first + full, per, capacity - room))
                put(room - rest * length, first + full, first + full + 1)
            put(room, first + full + bool(rest), last)
    return runs, sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Every piece of ``docs`` with its place: the columns of
    :func:`tokenize_pieces` and sequence_id, offset.

    Sequences hold at most ``capacity`` ids and have no gap from offset 0.  An
    empty table gives no row.  Pieces of one length are interchangeable; they are
    numbered by document and piece, so the result is the same on every run.
    """
    spark = docs.sparkSession
    pieces = settle(tokenize_pieces(docs, tokenizer_path, capacity, end_id, keep_ids))
    # One row per length, capacity rows at most; then one per part, a row more for
    # every PART_PIECES pieces.
    parts_of = {r["length"]: -(-r["n"] // PART_PIECES) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    many = {k: n for k, n in parts_of.items() if n > 1}
    salts = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("length")] if many else F.lit(None).cast("int")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(salts, F.lit(1))).cast("int"))
    counts: dict[int, int] = {}
    first: list[tuple] = []
    for row in sorted(salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["length"], r["salt"])):
        first.append((row["length"], row["salt"], counts.get(row["length"], 0)))
        counts[row["length"]] = counts.get(row["length"], 0) + row["n"]
    runs, _ = plan_packing(counts, capacity)
    small = lambda df, rows: F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df
    starts = small(spark.createDataFrame(first, "length bigint, salt int, base bigint"), first)
    places = small(spark.createDataFrame(runs, "run_length bigint, run_first bigint, run_last bigint, run_sequence bigint, per bigint, run_offset bigint"), runs)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("rank", F.row_number().over(order)).join(starts, ["length", "salt"])
    numbered = numbered.withColumn("number", F.col("base") + F.col("rank") - 1)
    placed = numbered.join(places, (F.col("length") == F.col("run_length")) & (F.col("number") >= F.col("run_first")) & (F.col("number") < F.col("run_last")))
    step = F.col("number") - F.col("run_first")
    return placed.select(
        *pieces.columns,
        (F.col("run_sequence") + F.floor(step / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("run_offset") + F.pmod(step, F.col("per")) * F.col("length")).alias("offset"),
    )
