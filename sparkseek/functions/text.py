"""Text analysis as column expressions."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmer import starts, stem

#: The stop words of the English analyzer.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
_TOKEN = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Query-side tokens: runs of letters and digits in lower case."""
    return _TOKEN.findall(text.lower())


def _stemmed(tokens: Column, begins: tuple[str, ...] = ("",)) -> Column:
    """The stems of words with one of these beginnings, and all others as they are."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stems(tokens: pa.Array) -> pa.Array:
        # A word is stemmed once a batch, however often it stands in it.
        flat = tokens.flatten().dictionary_encode()
        found = pa.array([stem(t) if t.startswith(begins) else t for t in flat.dictionary.to_pylist()], pa.string())
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0)).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, found.take(flat.indices), mask=tokens.is_null())

    return stems(tokens)


class Analyzer:
    """Tokens of an indexed column.  Positions count stop words, which are then
    replaced by an empty token, so a phrase keeps its gaps."""

    def __init__(self, filters: tuple[str, ...] = ()):
        self.stop = "english_stop" in filters
        self.stems = "english_stemmer" in filters

    def column(self, text: Column, wanted: list[str] | None = None) -> Column:
        """The tokens of a text; with ``wanted`` ones, words that cannot have one of
        these for their stem are left as they are."""
        tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        if not self.stems or wanted == []:
            return tokens
        if wanted is None:
            return _stemmed(tokens)
        begins = list(dict.fromkeys(b for t in wanted for b in starts(t)))
        low = F.lower(text)
        # Only texts that have such words go to Python.
        some = reduce(Column.__or__, [low.contains(b) for b in begins])
        return F.coalesce(_stemmed(F.when(some, tokens), tuple(begins)), tokens)

    def may_hold(self, text: Column, tokens: list[str]) -> Column:
        """Whether a text has what these tokens are made of as parts of it: true
        wherever they all are."""
        if not self.stems:
            return holds(text, tokens)
        low = F.lower(text)
        return reduce(Column.__and__, [reduce(Column.__or__, [low.contains(b) for b in starts(t)]) for t in dict.fromkeys(tokens)], F.lit(True))

    def normal(self, token: str) -> str:
        return stem(token) if self.stems else token

    def is_stop(self, token: str) -> bool:
        return self.stop and token in STOP_WORDS

    def query(self, text: str) -> list[tuple[int, str]]:
        """(position, token) of the tokens that the index holds."""
        return [(i, self.normal(t)) for i, t in enumerate(words(text)) if not self.is_stop(t)]


def has_token(tokens: Column, token: str) -> Column:
    return F.coalesce(F.array_contains(tokens, token), F.lit(False))


def has_phrase(tokens: Column, query: list[tuple[int, str]]) -> Column:
    """Tokens at the query's distances.  The joined text is searched once; a
    position that the index drops on the query side matches any token."""
    if not query:
        return F.lit(False)
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    if [p for p, _ in query] == list(range(query[0][0], query[0][0] + len(query))):
        return F.coalesce(joined.contains(" " + " ".join(t for _, t in query) + " "), F.lit(False))
    parts = [re.escape(query[0][1])]
    for (before, _), (at, token) in zip(query, query[1:], strict=False):
        parts += [r"\S+"] * (at - before - 1) + [re.escape(token)]
    return F.coalesce(joined.rlike("(?<= )" + " ".join(parts) + "(?= )"), F.lit(False))


def has_near(tokens: Column, query: list[tuple[int, str]], slop: int) -> Column:
    """Sloppy phrase: some choice of places, each less its place in the query, lies
    within ``slop``; so a swap of two words costs two.

    The offset places of all words are sorted together once; of a window that fits,
    the latest place of each word at its end is as good as any.
    """
    if len(query) < 2 or slop <= 0:
        return has_phrase(tokens, query)
    n = len(query)

    def places(words: Column, k: int) -> Column:
        """(offset place, word of the query) of each token that is the k-th word."""
        at, token = query[k]
        return F.filter(F.transform(words, lambda t, i: F.when(t == token, F.struct((i - at).alias("p"), F.lit(k).alias("k")))), lambda x: x.isNotNull())

    def search(words: Column) -> Column:
        found = near_places(F.array_sort(F.concat(*[places(words, k) for k in range(n)])), n, slop)
        present = F.lit(True)
        for _, t in query:
            present = present & F.array_contains(words, t)
        return F.when(present, found)

    # The tokens are bound once.
    return F.coalesce(F.get(F.transform(F.array(tokens), search), 0), F.lit(False))


def near_places(hits: Column, n: int, slop: int) -> Column:
    """Whether sorted (offset place p, word k) hold all ``n`` words within ``slop``."""
    start = F.struct(F.array(*[F.lit(None).cast("int")] * n).alias("last"), F.lit(False).alias("found"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda p, k: F.when(k == hit["k"], hit["p"]).otherwise(p))
        whole = ~F.exists(last, lambda p: p.isNull()) & (hit["p"] - F.array_min(last) <= slop)
        return F.struct(last.alias("last"), (state["found"] | whole).alias("found"))

    return F.aggregate(hits, start, step)["found"]


def holds(text: Column, tokens: list[str]) -> Column:
    """Whether a text has these tokens as parts of it: true wherever they are words."""
    low = F.lower(text)
    out = F.lit(True)
    for t in dict.fromkeys(tokens):
        out = out & low.contains(t)
    return out


def has_fuzzy_run(tokens: Column, query: list[tuple[int, str]], distance: int) -> Column:
    """Tokens one after the other, as far apart as in the query, each within
    ``distance`` of its own."""
    if len(query) == 1:
        return has_fuzzy(tokens, query[0][1], distance)
    first = query[0][0]
    near = lambda t, want: F.coalesce(F.levenshtein(t, F.lit(want), distance) >= 0, F.lit(False))

    def search(words: Column) -> Column:
        begins = F.filter(F.transform(words, lambda t, i: F.when(near(t, query[0][1]), i)), lambda i: i.isNotNull())

        def run(i: Column) -> Column:
            out = F.lit(True)
            for at, t in query[1:]:
                out = out & near(F.get(words, i + (at - first)), t)
            return out

        return F.exists(begins, run)

    # The tokens are bound once.
    return F.coalesce(F.get(F.transform(F.array(tokens), search), 0), F.lit(False))


def has_fuzzy(tokens: Column, token: str, distance: int) -> Column:
    return F.coalesce(F.exists(tokens, lambda t: F.levenshtein(t, F.lit(token), distance) >= 0), F.lit(False))


def word_bounded(text: Column, pattern: str) -> Column:
    """A lower-case pattern between characters outside a-z and 0-9."""
    return F.coalesce(F.lower(text).rlike(f"(^|[^a-z0-9]){pattern}([^a-z0-9]|$)"), F.lit(False))


def term_frequency(tokens: Column, token: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))
