"""Quality rules and robust multivariate outliers by minimum covariance determinant.

Text statistics come from one pass over whole texts.  The location and scatter
of each (language, source) are then found by concentration steps: distances
under the current estimate, the quantile that holds the core, moments of the
core.  Every group goes through the steps from each of STARTS starts, and the
estimate of the least determinant counts.  A step is one distributed aggregation
with map-side sums, so a group of any size costs bounded memory.  An estimate is
shrunk towards that of the language, and this towards that of all rows, the more
the fewer rows it rests on; no group is without one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, settle
from .textkernel import _ODD, Words, mix64, slices, utf8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Fixed value: the characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Share of a group's rows in the core, starts, concentration steps of each, and
#: the rows that the estimate of the level above counts for.
CORE, STARTS, STEPS, PRIOR_ROWS = 0.75, 3, 4, 50
#: A document is rejected if a clean one would be as far off with this probability.
TAIL = 1e-9
FEATURES = ("f_symbols", "f_word_length", "f_repeats")
#: The target that regularises every scatter: standard deviations that are added,
#: as a statistic may be the same in all documents of a group.
FLOORS = (0.12, 1.0, 0.12)


def _chi3(x: float) -> float:
    """The chi-square distribution with three degrees of freedom."""
    return erf(sqrt(x / 2)) - sqrt(2 * x / pi) * exp(-x / 2)


def _quantile(p: float) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if _chi3(middle) < p else (low, middle)
    return low


#: Squared Mahalanobis distance beyond which a document is rejected.
CUTOFF = _quantile(1 - TAIL)
_EDGE = _quantile(CORE)
#: By this the scatter of the core of normal rows falls short of that of all rows;
#: the lower term is the distribution with five degrees of freedom.
CONSISTENCY = CORE / (_chi3(_EDGE) - _EDGE * sqrt(2 * _EDGE / pi) * exp(-_EDGE / 2) / 3)


def _repeated(words: np.ndarray) -> int:
    """Words within 3-word windows that occur twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        windows = mix64(mix64(words[:n] * _ODD + words[1 : n + 1]) * _ODD + words[2:])
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(words), dtype=bool)
    at = np.concatenate((order[1:][same], order[:-1][same]))
    for i in range(3):
        covered[at + i] = True
    return int(covered.sum())


def _dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The BASE counts of the first column, placed after the batch's own columns."""
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        out = np.zeros((len(BASE), batch.num_rows), dtype=np.int64)
        for a, b in slices(offsets):
            block = data[offsets[a] : offsets[b]]
            bounds = offsets[a : b + 1] - offsets[a]
            if not len(block):
                continue
            words = Words(block, bounds)
            out[0, a:b] = np.diff(words.row_words)
            starts = np.concatenate(([0], np.cumsum(((block & 0xC0) != 0x80), dtype=np.int64)))
            chars = np.concatenate(([0], np.cumsum(starts[words.end] - starts[words.start])))
            out[1, a:b] = np.diff(chars[words.row_words])
            symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[block], dtype=np.int64)))
            out[2, a:b] = np.diff(symbols[bounds])
            raw = block.tobytes()
            for i in range(b - a):
                out[3, a + i] = _dup_lines(raw[bounds[i] : bounds[i + 1]])
                out[4, a + i] = _repeated(words.hash[words.row_words[i] : words.row_words[i + 1]])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x) for x in out]], [*batch.schema.names[1:], *BASE])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_hash and the BASE counts of every row; null text has
    no words.  ``row_hash`` is :func:`row_hash`."""
    bound_batches(docs.sparkSession)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    return docs.select("text", "doc_id", "lang", "source", row_hash().alias("row_hash")).mapInArrow(_statistics, kinds + ", row_hash bigint" + "".join(f", {c} bigint" for c in BASE))


def row_hash() -> Column:
    """Tells rows of one doc_id apart: a hash of all that a verdict depends on."""
    return F.xxhash64("text", "lang", "source")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features(stats: DataFrame) -> DataFrame:
    """Transformed statistics: symbols per word (log), mean word length scaled by
    the square root of the length, share of repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        stats.withColumn("f_symbols", F.log1p(20.0 * F.col("n_symbols") / n))
        .withColumn("f_word_length", F.col("word_chars") / n * F.sqrt(F.least(n, F.lit(400.0))) / 4)
        .withColumn("f_repeats", F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))))
    )


def _distance(start: int = 0) -> Column:
    """Squared distance under the ``start``-th estimate of ``centre`` and ``precision``."""
    d = len(FEATURES)
    gap = [F.col(f) - F.col("centre")[start * d + i] for i, f in enumerate(FEATURES)]
    return sum((gap[i] * gap[j] * F.col("precision")[start * d * d + i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """centre, scatter, precision and log determinant of each start, from sums over
    its core; those of the starts stand one after the other."""
    d = len(FEATURES)
    for frame in batches:
        out: dict[str, list] = {"centre": [], "scatter": [], "precision": [], "spread": []}
        for row in frame.to_dict("records"):
            found: dict[str, list] = {k: [] for k in out}
            for s in range(STARTS):
                n = max(row[f"core{s}"], 1)
                mean = np.array([row[f"s{s}_{i}"] for i in range(d)], float) / n
                cov = np.empty((d, d))
                for i in range(d):
                    for j in range(i, d):
                        cov[i, j] = cov[j, i] = row[f"s{s}_{i}_{j}"] / n - mean[i] * mean[j]
                cov = CONSISTENCY * cov + np.diag(np.square(FLOORS))
                found["centre"] += mean.tolist()
                found["scatter"] += cov.ravel().tolist()
                found["precision"] += np.linalg.inv(cov).ravel().tolist()
                found["spread"].append(float(np.linalg.slogdet(cov)[1]))
            for k, v in found.items():
                out[k].append(v)
        yield frame[["level", "g_lang", "g_source", "rows"]].assign(**out)


def _moments(rows: DataFrame) -> DataFrame:
    """Estimates from the rows with ``core<start>``."""
    d = range(len(FEATURES))
    f = [F.col(x) for x in FEATURES]
    sums = []
    for s in range(STARTS):
        core = F.col(f"core{s}")
        sums += [F.count_if(core).alias(f"core{s}"), *[F.sum(F.when(core, f[i])).alias(f"s{s}_{i}") for i in d]]
        sums += [F.sum(F.when(core, f[i] * f[j])).alias(f"s{s}_{i}_{j}") for i in d for j in d if i <= j]
    moments = rows.groupBy(*_KEYS).agg(F.count("*").alias("rows"), *sums)
    moments = moments.na.fill(0.0, [c for c in moments.columns if c.startswith("s")])
    arrays = "".join(f", {c} array<double>" for c in ("centre", "scatter", "precision", "spread"))
    return moments.mapInPandas(_estimates, "level int, g_lang string, g_source string, rows bigint" + arrays)


_KEYS = ("level", "g_lang", "g_source")


def _same_group() -> list[Column]:
    return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in _KEYS]


def _levels(rows: DataFrame) -> DataFrame:
    """Each row in its (language, source), in its language and among all rows."""
    lang, source, none = F.col("lang").cast("string"), F.col("source").cast("string"), F.lit(None).cast("string")
    groups = F.array(*[F.struct(F.lit(i).alias("level"), a.alias("g_lang"), b.alias("g_source")) for i, (a, b) in enumerate([(lang, source), (lang, none), (none, none)])])
    return rows.select(*FEATURES, F.explode(groups).alias("g")).select(*FEATURES, "g.*")


def fit(rows: DataFrame) -> DataFrame:
    """(level, g_lang, g_source, rows, centre, scatter) of level 0, (language,
    source), level 1, language, and level 2, all rows: of the starts, the estimate
    whose determinant is least after STEPS steps.

    The first cores are the rows about the medians under the floors, the same under
    the median deviations, and all rows.
    """
    rows = _levels(rows)
    d = len(FEATURES)
    middle = rows.groupBy(*_KEYS).agg(F.array(*[F.percentile_approx(f, 0.5, 1000) for f in FEATURES]).alias("middle"))
    off = rows.alias("a").join(middle.alias("b"), _same_group()).select(*[f"a.{c}" for c in _KEYS], "middle", *[F.abs(F.col(f) - F.col("middle")[i]).alias(f) for i, f in enumerate(FEATURES)])
    model = off.groupBy(*_KEYS).agg(F.any_value("middle").alias("middle"), F.array(*[F.percentile_approx(f, 0.5, 1000) for f in FEATURES]).alias("apart"))
    # A normal variable's standard deviation is 1.4826 of its median deviations.
    wide = [F.lit(1.0) / (F.pow(1.4826 * F.col("apart")[i], 2) + FLOORS[i] ** 2) for i in range(d)]
    under = [[F.lit(1 / x**2) for x in FLOORS], wide, [F.lit(0.0)] * d]
    flat = F.array(*[x[i] if i == j else F.lit(0.0) for x in under for i in range(d) for j in range(d)])
    model = settle(model.select(*_KEYS, F.concat(*[F.col("middle")] * STARTS).alias("centre"), flat.alias("precision")))
    for _ in range(STEPS):
        near = rows.alias("a").join(model.alias("b"), _same_group()).select(*[f"a.{c}" for c in _KEYS], *FEATURES, *[_distance(s).alias(f"d{s}") for s in range(STARTS)])
        edge = near.groupBy(*_KEYS).agg(*[F.percentile_approx(f"d{s}", CORE, 1000).alias(f"e{s}") for s in range(STARTS)])
        near = near.alias("a").join(edge.alias("b"), _same_group()).select(*[f"a.{c}" for c in _KEYS], *FEATURES, *[(F.col(f"d{s}") <= F.col(f"e{s}")).alias(f"core{s}") for s in range(STARTS)])
        model = settle(_moments(near))
    best = F.array_position("spread", F.array_min("spread")).cast("int") - 1
    return model.select(*_KEYS, "rows", F.slice("centre", best * d + 1, d).alias("centre"), F.slice("scatter", best * d * d + 1, d * d).alias("scatter"))


def _shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """centre and precision of a group from the estimates of its levels, widest first."""
    d = len(FEATURES)
    for frame in batches:
        centres, precisions = [], []
        for chain in frame["chain"]:
            centre, scatter = np.array(chain[0]["centre"]), np.array(chain[0]["scatter"]).reshape(d, d)
            for own in chain[1:]:
                share = own["rows"] / (own["rows"] + PRIOR_ROWS)
                gap = np.array(own["centre"]) - centre
                # The scatter of the mixture of both.
                scatter = share * np.array(own["scatter"]).reshape(d, d) + (1 - share) * scatter + share * (1 - share) * np.outer(gap, gap)
                centre = centre + share * gap
            centres.append(centre)
            precisions.append(np.linalg.inv(scatter).ravel())
        yield frame[["g_lang", "g_source"]].assign(centre=centres, precision=precisions)


def estimates(model: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(g_lang, g_source, centre, precision) of each (language, source), of each
    language and of all rows, shrunk towards the level above."""
    parts = [model.where(F.col("level") == i).select("g_lang", "g_source", F.struct("rows", "centre", "scatter").alias(f"own{i}")) for i in range(3)]
    every = F.broadcast(parts[2].select("own2"))  # one row
    lang = parts[1].crossJoin(every)
    own = parts[0].join(lang.select(F.col("g_lang").alias("l"), "own1", "own2"), F.col("g_lang").eqNullSafe(F.col("l")))
    kinds = "g_lang string, g_source string, centre array<double>, precision array<double>"
    chains = [(own, ["own2", "own1", "own0"]), (lang, ["own2", "own1"]), (parts[2], ["own2"])]
    out = [df.select("g_lang", "g_source", F.array(*names).alias("chain")).mapInPandas(_shrink, kinds) for df, names in chains]
    return out[0], out[1], out[2]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, row_hash, BASE counts, base_failed, distance and kept of
    every row.

    Rows that pass the base rules are judged by their group's estimate; a null
    language or source is a group of its own.  A row is rejected if its squared
    Mahalanobis distance exceeds CUTOFF.  Repeated rows are judged alike.
    """
    stats = settle(_features(statistics(docs)).withColumn("base_failed", base_failed()))
    own, lang, every = estimates(settle(fit(stats.where(~F.col("base_failed")))))
    x = stats.alias("x")
    x = x.join(own.alias("o"), F.col("x.lang").cast("string").eqNullSafe(F.col("o.g_lang")) & F.col("x.source").cast("string").eqNullSafe(F.col("o.g_source")), "left")
    x = x.join(lang.alias("l"), F.col("x.lang").cast("string").eqNullSafe(F.col("l.g_lang")), "left")
    x = x.join(F.broadcast(every.alias("e")), F.lit(True), "left")  # one row
    x = x.select("x.*", F.coalesce("o.centre", "l.centre", "e.centre").alias("centre"), F.coalesce("o.precision", "l.precision", "e.precision").alias("precision"))
    judged = x.withColumn("distance", _distance())
    outlier = F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return judged.select("doc_id", "lang", "source", "row_hash", *BASE, "base_failed", "distance", (~F.col("base_failed") & ~outlier).alias("kept"))
