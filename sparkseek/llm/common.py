"""What the corpus operators share: lineage cuts, batch bounds, components."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 1000
#: Binary logarithm of the most bits of a table.
_MOST_BITS = 29
#: Edges, of 16 bytes, that the driver joins at once; more are joined by the executors.
AT_ONCE = 1 << 18


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to ``ROWS_PER_BATCH`` rows, as one text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary
    folder.
    """
    context = spark.sparkContext
    where = context.getCheckpointDir()
    if where is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there."""
    context = df.sparkSession.sparkContext
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    context._jvm.System.gc()  # shuffle files of finished steps go when their plans are collected
    return out


def bit_table(hashes: DataFrame) -> DataFrame:
    """(chunk, words): a table of bits, eight or more for each row of ``hashes`` (one
    64-bit hash), of which those that a hash stands for are set.  At most 64 MB: a
    larger set only lets more others through."""
    spark, name = hashes.sparkSession, hashes.columns[0]
    bits = min(max(16, (8 * hashes.count()).bit_length()), _MOST_BITS)
    at = _place(F.col(name), bits)
    ones = hashes.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    ones = ones.select("word", F.call_function("shiftleft", "one", "bit").alias("bits"))
    words = ones.unionByName(spark.range(1 << (bits - 6)).select(F.col("id").alias("word"), F.expr("0L").alias("bits"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy(F.shiftrightunsigned("word", 10).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("found"))
    return settle(rows.select("chunk", F.col("found.bits").alias("words"), F.lit(bits).alias("table_bits")))


def _place(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, 64 - bits)


def has_bit(rows: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``bit``: false if ``name`` is in no row that ``table``
    was made of; true if it is, and for a few others."""
    bits = table.select("table_bits").first()[0]
    at = _place(F.col(name), bits)
    table = F.broadcast(table.drop("table_bits"))
    rows = rows.withColumn("__chunk", F.shiftrightunsigned(at, 16)).join(table.withColumnRenamed("chunk", "__chunk"), "__chunk")
    word = F.get("words", F.shiftrightunsigned(at, 6).bitwiseAND(F.lit(1023)).cast("int"))
    shift = at.bitwiseAND(F.lit(63)).cast("int")
    return rows.withColumn("bit", F.call_function("shiftrightunsigned", word, shift).bitwiseAND(F.expr("1L")) == 1).drop("__chunk", "words")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst).

    ``component`` is the least node that can be reached.  Distributed union-find
    by alternating large and small stars: every step groups by node with map-side
    minima, so neither an edge list nor a component is gathered in one place.
    Up to ``AT_ONCE`` edges are joined on the driver, as each step costs more than
    they do.  Null ends are ignored; loops yield a component of one node.
    """
    pairs = settle(edges.select(F.col("src"), F.col("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    if dict(pairs.dtypes)["src"] == dict(pairs.dtypes)["dst"] == "bigint" and pairs.count() <= AT_ONCE:
        return _at_once(pairs)
    nodes = settle(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    links = settle(pairs.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(links)
        if before == state:
            break
    found = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _at_once(pairs: DataFrame) -> DataFrame:
    """The components of at most ``AT_ONCE`` edges between 64-bit nodes, as a table to broadcast."""
    ends = pairs.toArrow()
    nodes, at = np.unique(np.concatenate([ends["src"].to_numpy(), ends["dst"].to_numpy()]), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        u, v, low, high = (x[low != high] for x in (u, v, low, high))
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    found = pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(nodes[root], pa.int64())})
    return F.broadcast(pairs.sparkSession.createDataFrame(found))
