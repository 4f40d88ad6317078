"""Verified links from bucket memberships, without all pairs of a bucket.

Every member of a bucket is first compared with the bucket's leader.  Where members
stay outside the leader's component, one of them leads a second and a third round
over the members outside its own.  Jaccard distance is a metric, so two members can
be within the limit of each other only if their distances to the first leader differ
by no more than it; what the rounds leave open is compared within that ring alone.
No candidate pair that could be a link is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, settle

#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 80
RING = 1 - PERCENT / 100 + 1e-9
#: Leaders that an open bucket gets beyond the first before its pairs are searched.
LEADERS = 2


def is_link() -> Column:
    return 100 * F.col("shared") >= PERCENT * F.col("either")


def ring(u: str, w: str) -> Column:
    """Whether rows (node, apart, own, led) of one bucket are left to compare:
    ``u`` outside the leader's component, ``w`` any member."""
    return (
        (F.col(f"{u}.own") != F.col(f"{w}.own"))
        & (F.abs(F.col(f"{u}.apart") - F.col(f"{w}.apart")) <= RING)
        & ((F.col(f"{w}.own") == F.col(f"{w}.led")) | (F.col(f"{u}.node") < F.col(f"{w}.node")))
    )


def _joined(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``labels`` (node, component) after ``links`` (a, b) between their nodes, and
    the change (old, new) of the components."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("src")), "a")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col("component").alias("dst")), "b")
    change = connected_components(ends.select("src", "dst")).select(F.col("node").alias("old"), F.col("component").alias("new"))
    after = labels.join(change, F.col("component") == F.col("old"), "left")
    return settle(after.select("node", F.coalesce("new", "component").alias("component"))), change


def _relabelled(rows: DataFrame, change: DataFrame) -> DataFrame:
    for name in ("own", "led"):
        rows = rows.join(change, F.col(name) == F.col("old"), "left").withColumn(name, F.coalesce("new", name)).drop("old", "new")
    return rows


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every member; the component is its least node.

    ``members`` (key, node, leader) holds the buckets of two nodes or more.
    ``verify`` turns pairs (a, b) into (a, b, shared, either), the exact sizes of
    the intersection and the union of their sets.  ``search`` lists the pairs left
    to compare among rows (key, node, apart, own, led): a member's distance from
    the bucket's leader, its component and the leader's.
    """
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = settle(verify(pairs))
    labels = members.select("node").distinct().withColumn("component", F.col("node"))
    labels, _ = _joined(labels, star.where(is_link()).select("a", "b"))
    apart = star.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("shared") / F.col("either")).alias("apart"))
    rows = members.join(labels.withColumnRenamed("component", "own"), "node")
    rows = rows.join(labels.select(F.col("node").alias("leader"), F.col("component").alias("led")), "leader")
    rows = settle(rows.join(apart, ["leader", "node"]).select("key", "node", "apart", "own", "led"))
    for _ in range(LEADERS):
        heads = rows.where("own <> led").groupBy("key").agg(F.min("node").alias("head"))
        # A head meets all others of its bucket now and is done with it.
        rows = rows.join(heads, "key")  # a bucket without a head is all of one component
        head = rows.where("node = head").select("key", F.col("apart").alias("head_apart"), F.col("own").alias("head_own"))
        near = (F.col("own") != F.col("head_own")) & (F.abs(F.col("apart") - F.col("head_apart")) <= RING)
        pairs = rows.where("node <> head").join(head, "key").where(near).select(F.col("head").alias("a"), F.col("node").alias("b"))
        more = settle(verify(pairs.distinct()).where(is_link()).select("a", "b"))
        rows = rows.where("node <> head").drop("head")
        if not more.isEmpty():
            labels, change = _joined(labels, more)
            rows = _relabelled(rows, change)
        rows = settle(rows)
        if rows.isEmpty():
            return labels
    more = settle(verify(settle(search(rows))).where(is_link()).select("a", "b"))
    return labels if more.isEmpty() else _joined(labels, more)[0]
