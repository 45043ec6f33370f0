"""Connected components of a distributed graph, by alternating large and small stars, and joins that no hot group holds up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlex.session import checkpoint

#: A group's rows are dealt to so many places before they meet what is known of the group.
SALTS = 64
#: Nodes with more than one HUBS-th of all links are told apart.
HUBS = 1000
#: A graph of no more edges than these (8 MB) is gone through by one task; each round of stars costs the driver three queries.
SMALL = 500_000


def salt(*spread: str | Column) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of groups, which has one row for each value of `on` (none of them null).

    Rows of one group are told apart by a hash of `spread`. Only the different pairs of group and
    hash meet the group's row; each row then meets its pair. So a group that holds a third of all
    rows comes to SALTS tasks, whatever the number of its rows. `rows` is read twice. The joins
    sort, so that nothing is sent by way of the driver or has to fit a task's memory.
    """
    salted = rows.withColumn("_salt", salt(*spread))
    pairs = salted.select(*on, "_salt").distinct().join(groups.hint("merge"), on, how)
    return salted.join(pairs.hint("merge"), [*on, "_salt"]).drop("_salt")


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v), of which there are `total` at most, with m, the least v of each u.

    Nodes with more than a HUBS-th of `total` are fewer than HUBS, whatever the graph, so what is
    known of them is sent to their rows where these are. All other rows meet their node's by a
    sort; no node has more than that share of them.
    """
    share = total // HUBS
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > share).select("u", F.col("m").alias("hub")))
    marked = edges.join(hubs, "u", "left")
    others = marked.where("hub is null").drop("hub").join(least.where(F.col("n") <= share).drop("n").hint("merge"), "u")
    return others.union(marked.where("hub is not null").withColumnRenamed("hub", "m"))


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    known = _with_least(edges, total)
    tied = known.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.union(known.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether all is stars: no node has two smaller neighbours, or one and a larger one."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = roles.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return not per.where("low > 1 or (low > 0 and high > 0)").limit(1).count()


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), in order, and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):  # of the roots that an edge joins the larger goes under the smaller, so at most half of them stay
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while len(above := np.flatnonzero(root[root] != root)):
            root[above] = root[root[above]]
    return nodes, nodes[root]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if edges:
        nodes, roots = least_reachable(*(np.concatenate(c) for c in zip(*edges, strict=True)))
        some = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(roots[some])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """For a graph of links (u, v) of longs: node, root, one row for each node but the roots.

    root is the least node that node is connected with. Links of a node with itself say nothing;
    no links give no rows. A graph of at most SMALL different links is one task's; larger ones take
    rounds of stars. No step makes more edges than it gets, so those at first are counted once, as
    a bound for all rounds.
    """
    edges = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    total = edges.count()
    if total <= SMALL:
        return checkpoint(edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
    while not _settled(edges):
        for step in (_large, _small):  # each half by itself: their plans would multiply
            edges = checkpoint(step(edges, total).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
