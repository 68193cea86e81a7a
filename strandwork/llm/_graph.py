"""Connected components and blocked all-pairs work inside components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._store import cut, drop_cut, join_hot

ROUNDS = 60
ONE_TASK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest node of its component among these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:  # smallest neighbour, then pointer jumping
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        np.minimum.at(low, before, low)
        while not np.array_equal(low, jumped := low[low]):
            low = jumped
        if np.array_equal(low, before):
            return nodes, nodes[low]


def _local(batches):
    """Edges to each component's smallest node, of what one task reads."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, np.array(batch.column(0))]), np.concatenate([b, np.array(batch.column(1))])
        if len(a) > 1 << 20:
            a, b = forest(a, b)
    node, root = forest(a, b)
    keep = node != root
    yield pa.RecordBatch.from_arrays([pa.array(node[keep], pa.int64()), pa.array(root[keep], pa.int64())], names=["a", "b"])


def _whole(batches):
    """Each node of all edges with its component's smallest."""
    parts = [(np.array(x.column(0)), np.array(x.column(1))) for x in batches]
    node, root = forest(*(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*parts) if parts else ((), ()))))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """(node, root) for every node of the edges (a, b: long): root is the component's smallest node.

    At most `small` edges are settled in one task (16 bytes each), as every round takes several jobs and plans.
    Alternates large-star and small-star rounds. Minima are aggregated before the shuffle and joined back, those of hubs by
    broadcast, so the hub of a large component is no group of its own; edges inside one task shrink to a forest first.
    """
    table = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_local, "a long, b long"), "edges")
    seen, total = None, table.count()
    if total <= small:
        return table.repartition(1).mapInArrow(_whole, "node long, root long")
    for _ in range(ROUNDS):
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both.where("b > a"), low, ["a"], "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        smaller = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = smaller.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_hot(smaller, least, ["a"], "n", 2 * total)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = cut(small, "edges")
        total, *state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_cut(table)
        table = new
        if [total, *state] == seen:
            break
        seen = [total, *state]
    else:
        raise RuntimeError("components did not settle")
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def block_tasks(rows: DataFrame, group: str, item: str, blocks: Column, bins: int) -> DataFrame:
    """rows with the tasks that compare all pairs of a group: columns task, x, y and own.

    A group of one block is one task; small groups share `bins` tasks by hash. A group of several blocks (`blocks`, equal
    for all its rows) is cut by hash, and each pair of blocks x <= y is a task, so a row travels once per block of its
    group; own is the row's block.
    """
    own = F.pmod(F.xxhash64(F.col(item), F.lit(3)), F.col("__n")).cast("int")
    many = rows.withColumn("__n", blocks.cast("int")).withColumn("own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    many = many.withColumn("x", F.least("own", "__other")).withColumn("y", F.greatest("own", "__other"))
    task = F.when(F.col("__n") == 1, F.pmod(F.xxhash64(F.col(group), F.lit(5)), F.lit(bins))).otherwise(F.xxhash64(F.col(group), F.col("x"), F.col("y")))
    return many.withColumn("task", task).drop("__n", "__other")


def bins(rows: int, each: int, least: int = 32) -> int:
    """How many shared tasks of about `each` rows."""
    return max(least, -(-rows // each))
