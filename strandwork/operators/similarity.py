"""Similarity of fingerprints held as arrays of set bits, and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def tanimoto(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(_shared(a, b), F.size(a) + F.size(b) - _shared(a, b)), F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * _shared(a, b), F.size(a) + F.size(b)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(_shared(a, b), F.sqrt(F.size(a).cast("double") * F.size(b))), F.lit(0.0))


SCREEN_BLOCK = 1024


def screen(queries: DataFrame, rows: DataFrame, threshold: float, most: int | None = None, key: str = "id", bits: str = "bits", block: int = SCREEN_BLOCK) -> DataFrame:
    """(query, id, tanimoto) of all rows at least that similar to a query; with `most`, the best of each query with their rank.

    Queries and rows are dealt to blocks and each pair of blocks is a task of one matrix product, so neither side is
    broadcast and a row travels once per block of queries. A fingerprint without bits is similar to none.
    """
    import numpy as np
    import pyarrow as pa

    def blocks(df: DataFrame):
        return F.greatest(F.lit(1), F.ceil(F.lit(df.count()) / block)).cast("int")

    nx, ny = blocks(queries), blocks(rows)
    deal = lambda n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.select(F.lit(True).alias("ask"), F.col(key).cast("long").alias("id"), F.col(bits).cast("array<int>").alias("bits"), deal(nx).alias("x"), every(ny).alias("y"))
    right = rows.select(F.lit(False).alias("ask"), F.col(key).cast("long").alias("id"), F.col(bits).cast("array<int>").alias("bits"), every(nx).alias("x"), deal(ny).alias("y"))

    def compare(table):
        ask, ids, lists = np.array(table.column("ask")), np.array(table.column("id")), table.column("bits").combine_chunks()
        size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
        at = np.array(lists.flatten())
        kinds, place = np.unique(at, return_inverse=True)
        m = np.zeros((len(ids), len(kinds)), np.float32)
        m[np.repeat(np.arange(len(ids)), size), place] = 1
        n = m.sum(1).astype(float)
        p, q = np.flatnonzero(ask), np.flatnonzero(~ask)
        both = (m[p] @ m[q].T).astype(float)
        sim = both / np.maximum(n[p][:, None] + n[q][None, :] - both, 1.0)
        i, j = np.nonzero((sim >= threshold) & (both > 0))
        if most is not None:  # no other block can bring more of a query's best from here
            order = np.lexsort((ids[q][j], -sim[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < most
            i, j = i[keep], j[keep]
        return pa.Table.from_arrays([pa.array(ids[p][i]), pa.array(ids[q][j]), pa.array(sim[i, j])], names=["query", "id", "tanimoto"])

    hits = left.unionByName(right).groupBy("x", "y").applyInArrow(compare, "query long, id long, tanimoto double")
    if most is None:
        return hits
    w = Window.partitionBy("query").orderBy(F.col("tanimoto").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def screen_kinds(queries: DataFrame, rows: DataFrame, threshold: float, most: int, key: str = "id", bits: str = "bits", block: int = SCREEN_BLOCK) -> DataFrame:
    """screen() with `most`, over kinds of equal fingerprints, for tables with many of them.

    Rows of a kind are equally similar, so the `most` smallest keys of a kind are all that can be among a query's best,
    and queries of a kind have the same best rows. A kind's smallest key stands for it.
    """
    w = Window.partitionBy(bits).orderBy(key)
    first = rows.select(bits, key).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    kinds = first.groupBy(bits).agg(F.min(key).alias(key), F.sort_array(F.collect_list(key)).alias("__keys"))
    asked = queries.groupBy(bits).agg(F.min(key).alias(key))
    hits = screen(asked, kinds, threshold, most, key, bits, block).drop("rank")
    each = hits.join(kinds.select(F.col(key).cast("long").alias("id"), "__keys"), "id").select(F.col("query").alias("__kind"), F.explode("__keys").alias("id"), "tanimoto")
    best = Window.partitionBy("__kind").orderBy(F.col("tanimoto").desc(), "id")
    top = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    ask = queries.select(F.col(key).cast("long").alias("query"), bits).join(asked.select(bits, F.col(key).cast("long").alias("__kind")), bits)
    return ask.join(top, "__kind").select("query", F.col("id").cast("long").alias("id"), "tanimoto", "rank")


def max_min_pick(fp: DataFrame, n: int, key: str = "id", bits: str = "bits") -> DataFrame:
    """Greedy diverse choice: from the smallest key on, the row farthest from those chosen; one aggregate per pick."""
    first = fp.orderBy(key).limit(1)
    chosen = first.withColumn("rank", F.lit(1))
    left = fp.withColumn("__far", F.lit(2.0))
    last = first
    for rank in range(2, n + 1):
        q = F.broadcast(last.select(F.col(bits).alias("__q"), F.col(key).alias("__k")))
        left = left.join(q).where(F.col(key) != F.col("__k")).withColumn("__far", F.least("__far", 1 - tanimoto(F.col(bits), F.col("__q")))).drop("__q", "__k")
        row = left.orderBy(F.col("__far").desc(), key).select(key, bits).first()
        if row is None:
            break
        last = fp.sparkSession.createDataFrame([row], fp.select(key, bits).schema)
        chosen = chosen.unionByName(fp.where(F.col(key) == row[key]).withColumn("rank", F.lit(rank)))
    return chosen
