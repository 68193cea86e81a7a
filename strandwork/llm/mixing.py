"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Each source's words lie on a line, its documents in seeded order, cut into equal blocks. A source's quota of words
is the number of quotients target / (2k + 1), k = 0, 1, ..., that reach half a word: the Sainte-Laguë apportionment
of all words granted, without ranking them one by one. The whole blocks of the quota are apportioned to the source's
shards of blocks by highest quotients, and each shard takes all its blocks equally often, the rest in seeded order.
Words short of the quota then (less than a block, or what a partial last block lacks) come from the source's blocks in
seeded order, as far as none is taken more than `most` times, so a source meets its quota to the word however large a
block is. What a document gives is a difference of prefix sums at its two ends, so nothing is grouped by document.

Lines are laid by source and hash shard, so a source with a third of all rows is spread over `shards` groups; the
blocks number at most `blocks` plus one per source whatever the corpus's size.

Defined cases: null sources are one source, last in order; null sizes count 0, and size 0 takes 0; equal rows take
their share in any order; an empty table gives no rows; extra columns pass through, and a column named like a result
is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
BLOCKS = 1 << 18
SHARDS = 64
RESULTS = ("source_size", "target", "taken")


def n_words(text: str = "text") -> Column:
    """The number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, most: int = MOST) -> DataFrame:
    """(source, size) rows with weight and target: weights 1, 2, 3 repeating share all sizes, none above most times its size.

    Sources that stop are those with the lowest cap per weight; with sources in that order, the level of the others
    after the first k stopped is a running sum, and the first source under its cap fixes it.
    """
    by_name, everything = Window.orderBy(F.col(source).asc_nulls_last()), Window.partitionBy()
    s = sizes.withColumn("__w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("__cap", F.col(size) * F.lit(float(most)))
    s = s.withColumn("__r", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__r", F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum(F.col(size).cast("double")).over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    weight = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    s = s.withColumn("__level", rest / weight).withColumn("__n", F.row_number().over(order))
    level = F.min_by(F.when(F.col("__level") <= F.col("__r"), F.col("__level")), F.when(F.col("__level") <= F.col("__r"), F.col("__n"))).over(everything)
    return s.withColumn("target", F.least(F.col("__cap"), F.coalesce(level, F.lit(0.0)) * F.col("__w"))).drop("__cap", "__r", "__level", "__n", "__w")


def mix(rows: DataFrame, source: str = "source", size: str = "size", key: str = "doc_id", seed: int = 17, most: int = MOST, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """rows with source_size, target (of the source) and taken: the words that the mix takes of each row, repeats counted.

    `rows` is read several times, so it should be a table or a cut.
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() in RESULTS])
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key), n)).withColumn("__n", n).withColumn("__shard", F.pmod("__h", F.lit(shards)).cast("int"))

    groups = hashed.groupBy(F.col(source).alias("__source"), "__shard").agg(F.sum("__n").alias("__sum"))
    line = Window.partitionBy("__source").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("__offset", F.coalesce(F.sum("__sum").over(line), F.lit(0))).drop("__sum")
    sources = targets(groups.groupBy("__source").agg(F.sum("__sum").alias("source_size")), "__source", "source_size", most)

    # Blocks of equal size over all sources; quotas are in words, and their whole blocks are dealt first.
    b = F.greatest(F.lit(1), F.ceil(F.sum("source_size").over(Window.partitionBy()) / blocks)).cast("long")
    sources = sources.withColumn("__b", b).withColumn("__m", F.ceil(F.col("source_size") / F.col("__b")).cast("long"))
    sources = sources.withColumn("__quota", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most).cast("long"))
    sources = sources.withColumn("__q", F.floor(F.col("__quota") / F.col("__b")).cast("long"))

    # The blocks of a source over its shards (block number modulo shards), by highest quotients.
    m = F.greatest(F.floor((F.col("__m") - F.col("__s") + shards - 1) / shards), F.lit(0)).cast("long")
    parts = sources.where("__m > 0").withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("__ms", m).where("__ms > 0")
    sure = F.greatest(F.floor(F.col("__q") * F.col("__ms") / F.col("__m")) - 2, F.lit(0)).cast("long")
    parts = parts.withColumn("__base", F.least(sure, F.col("__ms") * most))
    left = F.col("__q") - F.sum("__base").over(Window.partitionBy("__source"))
    seats = parts.withColumn("__left", left).withColumn("__k", F.explode(F.sequence(F.col("__base"), F.col("__base") + 5)))
    seats = seats.where(F.col("__k") < F.col("__ms") * most)
    by_quotient = Window.partitionBy("__source").orderBy((F.col("__ms") / (2 * F.col("__k") + 1)).desc(), "__s")
    won = seats.withColumn("__won", (F.row_number().over(by_quotient) <= F.col("__left")).cast("long"))
    quotas = won.groupBy("__source", "__s").agg(F.first("__base").alias("__base"), F.sum("__won").alias("__more"), F.first("__ms").alias("__ms"), F.first("__m").alias("__m"), F.first("__b").alias("__b"), F.first("source_size").alias("__size"), F.first("__quota").alias("__quota"))
    quotas = quotas.withColumn("__q", F.col("__base") + F.col("__more"))

    # Every block of a shard equally often, the rest in seeded order; then prefix sums of the words taken.
    each = quotas.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__ms") - 1))).withColumn("__block", F.col("__j") * shards + F.col("__s"))
    seeded = Window.partitionBy("__source", "__s").orderBy(F.xxhash64(F.lit(seed), F.col("__source"), F.col("__block")), "__block")
    times = F.floor(F.col("__q") / F.col("__ms")) + (F.row_number().over(seeded) <= F.col("__q") % F.col("__ms")).cast("long")
    each = each.withColumn("__times", times.cast("long"))
    each = each.withColumn("__len", F.least(F.col("__b"), F.col("__size") - F.col("__block") * F.col("__b")))

    # Words short of the quota: from blocks in seeded order, the last of them only up to a cut.
    short = F.col("__quota") - F.sum(F.col("__len") * F.col("__times")).over(Window.partitionBy("__source"))
    each = each.withColumn("__short", short).withColumn("__room", F.col("__len") * (most - F.col("__times")))
    earlier = Window.partitionBy("__source").orderBy(F.xxhash64(F.lit(seed), F.col("__source"), F.col("__block")), "__block").rowsBetween(Window.unboundedPreceding, -1)
    more = F.greatest(F.lit(0), F.least(F.col("__room"), F.col("__short") - F.coalesce(F.sum("__room").over(earlier), F.lit(0))))
    each = each.withColumn("__more", more).withColumn("__times", F.col("__times") + F.floor(F.col("__more") / F.col("__len"))).withColumn("__cut", F.col("__more") % F.col("__len"))
    words = F.col("__len") * F.col("__times") + F.col("__cut")
    upto = Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("__source", "__block", "__times", "__cut", F.coalesce(F.sum(words).over(upto), F.lit(0)).alias("__before"))

    # A row's place on its source's line, and the words taken up to its two ends.
    place = Window.partitionBy(source, "__shard").orderBy("__h", key, "__n").rowsBetween(Window.unboundedPreceding, -1)
    at = hashed.withColumn("__at", F.coalesce(F.sum("__n").over(place), F.lit(0)))
    left_rows = at.join(offsets.withColumnRenamed("__shard", "__shard2"), F.col(source).eqNullSafe(F.col("__source")) & (F.col("__shard") == F.col("__shard2")), "left").drop("__source", "__shard2")
    left_rows = left_rows.join(sources.select("__source", "source_size", "target", "__b"), F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    start = F.col("__at") + F.col("__offset")
    out = left_rows.withColumn("__start", start).withColumn("__stop", start + F.greatest(F.col("__n") - 1, F.lit(0)))
    for side in ("__start", "__stop"):
        spots = each.select(F.col("__source").alias("__s1"), F.col("__block").alias("__b1"), F.col("__times").alias(f"{side}_t"), F.col("__cut").alias(f"{side}_c"), F.col("__before").alias(f"{side}_w"))
        out = out.join(spots, F.col(source).eqNullSafe(F.col("__s1")) & (F.floor(F.col(side) / F.col("__b")) == F.col("__b1")), "left").drop("__s1", "__b1")
    upto_start = F.col("__start_w") + F.col("__start") % F.col("__b") * F.col("__start_t") + F.least(F.col("__start") % F.col("__b"), F.col("__start_c"))
    upto_stop = F.col("__stop_w") + (F.col("__stop") % F.col("__b") + 1) * F.col("__stop_t") + F.least(F.col("__stop") % F.col("__b") + 1, F.col("__stop_c"))
    taken = F.when(F.col("__n") > 0, upto_stop - upto_start).otherwise(F.lit(0)).cast("long")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))
