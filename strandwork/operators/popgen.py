"""Population statistics of aligned sequences: tables (id, s), with all sequences of a group of one length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions import tables as T
from strandwork.functions.sequence import codons, literal_map


def columns_of(seqs: DataFrame, keep: list[str]) -> DataFrame:
    """Long form: a row per sequence and place."""
    return seqs.select(*keep, F.posexplode(F.filter(F.split("s", ""), lambda c: c != "")).alias("col", "base"))


def tajimas_d(seqs: DataFrame) -> DataFrame:
    """Segregating sites and Tajima's D of one alignment of at least 4 sequences, from base counts per column.

    Pairwise differences of a column are (n^2 - sum of squared counts) / 2, so no pair of sequences is made.
    """
    n, length = seqs.count(), seqs.select(F.max(F.length("s"))).first()[0] or 0
    if n < 4:
        raise ValueError("at least 4 sequences")
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i / i for i in range(1, n))
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    e1, e2 = c1 / a1, c2 / (a1 * a1 + a2)
    per = columns_of(seqs, []).groupBy("col", "base").count().groupBy("col").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("count") * F.col("count")).alias("sq"))
    t = per.agg(F.count_if(F.col("kinds") > 1).alias("segregating"), F.sum((F.lit(n * n) - F.col("sq")) / 2.0).alias("diff"))
    s = F.col("segregating").cast("double")
    k = 2.0 * F.col("diff") / (n * (n - 1))
    return t.select("segregating", (k / length).alias("pi"), (s / a1 / length).alias("theta"), F.when(s == 0, 0.0).otherwise((k - s / a1) / F.sqrt(e1 * s + e2 * s * (s - 1))).alias("tajima_d"))


def fst(seqs: DataFrame) -> DataFrame:
    """Fst of (pop, s) with two populations: base counts by column and population, then by column, as grouping sets."""
    long = columns_of(seqs, ["pop"])
    counts = long.groupBy("col", "pop", "base").count()
    size = seqs.groupBy("pop").agg(F.count(F.lit(1)).alias("n"))
    within = counts.join(F.broadcast(size), "pop").groupBy("col", "pop").agg((1 - F.sum(F.pow(F.col("count") / F.col("n"), F.lit(2.0)))).alias("h")).groupBy("col").agg(F.avg("h").alias("hs"))
    n = size.agg(F.sum("n").alias("n"))
    total = counts.groupBy("col", "base").agg(F.sum("count").alias("c")).join(F.broadcast(n)).groupBy("col").agg((1 - F.sum(F.pow(F.col("c") / F.col("n"), F.lit(2.0)))).alias("ht"))
    both = total.join(within, "col").agg(F.avg("ht").alias("ht"), F.avg("hs").alias("hs"))
    return both.withColumn("fst", F.coalesce(F.try_divide(F.col("ht") - F.col("hs"), F.col("ht")), F.lit(0.0)))


def consensus(seqs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per column the commonest base (the first letter on ties), its share, and X below the threshold."""
    n = columns_of(seqs, []).groupBy("col", "base").count()
    total = n.groupBy("col").agg(F.max(F.struct(F.col("count").alias("c"), (-F.ascii("base")).alias("o"), F.col("base").alias("base"))).alias("best"), F.sum("count").alias("n"))
    share = F.col("best.c") / F.col("n")
    return total.select("col", F.when(share >= threshold, F.col("best.base")).otherwise("X").alias("base"), share.alias("share"))


def p_distance(a: Column, b: Column) -> Column:
    """Share of differing columns among those without gaps; 1 without shared columns."""
    n = F.least(F.length(a), F.length(b))
    cols = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ca, cb = (lambda i: F.substring(a, i, F.lit(1))), (lambda i: F.substring(b, i, F.lit(1)))
    shared = F.filter(cols, lambda i: (ca(i) != "-") & (cb(i) != "-"))
    return F.coalesce(F.try_divide(F.size(F.filter(shared, lambda i: ca(i) != cb(i))).cast("double"), F.size(shared)), F.lit(1.0))


def jukes_cantor(p: Column) -> Column:
    return F.when(p >= 0.75, F.lit(float("inf"))).otherwise(-0.75 * F.log(1 - 4 * F.least(p, F.lit(0.7499999)) / 3))


def dn_ds(a: Column, b: Column, code: int = 1) -> Column:
    """Struct of ka and ks from codon pairs: a third of a known pair counts as synonymous site, the rest as other."""
    table = literal_map(T.codon_table(code))
    pairs = F.arrays_zip(codons(a).alias("x"), codons(b).alias("y"))
    known = F.filter(pairs, lambda z: F.try_element_at(table, z["x"]).isNotNull() & F.try_element_at(table, z["y"]).isNotNull())
    n = F.size(known).cast("double")
    changed = F.filter(known, lambda z: z["x"] != z["y"])
    same = F.size(F.filter(changed, lambda z: F.element_at(table, z["x"]) == F.element_at(table, z["y"])))
    ks, ka = F.coalesce(F.try_divide(same * 3.0, n), F.lit(0.0)), F.coalesce(F.try_divide((F.size(changed) - same) * 1.5, n), F.lit(0.0))
    return F.struct(jukes_cantor(ka).alias("ka"), jukes_cantor(ks).alias("ks"))
