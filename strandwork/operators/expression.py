"""Expression operators on long tables: (gene, sample, value)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log2_transform(value: Column, pseudocount: float = 1.0) -> Column:
    return F.log2(value + pseudocount)


def tpm(counts: DataFrame) -> DataFrame:
    """counts: gene, sample, value, length. Reads per kilobase over the sample's sum; a length of 0 gives 0."""
    rpk = F.coalesce(F.try_divide(F.col("value") * 1000.0, F.col("length")), F.lit(0.0))
    with_rpk = counts.withColumn("rpk", rpk)
    total = with_rpk.groupBy("sample").agg(F.sum("rpk").alias("total"))  # a sample is a hot key: joined, not windowed
    return with_rpk.join(total, "sample").select("gene", "sample", F.coalesce(F.try_divide(F.col("rpk") * 1e6, F.col("total")), F.lit(0.0)).alias("tpm"))


def fpkm(counts: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per kilobase and million reads of the sample: `totals` (sample, total), or else the sample's sum; 0 without length or reads."""
    total = counts.groupBy("sample").agg(F.sum("value").alias("total")) if totals is None else totals
    return counts.join(total, "sample").select("gene", "sample", F.coalesce(F.try_divide(F.col("value") * 1e9, F.col("length") * F.col("total")), F.lit(0.0)).alias("fpkm"))


def submatrix(values: DataFrame, genes: list, samples: list) -> DataFrame:
    """The rows of the named genes and samples with their places in the lists (row, column); unknown names are left out."""
    spark = values.sparkSession
    rows = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], f"gene {dict(values.dtypes)['gene']}, row int")
    columns = spark.createDataFrame([(x, i) for i, x in enumerate(samples)], f"sample {dict(values.dtypes)['sample']}, column int")
    return values.join(F.broadcast(rows), "gene").join(F.broadcast(columns), "sample")  # as many rows as the lists have names


BUCKETS = 64
MOST_GROUPS = 10_000


def _ranked(values: DataFrame, group: str, value: str, ties: list[str], descending: bool) -> DataFrame:
    """values with place (1-based row number in the group), rank (that of the first equal value) and size of the group.

    A group's values are dealt to buckets between its quantiles and counted per bucket, so its ranks come from many
    tasks. The quantiles are collected and become fixed numbers of the plan, as approximate ones may differ when they are
    computed again: BUCKETS - 1 for each of at most MOST_GROUPS groups; with more groups one is a small part of all rows
    and is ranked whole.
    """
    spark, kind = values.sparkSession, dict(values.dtypes)[group]
    groups = values.groupBy(group).agg(F.percentile_approx(F.col(value).cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("__cuts"), F.count(F.lit(1)).alias("size"))
    found = groups.limit(MOST_GROUPS + 1).collect()
    if len(found) <= MOST_GROUPS:
        cuts = spark.createDataFrame([tuple(r) for r in found], f"{group} {kind}, __cuts array<double>, size long")
        dealt = values.join(F.broadcast(cuts), group).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(value))))
    else:
        dealt = values.join(groups.withColumn("__cuts", F.lit(None).cast("array<double>")), group).withColumn("__b", F.lit(0))
    order = F.col("__b").desc() if descending else F.col("__b")
    per = dealt.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__c"))
    per = per.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    own = F.col(value).desc() if descending else F.col(value)
    w = Window.partitionBy(group, "__b")
    dealt = dealt.withColumn("__own", F.row_number().over(w.orderBy(own, *ties))).withColumn("__rank", F.rank().over(w.orderBy(own)))
    out = dealt.join(per, [group, "__b"])
    return out.withColumn("place", F.col("__own") + F.col("__before")).withColumn("rank", F.col("__rank") + F.col("__before")).drop("__cuts", "__b", "__own", "__rank", "__before")


def size_factors(counts: DataFrame) -> DataFrame:
    """Per sample the upper median of the ratios to the genes' geometric means over their nonzero samples."""
    some = counts.where(F.col("value") > 0)
    mean = some.groupBy("gene").agg(F.exp(F.avg(F.log("value"))).alias("g"))
    ratios = some.join(mean, "gene").select("sample", "gene", (F.col("value") / F.col("g")).alias("ratio"))
    ranked = _ranked(ratios, "sample", "ratio", ["gene"], False)
    return ranked.where(F.col("place") == F.floor(F.col("size") / 2) + 1).select("sample", F.col("ratio").alias("factor"))


def quantile_normalise(values: DataFrame) -> DataFrame:
    """Each value becomes the mean over samples of the values at its rank; ties take the highest rank's mean."""
    ranked = _ranked(values, "sample", "value", ["gene"], True)
    means = ranked.groupBy(F.col("place").alias("rank")).agg(F.avg("value").alias("mean"))
    return ranked.join(means, "rank").select("gene", "sample", F.col("mean").alias("value"))


def welch(values: DataFrame, case: Column) -> DataFrame:
    """Per gene the means of case and control, their log2 fold change, Welch's t and degrees of freedom."""
    other = ~case
    pick = lambda c: F.when(c, F.col("value"))
    g = values.groupBy("gene").agg(F.avg(pick(case)).alias("m1"), F.avg(pick(other)).alias("m2"), F.var_samp(pick(case)).alias("v1"), F.var_samp(pick(other)).alias("v2"), F.count(pick(case)).alias("n1"), F.count(pick(other)).alias("n2"))
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    fine = (F.col("n1") > 1) & (F.col("n2") > 1) & (s1 + s2 > 0)
    t = F.when(fine, (F.col("m1") - F.col("m2")) / F.sqrt(s1 + s2)).otherwise(0.0)
    df = F.when(fine, F.try_divide((s1 + s2) * (s1 + s2), s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1)))
    lfc = F.log2((F.coalesce("m1", F.lit(0.0)) + 1) / (F.coalesce("m2", F.lit(0.0)) + 1))
    return g.select("gene", "n1", "n2", "m1", "m2", lfc.alias("lfc"), t.alias("t"), df.alias("df"))


def t_p_values(tests: DataFrame) -> DataFrame:
    """Two-sided Student p-values of t and df, by the continued fraction of the incomplete beta function."""

    def run(batches):
        for b in batches:
            yield b.assign(p=[_p(t, d) for t, d in zip(b["t"], b["df"])])

    return tests.mapInPandas(run, tests.withColumn("p", F.lit(0.0)).schema)


def _p(t: float, df: float) -> float:
    if df is None or pd.isna(df) or df <= 0:
        return 1.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    value = front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b
    return min(1.0, max(0.0, value))


def _fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny)
    if 1 - (a + b) * x / (a + 1) < 0:
        d = -d
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "gene") -> DataFrame:
    """p * n / rank, at most 1, not made monotone. Ranks come from counts per bucket of p, so no task sorts all tests; null p stays null."""
    ranked = _ranked(tests.where(F.col(p).isNotNull()).withColumn("__all", F.lit(0)), "__all", p, [key], False)
    fine = ranked.withColumn("padj", F.least(F.col(p) * F.col("size") / F.col("place"), F.lit(1.0))).drop("__all", "size", "place", "rank")
    return fine.unionByName(tests.where(F.col(p).isNull()).withColumn("padj", F.lit(None).cast("double")))


def flags(tests: DataFrame, min_mean: float = 1.0, fold: float = 1.0, level: float = 0.05) -> DataFrame:
    """Tests (m1, m2, lfc, padj) of genes with a mean of min_mean in a group: significant, up and down."""
    some = tests.where(F.greatest(F.coalesce("m1", F.lit(0.0)), F.coalesce("m2", F.lit(0.0))) >= min_mean)
    hit = F.coalesce((F.col("padj") <= level) & (F.abs("lfc") >= fold), F.lit(False))
    return some.withColumn("significant", hit).withColumn("up", hit & (F.col("lfc") > 0)).withColumn("down", hit & (F.col("lfc") < 0))


def z_score(lfc: Column, p: Column) -> Column:
    """Signed logarithm of a p-value, at most 300."""
    return -F.signum(lfc) * F.greatest(F.log10(p), F.lit(-300.0))


BLOCK = 256


def _correlation(least: int):
    """Arrow function: of one task (x, y) the correlations of all pairs of genes of two blocks, over the samples both have."""
    import numpy as np
    import pyarrow as pa

    def run(table):
        own, x, y = (np.array(table.column(c)) for c in ("own", "x", "y"))
        samples, col = np.unique(np.array(table.column("sample")), return_inverse=True)
        genes, row = np.unique(np.array(table.column("gene")), return_inverse=True)
        v, has = np.zeros((len(genes), len(samples))), np.zeros((len(genes), len(samples)))
        v[row, col], has[row, col] = np.array(table.column("value"), dtype=float), 1.0
        block = np.zeros(len(genes), np.int64)
        block[row] = own
        v -= (v.sum(1) / np.maximum(has.sum(1), 1))[:, None] * has  # centred: the sums below lose no digits
        p, q = np.flatnonzero(block == x[0]), np.flatnonzero(block == y[0])
        a, b, ma, mb = v[p], v[q], has[p], has[q]
        n, sa, sb, ab = ma @ mb.T, a @ mb.T, ma @ b.T, a @ b.T
        with np.errstate(invalid="ignore", divide="ignore"):
            va, vb = (a * a) @ mb.T - sa * sa / n, ma @ (b * b).T - sb * sb / n
            r = (ab - sa * sb / n) / np.sqrt(va * vb)
        r[~np.isfinite(r) | (va <= 1e-9) | (vb <= 1e-9)] = 0.0
        i, j = np.nonzero((n >= max(least, 1)) & (genes[p][:, None] < genes[q][None, :]) if x[0] == y[0] else n >= max(least, 1))
        g, h = genes[p][i], genes[q][j]
        names = [pa.array(np.minimum(g, h)), pa.array(np.maximum(g, h)), pa.array(n[i, j].astype(np.int64)), pa.array(np.clip(r[i, j], -1.0, 1.0))]
        return pa.Table.from_arrays(names, names=["a", "b", "n", "r"])

    return run


def correlations(values: DataFrame, least: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b, n, r) over all pairs of genes that share at least `least` samples; r is 0 without variance.

    Genes (whole numbers) are dealt to blocks, and each pair of blocks is a task of matrix products, so a value travels
    once per block and no pair is shuffled.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(values.select("gene").distinct().count()) / block)).cast("int")
    rows = values.select(F.col("gene").cast("long"), "sample", F.col("value").cast("double")).withColumn("own", F.pmod(F.xxhash64("gene"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    return rows.groupBy("x", "y").applyInArrow(_correlation(least), "a long, b long, n long, r double")


TILE = 2048


def _strong(threshold: float, least: int, most: int | None):
    """Arrow function: of one task (x, y) the pairs of genes of two blocks with |r| from the threshold on; with `most` only the strongest.

    Genes with values in the same samples form a class. For two classes r is one product of unit vectors over the samples
    of both, in single precision; what comes near the threshold is computed again in double. Where classes hold few genes
    each, tiles of the general formula do the same.
    """
    import numpy as np
    import pyarrow as pa

    def run(table):
        own, x, y, genes = (np.array(table.column(c)) for c in ("own", "x", "y", "gene"))
        lists = table.column("p").combine_chunks()
        size = np.diff(np.array(lists.offsets))
        flat = lists.flatten()
        row = np.repeat(np.arange(len(genes)), size)
        samples, col = np.unique(np.array(flat.field("sample")), return_inverse=True)
        v, has = np.zeros((len(genes), len(samples))), np.zeros((len(genes), len(samples)), bool)
        v[row, col], has[row, col] = np.array(flat.field("value"), dtype=float), True
        v -= (v.sum(1) / np.maximum(has.sum(1), 1))[:, None] * has  # centred: the sums below lose no digits
        p, q = np.flatnonzero(own == x[0]), np.flatnonzero(own == y[0])
        found, least_r = [], threshold

        def keep(i, j, n, r):
            nonlocal found, least_r
            g, h = genes[i], genes[j]
            fine = (np.abs(r) >= least_r) & ((g < h) if x[0] == y[0] else True)
            found.append((np.minimum(g, h)[fine], np.maximum(g, h)[fine], n[fine], r[fine]))
            if most is not None and sum(len(f[0]) for f in found) > 4 * most:
                trim()

        def trim():
            nonlocal found, least_r
            f = [np.concatenate(c) for c in zip(*found)]
            strength = np.floor(np.abs(f[3]) * 1e9 + 0.5)
            best = np.lexsort((f[1], f[0], -strength))[:most]
            found = [tuple(c[best] for c in f)]
            if len(best) == most:
                least_r = max(threshold, strength[best[-1]] / 1e9 - 1e-9)

        def classes(at):
            kinds, which = np.unique(has[at], axis=0, return_inverse=True)
            return [(k, at[which == n]) for n, k in enumerate(kinds)]

        left, right = classes(p), classes(q)
        if len(left) * len(right) * 4096 <= len(p) * len(q) or len(left) * len(right) <= 4096:
            for a, at in left:
                for b, to in right:
                    both = np.flatnonzero(a & b)
                    if len(both) < max(least, 1):
                        continue
                    u, w = v[np.ix_(at, both)], v[np.ix_(to, both)]
                    u, w = u - u.mean(1)[:, None], w - w.mean(1)[:, None]
                    nu, nw = (u * u).sum(1), (w * w).sum(1)
                    u, w = u[nu > 1e-9] / np.sqrt(nu[nu > 1e-9])[:, None], w[nw > 1e-9] / np.sqrt(nw[nw > 1e-9])[:, None]
                    i_of, j_of = at[nu > 1e-9], to[nw > 1e-9]
                    us, ws = u.astype(np.float32), np.ascontiguousarray(w.astype(np.float32).T)
                    for i in range(0, len(us), TILE):
                        for j in range(0, ws.shape[1], TILE):
                            r = us[i : i + TILE] @ ws[:, j : j + TILE]
                            near = np.flatnonzero(np.abs(r, out=r).ravel() >= np.float32(least_r - 1e-4))
                            if len(near):
                                m, k = np.divmod(near, r.shape[1])
                                exact = np.einsum("ij,ij->i", u[m + i], w[k + j])
                                keep(i_of[m + i], j_of[k + j], np.full(len(m), len(both)), np.clip(exact, -1.0, 1.0))
        else:
            for i in range(0, len(p), 256):
                for j in range(0, len(q), 256):
                    s, t = p[i : i + 256], q[j : j + 256]
                    a, b, ma, mb = v[s], v[t], has[s].astype(float), has[t].astype(float)
                    n, sa, sb, ab = ma @ mb.T, a @ mb.T, ma @ b.T, a @ b.T
                    with np.errstate(invalid="ignore", divide="ignore"):
                        va, vb = (a * a) @ mb.T - sa * sa / n, ma @ (b * b).T - sb * sb / n
                        r = (ab - sa * sb / n) / np.sqrt(va * vb)
                    m, k = np.nonzero(np.isfinite(r) & (va > 1e-9) & (vb > 1e-9) & (n >= max(least, 1)) & (np.abs(r) >= least_r))
                    keep(s[m], t[k], n[m, k].astype(np.int64), np.clip(r[m, k], -1.0, 1.0))
        if found and most is not None:
            trim()
        f = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(f, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "n", "r"])

    return run


def _profiles(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kinds of genes with equal values: (p, gene: the smallest of the kind, second: its next, fine: enough variance); and members (gene, kind)."""
    pair = F.struct("sample", F.col("value").cast("double").alias("value"))
    each = values.where(F.col("value").isNotNull()).groupBy(F.col("gene").cast("long").alias("gene")).agg(F.sort_array(F.collect_list(pair)).alias("p"))
    kinds = each.groupBy("p").agg(F.min("gene").alias("kind"))
    return kinds, each.join(kinds, "p").select("gene", "kind")


def _kind_edges(kinds: DataFrame, threshold: float, least: int, most: int | None, block: int | None = None) -> DataFrame:
    """(a, b, n, r) of pairs of different kinds, by blocks that grow with the kinds: a profile travels at most 16 times until blocks are full."""
    count = kinds.count()
    block = block or min(1 << 17, max(1 << 12, -(-count // 16)))
    blocks = max(1, -(-count // block))
    rows = kinds.select(F.col("kind").alias("gene"), "p").withColumn("own", F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    return rows.groupBy("x", "y").applyInArrow(_strong(threshold, least, most), "a long, b long, n long, r double")


def _alike(kinds: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """Kinds of at least two genes and enough samples and variance: r is 1 among their members."""
    x = F.transform("p", lambda e: e["value"])
    mean = F.aggregate(x, F.lit(0.0), lambda t, e: t + e) / F.size("p")
    varied = F.aggregate(x, F.lit(0.0), lambda t, e: t + (e - mean) * (e - mean)) > 1e-9
    several = members.groupBy("kind").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("gene") != F.col("kind"), F.col("gene"))).alias("second")).where("size > 1")
    return kinds.where((F.size("p") >= max(least, 1)) & varied).select("kind", F.size("p").cast("long").alias("n")).join(several, "kind")


def _expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of kinds (a, b, n, r) to the pairs of their genes."""
    one, two = members.select(F.col("kind").alias("a"), F.col("gene").alias("g")), members.select(F.col("kind").alias("b"), F.col("gene").alias("h"))
    both = pairs.join(one, "a").join(two, "b").where((F.col("a") != F.col("b")) | (F.col("g") < F.col("h")))
    return both.select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), "n", "r")


def edges(values: DataFrame, threshold: float, least: int = 3, block: int | None = None) -> DataFrame:
    """(a, b, n, r) of all pairs of genes that share at least `least` samples and have |r| from the threshold (above 0) on.

    Genes of equal values are compared as one kind and expanded afterwards; kinds meet in blocks, and no weak pair leaves a task.
    """
    kinds, members = _profiles(values)
    same = _alike(kinds, members, least).select(F.col("kind").alias("a"), F.col("kind").alias("b"), "n", F.lit(1.0).alias("r")).where(F.lit(threshold <= 1))
    return _expanded(_kind_edges(kinds, threshold, least, None, block).unionByName(same), members)


def top_edges(values: DataFrame, threshold: float = 0.8, most: int = 100, least: int = 3, block: int | None = None) -> DataFrame:
    """The `most` strongest pairs of genes with |r| from the threshold on.

    Each task keeps its strongest `most`. A pair of kinds ranks by its smallest pair of genes, so the first `most` pairs of
    kinds hold the first `most` pairs of genes, and of a kind its `most` + 1 smallest genes suffice.
    """
    kinds, members = _profiles(values)
    order = [F.round(F.abs("r"), 9).desc(), "a", "b"]
    apart = _kind_edges(kinds, threshold, least, most, block).select("a", "b", "n", "r", F.col("b").alias("to"))
    same = _alike(kinds, members, least).select(F.col("kind").alias("a"), F.col("second").alias("b"), "n", F.lit(1.0).alias("r"), F.col("kind").alias("to")).where(F.lit(threshold <= 1))
    first = apart.unionByName(same).orderBy(*order).limit(most).select("a", F.col("to").alias("b"), "n", "r")
    w = Window.partitionBy("kind").orderBy("gene")
    few = members.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most + 1).drop("__r")
    return _expanded(first, few).orderBy(*order).limit(most)


def coexpressed(values: DataFrame, gene, threshold: float = 0.7, most: int = 20, least: int = 3) -> DataFrame:
    """The `most` genes whose values go with one gene's, |r| from the threshold on."""
    return correlated_with(values, gene, least).where(F.abs("r") >= threshold).orderBy(F.round(F.abs("r"), 9).desc(), "gene").limit(most)


def correlated_with(values: DataFrame, gene, least: int = 3) -> DataFrame:
    """(gene, n, r) of all other genes with one gene, whose few rows are broadcast."""
    one = F.broadcast(values.where(F.col("gene") == gene).select("sample", F.col("value").alias("x")))
    r = values.where(F.col("gene") != gene).join(one, "sample").groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "value").alias("r"))
    return r.where(F.col("n") >= least).withColumn("r", F.when(F.isnan("r") | F.col("r").isNull(), 0.0).otherwise(F.col("r")))


def tau(values: DataFrame) -> DataFrame:
    """Tissue specificity of each gene and its class."""
    g = values.groupBy("gene").agg(F.max("value").alias("top"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    t = F.when((F.col("top") > 0) & (F.col("n") > 1), F.try_divide(F.col("n") - F.col("s") / F.col("top"), F.col("n") - 1)).otherwise(0.0)
    name = F.when(F.col("tau") >= 0.85, "Highly tissue-specific").when(F.col("tau") >= 0.65, "Tissue-enhanced").when(F.col("tau") >= 0.35, "Mixed/tissue-preferred").otherwise("Housekeeping / broadly expressed")
    return g.select("gene", t.alias("tau")).withColumn("pattern", name)


def enrichment(sets: DataFrame, chosen: DataFrame, background: int) -> DataFrame:
    """Per set its size, the chosen genes in it, ratio to expectation and hypergeometric upper tail; the tail is 1 where the background is smaller than the set or the choice."""
    total = chosen.select("gene").distinct().count()
    hit = sets.join(chosen.select("gene").distinct().withColumn("hit", F.lit(1)), "gene", "left").groupBy("set").agg(F.count(F.lit(1)).alias("size"), F.count("hit").alias("overlap"))

    def run(batches):
        c = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        for b in batches:
            out = []
            for size, k in zip(b["size"], b["overlap"]):
                if max(size, total) > background:
                    out.append(1.0)
                    continue
                top = min(size, total)
                out.append(min(1.0, sum(math.exp(c(size, i) + c(background - size, total - i) - c(background, total)) for i in range(k, top + 1) if total - i <= background - size)))
            yield b.assign(ratio=b["overlap"] / (b["size"] * total / background), p=out)

    return hit.mapInPandas(run, "set string, size long, overlap long, ratio double, p double")
