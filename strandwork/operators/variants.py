"""Variant operators on long genotype tables: (chrom, pos, sample, dos), dos the count of alternative alleles or null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.relational import windows_of

SITE = ["chrom", "pos"]
# Domestication loci as chromosome, position, gene.
DOMESTICATION = [("chr01", 38286560, "Rc"), ("chr04", 3545070, "Wx"), ("chr07", 13476000, "sh4"), ("chr03", 9027843, "Prog1"), ("chr01", 6691563, "GS3"), ("chr06", 1621227, "GW5"), ("chr08", 25563000, "OsC1"), ("chr11", 4267500, "Hd1")]


def is_snp(ref: Column, alts: Column) -> Column:
    return (F.length(ref) == 1) & F.forall(alts, lambda a: F.length(a) == 1)


def is_indel(ref: Column, alts: Column) -> Column:
    return ~is_snp(ref, alts) & F.exists(alts, lambda a: a != ".")


def is_multiallelic(alts: Column) -> Column:
    return F.size(alts) > 1


def is_transversion(ref: Column, alts: Column) -> Column:
    """A single-base change to the first alternative that is no transition."""
    return is_snp(ref, alts) & ~is_transition(ref, F.get(alts, F.lit(0)))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def alleles(gt: Column) -> Column:
    return F.split(gt, r"[/|]")


def is_missing(gt: Column) -> Column:
    return gt.isin("./.", ".", ".|.")


def dosage(gt: Column) -> Column:
    """Alternative alleles of a call such as 0|1; a missing allele of a half call is not counted."""
    return F.when(~is_missing(gt), F.size(F.filter(alleles(gt), lambda a: ~a.isin("0", "."))).cast("int"))


def is_phased(gt: Column) -> Column:
    return gt.contains("|")


def _kinds(gt: Column) -> Column:
    return F.array_distinct(alleles(gt))


def is_hom(gt: Column) -> Column:
    return ~is_missing(gt) & (F.size(_kinds(gt)) == 1)


def is_het(gt: Column) -> Column:
    return ~is_missing(gt) & (F.size(_kinds(gt)) > 1)


def is_hom_ref(gt: Column) -> Column:
    return is_hom(gt) & (F.get(alleles(gt), F.lit(0)) == "0")


def is_hom_alt(gt: Column) -> Column:
    return is_hom(gt) & ~F.get(alleles(gt), F.lit(0)).isin("0", ".")


def depth(fields: Column) -> Column:
    return F.try_element_at(fields, F.lit("DP")).try_cast("int")


def quality(fields: Column) -> Column:
    return F.try_element_at(fields, F.lit("GQ")).try_cast("int")


def allele_depths(fields: Column) -> Column:
    return F.transform(F.split(F.try_element_at(fields, F.lit("AD")), ","), lambda x: x.try_cast("int"))


def chromosome_index(chrom: Column) -> Column:
    """Sort key of a chromosome: its digits, or a number beyond them by hash."""
    digits = F.regexp_replace(chrom, "[^0-9]", "").try_cast("long")
    return F.coalesce(digits, F.lit(1 << 40) + F.pmod(F.xxhash64(chrom), F.lit(1 << 20)))


def allele_frequencies(calls: DataFrame) -> DataFrame:
    """(chrom, pos, allele, count, frequency) of the called alleles of (chrom, pos, ref, alt array, gt): bases, reference included.

    An allele that no call has counts 0; sites without calls have frequency 0.
    """
    names = F.concat(F.array("ref"), F.col("alt"))
    one = calls.where(~is_missing(F.col("gt"))).select(*SITE, F.explode(F.filter(alleles(F.col("gt")), lambda a: ~a.isin(".", "*"))).alias("code")).groupBy(*SITE, F.col("code").try_cast("int").alias("code")).count()
    listed = calls.select(*SITE, names.alias("names")).distinct().select(*SITE, F.posexplode("names").alias("code", "allele"))
    n = listed.join(one, [*SITE, "code"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy(*SITE))
    return n.select(*SITE, "allele", "count", F.coalesce(F.try_divide(F.col("count").cast("double"), total), F.lit(0.0)).alias("frequency"))


def minor_frequency(frequencies: DataFrame) -> DataFrame:
    """maf of each site: the share of its second commonest allele, 0 with one allele."""
    w = Window.partitionBy(*SITE).orderBy(F.col("count").desc(), "allele")
    second = F.max(F.when(F.col("r") == 2, F.col("frequency")))
    return frequencies.withColumn("r", F.row_number().over(w)).groupBy(*SITE).agg(F.coalesce(second, F.lit(0.0)).alias("maf"))


def summarise_records(records: DataFrame, maf: DataFrame) -> DataFrame:
    """One row: counts of records by class, transitions to transversions, mean maf and missing rate, singletons.

    records: chrom, pos, ref, alt array, n (samples) and missing (rate) per site; maf: chrom, pos, maf.
    """
    snp, ts = is_snp(F.col("ref"), F.col("alt")), is_transition(F.col("ref"), F.get("alt", F.lit(0)))
    joined = records.join(maf, SITE)
    rows = joined.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(snp).alias("snps"), F.count_if(is_indel(F.col("ref"), F.col("alt"))).alias("indels"), F.count_if(is_multiallelic(F.col("alt"))).alias("multiallelic"), F.count_if(snp & ts).alias("transitions"),
        F.count_if(is_transversion(F.col("ref"), F.col("alt"))).alias("transversions"), F.avg("maf").alias("mean_maf"), F.avg("missing").alias("mean_missing"),
        F.count_if((F.col("maf") > 0) & (F.col("maf") <= 1 / F.greatest(2 * F.col("n"), F.lit(1)))).alias("singletons"),
    )
    return rows.withColumn("ts_tv", F.coalesce(F.try_divide(F.col("transitions").cast("double"), F.col("transversions")), F.lit(0.0)))


def subset(calls: DataFrame, samples: list) -> DataFrame:
    """The calls of the named samples; sites that none of them has are kept as rows without a sample."""
    kept = calls.where(F.col("sample").isin(samples))
    gone = calls.select(*SITE).distinct().join(kept.select(*SITE).distinct(), SITE, "left_anti")
    return kept.unionByName(gone, allowMissingColumns=True)


def sites(geno: DataFrame) -> DataFrame:
    """Per site: n, called, p (alternative frequency), maf, het and missing rates."""
    g = geno.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n"), F.count("dos").alias("called"), F.sum("dos").cast("long").alias("alt"), F.count_if(F.col("dos") == 1).alias("hets"))
    p = F.try_divide(F.col("alt").cast("double"), 2 * F.col("called"))
    g = g.withColumn("p", F.coalesce(p, F.lit(0.0)))
    return g.withColumn("maf", F.least("p", 1 - F.col("p"))).withColumn("het", F.coalesce(F.try_divide(F.col("hets").cast("double"), F.col("called")), F.lit(0.0))).withColumn("missing", 1 - F.col("called") / F.col("n"))


def passing(site: DataFrame, min_maf: float = 0.0, max_missing: float = 1.0) -> DataFrame:
    return site.where((F.col("maf") >= min_maf) & (F.col("missing") <= max_missing))


def summarise(site: DataFrame) -> DataFrame:
    return site.agg(F.count(F.lit(1)).alias("n_sites"), F.countDistinct("chrom").alias("n_chroms"), F.avg("maf").alias("avg_maf"), F.avg("missing").alias("avg_missing"), F.count_if((F.col("maf") > 0) & (F.col("maf") <= 1 / F.greatest(2 * F.col("n"), F.lit(1)))).alias("singletons"))


UNITS = 10**12


def _pairwise() -> Column:
    """2pq in whole units of 1e-12: their sums do not depend on the order."""
    return F.round(2 * F.col("p") * (1 - F.col("p")) * UNITS).cast("long")


def tumbling(site: DataFrame, size: int) -> DataFrame:
    """Per chromosome all windows from 1 to the last site: n_snps and pi (sum of 2pq per base), empty windows too."""
    grid = site.groupBy("chrom").agg(F.max("pos").alias("last")).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / size).cast("long"))).alias("k"))
    each = site.groupBy("chrom", F.floor((F.col("pos") - 1) / size).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("c"), (F.sum(_pairwise()) / F.lit(float(UNITS))).alias("s"))
    return grid.join(each, ["chrom", "k"], "left").select("chrom", (F.col("k") * size + 1).alias("start"), F.coalesce("c", F.lit(0)).alias("n_snps"), (F.coalesce("s", F.lit(0.0)) / size).alias("pi"))


def _sums(n: int) -> tuple[float, float]:
    return sum(1 / i for i in range(1, n)), sum(1 / i / i for i in range(1, n))


def diversity(site: DataFrame, samples: int, size: int, step: int) -> DataFrame:
    """Hopping windows that hold sites: n_snps, pi, theta_w and Tajima's D for 2 * samples sequences."""
    n = 2 * samples
    a1, a2 = _sums(n)
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    e1, e2 = c1 / a1, c2 / (a1 * a1 + a2)
    seg = site.where((F.col("p") > 0) & (F.col("p") < 1))
    w = seg.withColumn("k", F.explode(windows_of(F.col("pos"), size, step))).groupBy("chrom", "k")
    w = w.agg(F.count(F.lit(1)).alias("n_snps"), (F.sum(_pairwise()) / F.lit(float(UNITS))).alias("h"))
    s = F.col("n_snps").cast("double")
    d = (F.col("h") * n / (n - 1) - s / a1) / F.sqrt(e1 * s + e2 * s * (s - 1))
    return w.select("chrom", (F.col("k") * step + 1).alias("start"), "n_snps", (F.col("h") / size).alias("pi"), (s / (a1 * size)).alias("theta_w"), F.when(F.col("n_snps") < 2, F.lit(0.0)).otherwise(d).alias("tajima_d"))


def outlier_windows(windows: DataFrame, value: str = "pi", least: int = 5, z: float = 2.0) -> DataFrame:
    """Windows of at least `least` sites whose value lies z population deviations from the mean of all such windows."""
    some = windows.where(F.col("n_snps") >= least)
    stats = some.agg(F.avg(value).alias("__m"), F.greatest(F.stddev_pop(value), F.lit(0.001)).alias("__s"))
    return some.join(F.broadcast(stats)).withColumn("z", (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s").where(F.abs("z") >= z)


def sweeps(one: DataFrame, two: DataFrame, size: int, step: int, least: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Hopping windows over the sites of both populations: mean Fst, mean frequency difference and score.

    Sites are the same where chrom, pos and the columns of `also` are, such as the reference and alternative alleles.
    """
    key = [*SITE, *also]
    both = one.select(*key, F.col("p").alias("p1")).join(two.select(*key, F.col("p").alias("p2")), key)
    mid = (F.col("p1") + F.col("p2")) / 2
    ht, hs = 2 * mid * (1 - mid), F.col("p1") * (1 - F.col("p1")) + F.col("p2") * (1 - F.col("p2"))
    both = both.withColumn("fst", F.coalesce(F.try_divide(ht - hs, ht), F.lit(0.0))).withColumn("dp", F.abs(F.col("p1") - F.col("p2")))
    w = both.withColumn("k", F.explode(windows_of(F.col("pos"), size, step))).groupBy("chrom", "k").agg(F.count(F.lit(1)).alias("n_snps"), F.avg("fst").alias("fst"), F.avg("dp").alias("dp")).where(F.col("n_snps") >= least)
    return w.select("chrom", (F.col("k") * step + 1).alias("start"), "n_snps", "fst", "dp", (F.col("fst") * F.col("dp") * F.log(F.col("n_snps") + 1.0)).alias("score"))


def ld_pairs(geno: DataFrame, span: int, least: int = 4) -> DataFrame:
    """r2 and D' of all pairs of sites at most `span` apart, from the samples that both have.

    Sites meet through bins of the span's width, so no pair beyond two neighbouring bins is made.
    """
    called = geno.where(F.col("dos").isNotNull()).select("chrom", "pos", "sample", (F.col("dos") / 2.0).alias("f")).withColumn("bin", F.floor(F.col("pos") / span).cast("long"))
    other = called.select("chrom", F.col("pos").alias("pos2"), "sample", F.col("f").alias("f2"), F.explode(F.array("bin", F.col("bin") - 1)).alias("bin"))
    both = called.join(other, ["chrom", "sample", "bin"]).where((F.col("pos") < F.col("pos2")) & (F.col("pos2") - F.col("pos") <= span))
    s = both.groupBy("chrom", "pos", "pos2").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("f") * F.col("f2")).alias("n11"), F.sum("f").alias("s1"), F.sum("f2").alias("s2")).where(F.col("n") >= least)
    s = s.withColumn("p1", F.col("s1") / F.col("n")).withColumn("p2", F.col("s2") / F.col("n")).withColumn("d", F.col("n11") / F.col("n") - F.col("p1") * F.col("p2"))
    q1, q2 = 1 - F.col("p1"), 1 - F.col("p2")
    var = F.col("p1") * q1 * F.col("p2") * q2
    top = F.when(F.col("d") > 0, F.least(F.col("p1") * q2, q1 * F.col("p2"))).otherwise(F.least(F.col("p1") * F.col("p2"), q1 * q2))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    r2 = F.when(var > 1e-12, unit(F.col("d") * F.col("d") / var)).otherwise(0.0)
    dprime = F.when((var > 1e-12) & (top > 1e-12), unit(F.abs(F.col("d") / top))).otherwise(0.0)
    return s.select("chrom", "pos", "pos2", "n", r2.alias("r2"), dprime.alias("dprime"))


def _neighbours(pairs: DataFrame, site: DataFrame, span: int) -> DataFrame:
    """(chrom, pos, next, far) of the sites that have a known pair with the next site: far holds pos2 and dprime of all their pairs.

    Sites are put in order within bins of the span's width; the last one of a bin is followed by the first of the bin behind it, or by none within the span.
    """
    far = pairs.groupBy(*SITE).agg(F.collect_list(F.struct("pos2", "dprime")).alias("far"))
    places = site.select(*SITE).distinct().withColumn("bin", F.floor(F.col("pos") / span).cast("long"))
    heads = places.groupBy("chrom", (F.col("bin") - 1).alias("bin")).agg(F.min("pos").alias("head"))
    rows = places.join(far, SITE, "left").withColumn("next", F.lead("pos").over(Window.partitionBy("chrom", "bin").orderBy("pos")))
    rows = rows.where(F.col("far").isNotNull()).join(heads, ["chrom", "bin"], "left").withColumn("next", F.coalesce("next", "head"))
    return rows.where(F.exists("far", lambda x: x["pos2"] == F.col("next"))).select(*SITE, "next", "far")


def haplotype_blocks(pairs: DataFrame, site: DataFrame, strong: float = 0.98, recomb: float = 0.70, share: float = 0.95, span: int = 200_000) -> DataFrame:
    """Greedy blocks: a block grows while enough of its pairs are strong, few show recombination and it stays within `span`.

    All pairs of a block are known, those of neighbouring sites too. So a chromosome falls into runs of sites that each
    have a known pair with the next one; sites outside of runs reach no task, and a task scans many runs, one after another.
    """
    known = F.col("dprime").isNotNull() & ~F.isnan("dprime")
    near = pairs.where((F.col("pos") < F.col("pos2")) & (F.col("pos2") - F.col("pos") <= span) & known)
    order = Window.partitionBy("chrom").orderBy("pos")
    rows = _neighbours(near, site, span).withColumn("before", F.lag("next").over(order))
    first = F.when(F.col("before").eqNullSafe(F.col("pos")), None).otherwise(F.col("pos"))
    rows = rows.withColumn("run", F.last(first, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def scan(pos: list[int], far: list[dict[int, float]]) -> list[tuple[int, int, int]]:
        out, i = [], 0
        while i < len(pos):
            n = hard = soft = 0
            end = i
            for j in range(i + 1, len(pos)):
                found = [far[a].get(pos[j]) for a in range(i, j)]
                if None in found:
                    break
                n, hard, soft = n + len(found), hard + sum(x >= strong for x in found), soft + sum(x <= recomb for x in found)
                if hard < share * n or soft > (1 - share) * n:
                    break
                end = j
            if end > i:
                out.append((pos[i], pos[end], end - i + 1))
            i = end + 1
        return out

    def grow(batches):
        run, pos, far, last = None, [], [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (key := (row["chrom"], row["run"])) != run:
                    out += [(run[0], *x) for x in scan([*pos, last], far)] if pos else []
                    run, pos, far = key, [], []
                pos.append(row["pos"])
                far.append({x["pos2"]: x["dprime"] for x in row["far"]})
                last = row["next"]
            yield _blocks(out)
        yield _blocks([(run[0], *x) for x in scan([*pos, last], far)] if pos else [])

    rows = rows.select("chrom", "run", "pos", "next", "far").repartition("chrom", "run").sortWithinPartitions("chrom", "run", "pos")
    return rows.mapInArrow(grow, "chrom string, start long, end long, n_sites long")


def _blocks(rows: list[tuple[str, int, int, int]]) -> pa.RecordBatch:
    kinds = (("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_sites", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])


def haplotypes(geno: DataFrame, size: int) -> DataFrame:
    """Per window: haplotypes (allele strings over the window's sites), how many there are and their diversity."""
    w = geno.withColumn("start", (F.floor((F.col("pos") - 1) / size) * size + 1).cast("long"))
    call = F.coalesce(F.when(F.col("dos") >= 1, "1").otherwise(F.when(F.col("dos") == 0, "0")), F.lit("?"))
    each = w.groupBy("chrom", "start", "sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", call.alias("c")))), lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), x["c"])), ",").alias("hap"))
    counts = each.groupBy("chrom", "start", "hap").count()
    t = counts.groupBy("chrom", "start").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_haplotypes"), F.sum(F.col("count") * F.col("count")).alias("sq"), F.max("count").alias("largest"))
    return t.select("chrom", "start", "n", "n_haplotypes", "largest", (1 - F.col("sq") / (F.col("n") * F.col("n")).cast("double")).alias("diversity"))


def haplotype_network(haps: DataFrame, group: list[str]) -> DataFrame:
    """Per group of (hap, count) an edge from the commonest haplotype to each other: mutations (unknown letters aside) and samples."""
    w = Window.partitionBy(*group).orderBy(F.col("count").desc(), "hap")
    ranked = haps.withColumn("r", F.row_number().over(w)).withColumn("from", F.first("hap").over(w))
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    differ = F.zip_with(letters("from"), letters("hap"), lambda a, b: ((a != b) & (a != "?") & (b != "?")).cast("int"))
    return ranked.where("r > 1").select(*group, "from", F.col("hap").alias("to"), F.aggregate(differ, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))).cast("long").alias("mutations"), F.col("count").alias("samples"))


def summarise_blocks(blocks: DataFrame) -> DataFrame:
    """One row over blocks (start, end, n_sites, n_haplotypes, diversity): number, means and bases covered."""
    length = F.col("end") - F.col("start") + 1
    return blocks.agg(F.count(F.lit(1)).alias("blocks"), F.avg(length).alias("mean_length"), F.avg("n_sites").alias("mean_sites"), F.avg("n_haplotypes").alias("mean_haplotypes"), F.avg("diversity").alias("mean_diversity"), F.coalesce(F.sum(length), F.lit(0)).alias("bases"))


def subpopulations(geno: DataFrame, least: int, first: int | None = None) -> DataFrame:
    """A group per sample from its rates of heterozygous and alternative calls, over its first sites by position if `first` is given."""
    if first is not None:
        order = Window.partitionBy("sample").orderBy(chromosome_index(F.col("chrom")), "chrom", "pos")
        geno = geno.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= first).drop("__r")
    s = geno.groupBy("sample").agg(F.count("dos").alias("called"), F.avg((F.col("dos") == 1).cast("int")).alias("het"), F.avg((F.col("dos") == 2).cast("int")).alias("hom_alt"))
    name = F.when(F.col("called") < least, "Unknown").when(F.col("het") > 0.15, "Admixed").when(F.col("hom_alt") > 0.45, "Indica").when(F.col("hom_alt") < 0.20, "Japonica").otherwise("Intermediate")
    return s.withColumn("subpopulation", name)


def dosage_matrix(geno: DataFrame, samples: list) -> DataFrame:
    """One row per site, one column per named sample; -1 for missing."""
    wide = geno.groupBy(*SITE).pivot("sample", samples).agg(F.first(F.coalesce("dos", F.lit(-1))))
    return wide.select(*SITE, *(F.coalesce(F.col(f"`{s}`"), F.lit(-1)).alias(f"s{s}") for s in samples))


def domestication_hits(sites_: DataFrame, window: int = 5000) -> DataFrame:
    """The first listed locus within the window of each site."""
    loci = sites_.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(DOMESTICATION)], "chrom string, locus int, gene string, ord int")
    near = sites_.join(F.broadcast(loci), "chrom").where(F.abs(F.col("locus") - F.col("pos")) <= window)
    return near.groupBy(*SITE).agg(F.min_by("gene", "ord").alias("gene"))
