"""Gene annotation operators: spans are 1-based and inclusive at both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.relational import interval_join, outside


def annotate(variants: DataFrame, genes: DataFrame, width: int = 4096, most: int = 2000) -> DataFrame:
    """(variant id, chrom, pos) by the genes that hold it, or else by the nearest gene within `most` bases.

    genes: gene, chrom, st, en, strand. Result: place (genic, upstream or downstream) and distance. A variant stands in
    one bin, so the join that finds the genes around it also tells whether one holds it, and no pair is shuffled: only
    those without any go on to the nearest one. Ids may repeat: an id with a row in a gene has no nearest gene.
    """
    inside = interval_join(variants, genes, "pos", "st", "en", ["chrom"], width).select("id", "chrom", "pos", "gene", F.lit("genic").alias("place"), F.lit(0).cast("long").alias("distance"))
    free = outside(variants, genes, "pos", "st", "en", ["chrom"], width)
    held = outside(variants, genes, "pos", "st", "en", ["chrom"], width, held=True).select("id")
    free = free.join(held.hint("shuffle_hash"), "id", "left_anti")
    near = interval_join(free, genes.withColumn("__from", F.col("st") - most).withColumn("__to", F.col("en") + most), "pos", "__from", "__to", ["chrom"], width)
    edge = F.least(F.abs(F.col("st") - F.col("pos")), F.abs(F.col("en") - F.col("pos"))).cast("long")
    up = ((F.col("strand") == "+") & (F.col("pos") < F.col("st"))) | ((F.col("strand") == "-") & (F.col("pos") > F.col("en")))
    best = near.groupBy("id").agg(F.min(F.struct(edge.alias("distance"), "gene", "chrom", "pos", F.when(up, "upstream").otherwise("downstream").alias("place"))).alias("x"))
    return inside.unionByName(best.select("id", "x.chrom", "x.pos", "x.gene", "x.place", "x.distance"))


def consequence(snp: Column, feature: Column) -> Column:
    other = F.when(feature == "CDS", "frameshift").when(feature == "exon", "exon_indel").otherwise("indel")
    names = {"CDS": "missense_or_synonymous", "exon": "exon_SNP", "UTR": "UTR_SNP", "intron": "intronic", "upstream": "upstream_variant", "downstream": "downstream_variant"}
    same = F.lit("unknown")
    for place, name in names.items():
        same = F.when(feature == place, name).otherwise(same)
    return F.when(snp, same).otherwise(other)


def feature_at(points: DataFrame, parts: DataFrame, width: int = 4096) -> DataFrame:
    """CDS, exon, UTR or intron for (id, tx, pos), by the parts (tx, type, st, en) of its transcript: the first in that order."""
    rank = F.when(F.lower("type") == "cds", 1).when(F.lower("type") == "exon", 2).when(F.lower("type").contains("utr"), 3)
    hit = interval_join(points, parts.withColumn("rank", rank).where("rank is not null"), "pos", "st", "en", ["tx"], width).groupBy("id").agg(F.min("rank").alias("rank"))
    name = F.when(F.col("rank") == 1, "CDS").when(F.col("rank") == 2, "exon").when(F.col("rank") == 3, "UTR").otherwise("intron")
    return points.join(hit, "id", "left").withColumn("feature", name).drop("rank")


def gene_models(genes: DataFrame, transcripts: DataFrame, parts: DataFrame) -> DataFrame:
    """Genes with their transcripts, each with its parts in order of transcription; genes without any are kept.

    With a strand in genes, the parts of a transcript on the minus strand stand in descending order.
    """
    listed = parts.groupBy("tx").agg(F.sort_array(F.collect_list(F.struct("st", "en", "type"))).alias("parts"))
    t = transcripts.join(listed, "tx", "left")
    if "strand" in genes.columns:
        t = t.join(genes.select("gene", "strand"), "gene", "left").withColumn("parts", F.when(F.col("strand") == "-", F.reverse("parts")).otherwise(F.col("parts"))).drop("strand")
    return genes.join(t.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("tx", "parts"))).alias("transcripts")), "gene", "left")


def flat_gene_models(parts: DataFrame) -> DataFrame:
    """Genes of a file without gene rows: one per transcript of (tx, chrom, type, st, en, strand), over the span of its parts."""
    g = parts.groupBy("tx").agg(F.first("chrom").alias("chrom"), F.min("st").alias("st"), F.max("en").alias("en"), F.first("strand").alias("strand"))
    return g.select(F.concat(F.lit("gene_"), F.col("tx").cast("string")).alias("gene"), "tx", "chrom", "st", "en", "strand")


def primary_transcripts(transcripts: DataFrame, parts: DataFrame) -> DataFrame:
    """Of each gene the transcript with the longest coding parts, the first on ties."""
    size = transcripts.join(parts, "tx").groupBy("gene", "tx").agg(F.sum(F.col("en") - F.col("st") + 1).alias("cds_length"))
    w = Window.partitionBy("gene").orderBy(F.col("cds_length").desc(), "tx")
    return size.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def promoters(genes: DataFrame, up: int = 2000, down: int = 200) -> DataFrame:
    plus = F.col("strand") == "+"
    start = F.when(plus, F.col("st") - up).otherwise(F.col("en") - down)
    end = F.when(plus, F.col("st") + down).otherwise(F.col("en") + up)
    return genes.select("gene", "chrom", F.greatest(start, F.lit(1)).alias("p_start"), end.alias("p_end"))


def introns(parts: DataFrame) -> DataFrame:
    """Gaps between consecutive parts of a transcript."""
    w = Window.partitionBy("tx").orderBy("st", "en")
    return parts.withColumn("next", F.lead("st").over(w)).where(F.col("next") > F.col("en") + 1).select("tx", (F.col("en") + 1).alias("i_start"), (F.col("next") - 1).alias("i_end"))


def splice_sites(gaps: DataFrame) -> DataFrame:
    return gaps.select(F.explode(F.array("i_start", "i_end")).alias("site")).distinct()
