"""Lookups and summaries over gene tables (gene, rap, msu, chrom, st, en, strand) and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAP = r"(?i)Os(\d{2})g(\d{7})"
MSU = r"(?i)LOC_Os(\d{2})g(\d{5})"


def by_id(genes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The gene of each wanted id (column id): by its own id, else by RAP id, else by MSU id; wanted ids without one are left out.

    Each gene stands under its three names with their rank, so one join finds the first that fits.
    """
    names = F.array(*(F.struct(F.col(c).cast("string").alias("id"), F.lit(i).alias("rank")) for i, c in enumerate(("gene", "rap", "msu"))))
    named = genes.withColumn("__n", F.explode(names)).where(F.col("__n.id").isNotNull())
    found = wanted.select("id").distinct().join(named, F.col("id") == F.col("__n.id"))
    w = Window.partitionBy("id").orderBy("__n.rank", "gene")
    return found.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__n")


def search(genes: DataFrame, text: str) -> DataFrame:
    """Genes whose id, RAP id or MSU id holds the text, whatever its case."""
    hit = lambda c: F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return genes.where(hit("gene") | hit("rap") | hit("msu"))


def genes_on(genes: DataFrame, chrom) -> DataFrame:
    return genes.where(F.col("chrom") == chrom).orderBy("st", "gene")


def in_region(spans: DataFrame, chrom, start: int, end: int, kind: str | None = None) -> DataFrame:
    """Spans (chrom, st, en) that touch a region; of one type, whatever its case."""
    hit = spans.where((F.col("chrom") == chrom) & (F.col("st") <= end) & (F.col("en") >= start))
    return hit if kind is None else hit.where(F.lower("type") == kind.lower())


def is_type(kind: Column, *names: str) -> Column:
    return F.lower(kind).isin(*names)


def is_gene(kind: Column) -> Column:
    return is_type(kind, "gene")


def is_transcript(kind: Column) -> Column:
    return is_type(kind, "mrna", "transcript")


def is_utr(kind: Column) -> Column:
    return F.lower(kind).contains("utr")


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start <= other_end) & (end >= other_start)


def attribute(attributes: Column, key: str) -> Column:
    """The first value of an attribute; null without it."""
    return F.get(F.try_element_at(attributes, F.lit(key)), F.lit(0))


def summary(genes: DataFrame, transcripts: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: genes, chromosomes, genes with RAP and MSU ids, transcripts, transcripts per gene and introns."""
    g = genes.agg(F.count(F.lit(1)).alias("genes"), F.countDistinct("chrom").alias("chromosomes"), F.count("rap").alias("with_rap"), F.count("msu").alias("with_msu"))
    t, i = transcripts.agg(F.count(F.lit(1)).alias("transcripts")), gaps.agg(F.count(F.lit(1)).alias("introns"))
    return g.join(F.broadcast(t)).join(F.broadcast(i)).withColumn("per_gene", F.coalesce(F.try_divide(F.col("transcripts").cast("double"), F.col("genes")), F.lit(0.0)))


def rap_id(text: Column) -> Column:
    """The first RAP id in a text, null without one."""
    return F.when(text.rlike(RAP), F.concat(F.lit("Os"), F.regexp_extract(text, RAP, 1), F.lit("g"), F.regexp_extract(text, RAP, 2)))


def msu_id(text: Column) -> Column:
    return F.when(text.rlike(MSU), F.regexp_extract(text, f"({MSU})".replace("((?i)", "(?i)("), 1))


def parse_id(text: Column) -> Column:
    """Struct of chromosome number and locus of a RAP or else an MSU id; null for neither."""
    part = lambda i: F.when(text.rlike(RAP), F.regexp_extract(text, RAP, i)).otherwise(F.regexp_extract(text, MSU, i)).cast("int")
    return F.when(text.rlike(RAP) | text.rlike(MSU), F.struct(part(1).alias("chrom"), part(2).alias("locus")))


def chromosome_of(text: Column) -> Column:
    x = parse_id(text)
    return F.when(x.isNotNull(), F.concat(F.lit("chr"), F.lpad(x["chrom"].cast("string"), 2, "0")))


def by_position(ids: DataFrame, key: str = "id") -> DataFrame:
    """Ids in order of chromosome and locus; ids of another form come after, by text."""
    x = parse_id(F.col(key))
    return ids.orderBy(x["chrom"].asc_nulls_last(), x["locus"].asc_nulls_last(), key)


def place(ids: DataFrame, key: str = "id") -> DataFrame:
    """ids with their place in by_position, counted per chromosome first, so that no task sorts all of them."""
    x = parse_id(F.col(key))
    rows = ids.withColumn("chrom", x["chrom"]).withColumn("locus", x["locus"])
    before = rows.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.col("chrom").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("chrom").orderBy(F.col("locus").asc_nulls_last(), key))
    return rows.withColumn("own", own).join(F.broadcast(before.select(F.col("chrom").alias("c2"), "before")), F.col("chrom").eqNullSafe(F.col("c2"))).select(*ids.columns, "chrom", "locus", (F.col("own") + F.col("before")).alias("place"))
