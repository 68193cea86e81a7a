"""Catalogues of rice genes, gene sets and subpopulations as small tables, and joins with them.

The tables are fixed in code (at most 70 rows), so broadcasting them is safe whatever the data's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known agronomic genes as id, symbol, full name, function.
KNOWN_GENES = [
    ("Os06g0133000", "Wx", "Waxy", "Starch synthesis — glutinous phenotype"),
    ("Os07g0695100", "OsSSI", "Starch synthase I", "Starch quality"),
    ("Os06g0275000", "Hd1", "Heading date 1", "CONSTANS homolog — photoperiod flowering"),
    ("Os06g0163700", "Hd3a", "Heading date 3a", "Florigen — day-length insensitive"),
    ("Os06g0242200", "RFT1", "RFT1", "Florigen — promotes flowering under LD"),
    ("Os07g0261200", "Ghd7", "Ghd7", "Grain number, plant height, heading date"),
    ("Os08g0424300", "OsDTH8", "DTH8", "Days-to-heading under short days"),
    ("Os11g0508800", "Pita", "Pi-ta", "Blast resistance gene (NBS-LRR)"),
    ("Os11g0695900", "Pid2", "Pi-d2", "Blast resistance — B-lectin kinase"),
    ("Os04g0448900", "OsSULT", "OsSULT", "Sulphate transporter"),
    ("Os04g0448400", "Sub1A", "Submergence 1A", "Submergence tolerance — ERF"),
    ("Os11g0615700", "OsNramp5", "OsNramp5", "Cadmium uptake — transporter"),
    ("Os04g0670800", "sh4", "Shattering 4", "Grain shattering control"),
    ("Os07g0153600", "Prog1", "PROG1", "Prostrate growth 1 — domestication"),
    ("Os09g0310900", "Rc", "Rc", "Red coleoptile / pericarp colour"),
    ("Os03g0407400", "GS3", "Grain size 3", "Major grain length QTL"),
    ("Os05g0187500", "GW5", "Grain width 5", "Grain width and weight"),
    ("Os02g0814300", "GW2", "Grain width 2", "RING-type E3 ubiquitin ligase"),
    ("Os07g0603300", "GIF1", "GIF1", "Cell wall invertase — grain filling"),
    ("Os01g0885100", "OsLOGL7", "LOG7", "Cytokinin activation — tiller number"),
]

# Flowering-time genes as symbol, id, chromosome, pathway, photoperiod sensitivity, effect.
FLOWERING = [
    ("Hd1", "Os06g0275000", "chr06", "Photoperiod pathway", True, "dual"),
    ("Hd3a", "Os06g0163700", "chr06", "Florigen pathway", True, "promotes"),
    ("RFT1", "Os06g0242200", "chr06", "Florigen pathway", True, "promotes"),
    ("Ghd7", "Os07g0261200", "chr07", "Circadian / LD repressor", True, "represses"),
    ("Ghd8/DTH8", "Os08g0424300", "chr08", "LD repressor", True, "represses"),
    ("OsPRR1/Toc1", "Os02g0724000", "chr02", "Circadian clock", True, "represses"),
    ("OsPRR37/Hd2", "Os07g0695100", "chr07", "Circadian / photoperiod", True, "represses"),
    ("OsGI", "Os01g0830800", "chr01", "Photoperiod pathway", True, "promotes"),
    ("SE5", "Os06g0227700", "chr06", "Light signalling", False, "promotes"),
    ("Ehd1", "Os10g0392400", "chr10", "SD promotion pathway", True, "promotes"),
    ("Ehd2/RID1", "Os1g0182800", "chr01", "Ehd1 regulation", True, "represses"),
    ("Ehd3", "Os01g0747900", "chr01", "Ehd1 regulation", True, "promotes"),
    ("Ehd4", "Os01g0182800", "chr01", "Ehd1 regulation", True, "represses"),
    ("OsFKF1", "Os05g0536000", "chr05", "Light-F-box pathway", True, "promotes"),
    ("OsCOL4", "Os03g0819800", "chr03", "CO-like repressor", True, "represses"),
    ("IDS1/OsAP2-39", "Os04g0448900", "chr04", "Autonomous pathway", False, "promotes"),
    ("RCN1/OsAGL6", "Os06g0193700", "chr06", "MADS-box pathway", False, "promotes"),
    ("OsMADS51", "Os05g0450480", "chr05", "Autonomous/SD pathway", True, "promotes"),
]

# Stress-response gene sets; one gene is listed twice in the submergence set and counts twice in its size.
STRESS = {
    "Drought response": "Os01g0843200 Os06g0127800 Os06g0194800 Os11g0639100 Os09g0522200 Os05g0329700 Os01g0841800 Os07g0154100 Os04g0448400 Os02g0818000",
    "Salinity tolerance": "Os01g0307700 Os12g0476200 Os04g0448400 Os03g0401200 Os07g0154100 Os05g0479700 Os06g0682500 Os02g0818000 Os11g0574700 Os11g0547800",
    "Cold stress": "Os06g0127800 Os06g0194800 Os03g0236100 Os09g0315700 Os02g0585500 Os12g0422900 Os04g0448900 Os03g0765300 Os01g0884100 Os09g0447800",
    "Blast resistance": "Os11g0508800 Os11g0695900 Os12g0476200 Os06g0140700 Os01g0159500 Os11g0616200 Os11g0459800 Os11g0484200 Os11g0603300 Os07g0154100 Os04g0576800 Os12g0441800",
    "Submergence tolerance": "Os09g0449500 Os09g0449800 Os09g0450200 Os09g0432700 Os06g0568700 Os01g0884300 Os09g0432700 Os04g0448400 Os03g0829100",
    "Heat stress": "Os01g0884100 Os03g0288500 Os05g0402800 Os03g0322600 Os02g0558300 Os05g0569100 Os01g0633100 Os07g0668100",
}

# Subpopulations as name, code, ecotype, origin.
SUBPOPULATIONS = [
    ("Aus", "aus", "tropical", "South Asia (Bangladesh, India)"),
    ("Indica", "ind", "tropical", "Tropical Asia (India, SE Asia, China south)"),
    ("Aromatic", "aro", "tropical", "South Asia (Basmati, Jasmine types)"),
    ("Temperate Japonica", "trop_jap", "temperate", "East Asia (China north, Japan, Korea)"),
    ("Tropical Japonica", "trj", "tropical", "SE Asia, Latin America, Africa"),
    ("Admixed", "adm", "mixed", "Various"),
]
KNOWN_SCHEMA = "gene string, symbol string, full_name string, function string"
FLOWERING_SCHEMA = "symbol string, gene string, chrom string, pathway string, photoperiod boolean, effect string"
SUBPOPULATION_SCHEMA = "name string, code string, ecotype string, origin string"


def known_genes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_GENES, KNOWN_SCHEMA)


def flowering_genes(spark: SparkSession) -> DataFrame:
    """All flowering genes; promoters, repressors and photoperiod genes are plain filters of it."""
    return spark.createDataFrame(FLOWERING, FLOWERING_SCHEMA)


def stress_sets(spark: SparkSession) -> DataFrame:
    """(set, gene), as listed."""
    return spark.createDataFrame([(k, g) for k, v in STRESS.items() for g in v.split()], "set string, gene string")


def subpopulation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SUBPOPULATIONS, SUBPOPULATION_SCHEMA)


def by_symbol(spark: SparkSession, symbol: Column) -> DataFrame:
    """Known genes of a symbol, whatever its case."""
    return known_genes(spark).where(F.lower("symbol") == F.lower(symbol))


def sets_containing(genes: DataFrame, key: str = "gene") -> DataFrame:
    """The stress sets of each gene, as a sorted array; empty where none holds it."""
    sets = stress_sets(genes.sparkSession).distinct().groupBy("gene").agg(F.sort_array(F.collect_list("set")).alias("sets"))
    joined = genes.join(F.broadcast(sets.withColumnRenamed("gene", "__gene")), F.col(key) == F.col("__gene"), "left").drop("__gene")
    return joined.withColumn("sets", F.coalesce("sets", F.array().cast("array<string>")))


def pathway_summary(spark: SparkSession) -> DataFrame:
    """Flowering genes by pathway: how many, which, and how many are photoperiod genes."""
    f = flowering_genes(spark)
    return f.groupBy("pathway").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("symbols"), F.count_if("photoperiod").alias("photoperiod"))


def gene_statistics(genes: DataFrame, rap: str = "rap") -> DataFrame:
    """One row: genes, known agronomic genes and flowering genes, by semi-joins on the gene id."""
    spark = genes.sparkSession
    known, flowering = (F.broadcast(t.select(F.col("gene").alias(rap)).distinct().withColumn(n, F.lit(1))) for t, n in ((known_genes(spark), "known"), (flowering_genes(spark), "flowering")))
    return genes.select(rap).join(known, rap, "left").join(flowering, rap, "left").agg(F.count(F.lit(1)).alias("genes"), F.count("known").alias("known"), F.count("flowering").alias("flowering"))
