"""Life-science tables derived from the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters() -> F.Column:
    return F.regexp_replace("text", "[^A-Za-z]", "")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.translate(F.upper(letters()), "BDEFHIJKLMNOPQRSUVWXYZ", "CTACTAGCATGGACTACGTACG")
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))


RESIDUE = "ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy"


def protein(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    """The documents' residues, of those with least residues: a pattern that stops at the last needed one finds them, as a filter on the length strips a text again."""
    documents = table(spark, sf_dir, "documents")
    documents = documents.where(F.col("text").rlike(f"(?:[{RESIDUE}][^{RESIDUE}]*+){{{least}}}")) if least else documents
    return documents.select("doc_id", F.upper(F.regexp_replace("text", f"[^{RESIDUE}]+", "")).alias("s"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    chrom = F.concat(F.lit("chr"), F.lpad((F.col("l_suppkey") % 12 + 1).cast("string"), 2, "0"))
    g = line.groupBy(chrom.alias("chrom"), (F.col("l_partkey") * 97 + 1).alias("pos"), (F.col("l_orderkey") % 40).cast("int").alias("sample")).agg(F.min(F.col("l_quantity").cast("int") % 4).alias("d"))
    return g.select("chrom", "pos", "sample", F.when(F.col("d") < 3, F.col("d")).alias("dos"))


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = line.join(part, line["l_partkey"] == part["p_partkey"])
    return j.groupBy(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") % 10).alias("sample")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"), (F.max("p_size") * 100).cast("long").alias("length"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderkey") * 7
    return o.select(F.col("o_orderkey").alias("gene"), (F.col("o_custkey") % 12).cast("int").alias("chrom"), st.alias("st"), (st + F.floor("o_totalprice").cast("long") % 5000).alias("en"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    base = lambda k: F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 12).cast("int").alias("chrom"), (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13).alias("pos"), base(F.col("l_partkey")).alias("ref"), base(F.col("l_partkey") + F.col("l_linenumber")).alias("alt"))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    st = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100
    kind = F.when(F.col("l_returnflag") == "A", "CDS").when(F.col("l_returnflag") == "N", "exon").otherwise("five_prime_UTR")
    return line.select(F.col("l_orderkey").alias("tx"), kind.alias("type"), st.alias("st"), (st + F.col("l_quantity").cast("long")).alias("en"))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.get(F.col("embedding"), i) > 0).alias("bits"))


DNA = "v_dna AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'CTACTAGCATGGACTACGTACG') AS s FROM documents)"
PROTEIN = "v_prot AS (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM documents)"
GENOTYPES = """v_geno AS (SELECT chrom, pos, sample, CASE WHEN d < 3 THEN d END AS dos FROM (
    SELECT 'chr' || lpad(CAST(l_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS chrom, l_partkey * 97 + 1 AS pos, CAST(l_orderkey % 40 AS INTEGER) AS sample, min(CAST(l_quantity AS INTEGER) % 4) AS d
    FROM lineitem GROUP BY 1, 2, 3))"""
SITES = """v_site AS (SELECT *, least(p, 1 - p) AS maf, CASE WHEN called > 0 THEN CAST(hets AS DOUBLE) / called ELSE 0 END AS het, 1 - CAST(called AS DOUBLE) / n AS missing FROM (
    SELECT chrom, pos, count(*) AS n, count(dos) AS called, CAST(sum(dos) AS BIGINT) AS alt, count(*) FILTER (dos = 1) AS hets,
           CASE WHEN count(dos) > 0 THEN CAST(sum(dos) AS DOUBLE) / (2 * count(dos)) ELSE 0 END AS p FROM v_geno GROUP BY 1, 2))"""
EXPRESSION = "v_expr AS (SELECT l_partkey AS gene, l_suppkey % 10 AS sample, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value, CAST(max(p_size) * 100 AS BIGINT) AS length FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
GENES = "v_gene AS (SELECT o_orderkey AS gene, CAST(o_custkey % 12 AS INTEGER) AS chrom, o_orderkey * 7 AS st, o_orderkey * 7 + CAST(floor(o_totalprice) AS BIGINT) % 5000 AS en, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders)"
VARIANTS = "v_var AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey % 12 AS INTEGER) AS chrom, l_orderkey * 7 + l_linenumber * 13 AS pos, substr('ACGT', CAST(l_partkey % 4 + 1 AS INTEGER), 1) AS ref, substr('ACGT', CAST((l_partkey + l_linenumber) % 4 + 1 AS INTEGER), 1) AS alt FROM lineitem)"
EXONS = """v_exon AS (SELECT l_orderkey AS tx, CASE l_returnflag WHEN 'A' THEN 'CDS' WHEN 'N' THEN 'exon' ELSE 'five_prime_UTR' END AS type,
    l_orderkey * 1000 + l_linenumber * 100 AS st, l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS en FROM lineitem)"""
BITS = "v_fp AS (SELECT vec_id, list_filter(range(0, len(embedding)), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings)"
CODONS = "v_codon AS (SELECT substr('TCAG', CAST(i // 16 + 1 AS INTEGER), 1) || substr('TCAG', CAST(i // 4 % 4 + 1 AS INTEGER), 1) || substr('TCAG', CAST(i % 4 + 1 AS INTEGER), 1) AS codon, substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(i + 1 AS INTEGER), 1) AS aa FROM range(64) t(i))"


def sql(body: str, *views: str) -> str:
    return f"WITH {', '.join(views)} {body}" if views else body
