"""Queries of the genome side: record formats, genotype accessors, annotation lookups, catalogues and top-k reports, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.operators import annotation as A
from strandwork.operators import catalogues as C
from strandwork.operators import expression as E
from strandwork.operators import lookups as L
from strandwork.operators import variants as V
from strandwork.plans import views as v
from strandwork.plans.catalog import LD, query, r6, site
from strandwork.sources import formats as S

SAMPLES = ["s1", "s2", "s3"]

# Records of a VCF, a line per row of lineitem, and the same as columns in SQL.


def record_id() -> F.Column:
    return F.concat(F.lit("rs"), F.concat_ws("_", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.col("l_quantity").cast("int").cast("string"), F.floor("l_extendedprice").cast("string")))


RECORD_ID = "'rs' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(l_quantity AS INTEGER) || '_' || CAST(floor(l_extendedprice) AS BIGINT)"


def vcf_columns(spark, d) -> DataFrame:
    line = v.table(spark, d, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    base = lambda k: F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
    call = lambda a, b: F.concat((q % a).cast("string"), F.when(n % 2 == 0, "/").otherwise("|"), (q % b).cast("string"))
    alt = F.concat(base(F.col("l_partkey") + 1 + n % 3), F.when(n == 5, "A").otherwise(""), F.when(n == 3, ",T").otherwise(""))
    return line.select(
        F.concat(F.lit("chr"), F.lpad((F.col("l_suppkey") % 12 + 1).cast("string"), 2, "0")).alias("chrom"), (F.col("l_orderkey") * 7 + n * 13).alias("pos"), record_id().alias("id"),
        base(F.col("l_partkey")).alias("ref"), alt.alias("alt"), F.when(n == 1, ".").otherwise((q * 2).cast("string")).alias("qual"), F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "N", ".").otherwise("q10;s50").alias("filter"),
        F.concat(F.lit("DP="), q.cast("string"), F.when(n == 2, ";DB").otherwise("")).alias("info"), F.concat(call(3, 2), F.lit(":"), q.cast("string")).alias("c1"),
        F.when(n == 2, "./.").otherwise(F.concat(call(2, 2), F.lit(":12:7,5"))).alias("c2"), F.when(n == 4, ".").otherwise(F.concat(F.lit("0/"), (q % 2).cast("string"))).alias("c3"),
    )


def vcf_lines(spark, d) -> DataFrame:
    return vcf_columns(spark, d).select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info", F.lit("GT:DP:AD"), "c1", "c2", "c3").alias("value"))


_Q = "CAST(l_quantity AS INTEGER)"
_SEP = "CASE WHEN l_linenumber % 2 = 0 THEN '/' ELSE '|' END"
VCF = f"""v_vcf AS (SELECT 'chr' || lpad(CAST(l_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS chrom, l_orderkey * 7 + l_linenumber * 13 AS pos, {RECORD_ID} AS id,
    substr('ACGT', CAST(l_partkey % 4 + 1 AS INTEGER), 1) AS ref, substr('ACGT', CAST((l_partkey + 1 + l_linenumber % 3) % 4 + 1 AS INTEGER), 1) || CASE WHEN l_linenumber = 5 THEN 'A' ELSE '' END || CASE WHEN l_linenumber = 3 THEN ',T' ELSE '' END AS alt,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST({_Q} * 2 AS DOUBLE) END AS qual, CASE WHEN l_returnflag IN ('A', 'N') THEN '' ELSE 'q10;s50' END AS filter, {_Q} AS dp, l_linenumber = 2 AS db,
    ({_Q} % 3) || {_SEP} || ({_Q} % 2) AS g1, CASE WHEN l_linenumber = 2 THEN './.' ELSE ({_Q} % 2) || {_SEP} || ({_Q} % 2) END AS g2, CASE WHEN l_linenumber = 4 THEN '.' ELSE '0/' || ({_Q} % 2) END AS g3 FROM lineitem)"""
CALLS = """v_call AS (SELECT chrom, pos, id, ref, alt, sample, gt, gt IN ('./.', '.') AS gone, string_split_regex(gt, '[/|]') AS a, CASE sample WHEN 's1' THEN dp WHEN 's2' THEN CASE WHEN gt = './.' THEN NULL ELSE 12 END END AS dp,
    CASE WHEN sample = 's2' AND gt <> './.' THEN '7,5' END AS ad FROM (SELECT chrom, pos, id, ref, alt, dp, unnest(['s1', 's2', 's3']) AS sample, unnest([g1, g2, g3]) AS gt FROM v_vcf))"""

query("vcf_records", v.sql("SELECT chrom, pos, id, ref, alt, qual, filter, CAST(dp AS VARCHAR) AS dp, CASE WHEN db THEN 'true' END AS db, unnest(['s1', 's2', 's3']) AS sample, unnest([g1, g2, g3]) AS gt FROM v_vcf", VCF))(
    lambda spark, d: S.parse_vcf(vcf_lines(spark, d), SAMPLES).select("chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), "qual", F.array_join("filter", ";").alias("filter"), F.try_element_at("info", F.lit("DP")).alias("dp"), F.try_element_at("info", F.lit("DB")).alias("db"), "sample", "gt")
)
ALLELES = "v_allele AS (SELECT *, list_filter(flatten(list_transform(list_filter([g1, g2, g3], lambda g: g NOT IN ('./.', '.')), lambda g: string_split_regex(g, '[/|]'))), lambda x: x <> '.') AS codes, len(list_filter([g1, g2, g3], lambda g: g IN ('./.', '.'))) / 3.0 AS missing FROM v_vcf)"
query("vcf_limits", v.sql("""SELECT id, pos, CAST(3 AS BIGINT) AS calls FROM v_allele WHERE chrom = 'chr03' AND pos BETWEEN 1000 AND 60000 AND filter = '' AND length(ref) = 1 AND regexp_full_match(alt, '[ACGT](,[ACGT])*') AND missing <= 0.4
    AND coalesce(list_reverse_sort(list_transform(list_distinct(codes), lambda a: len(list_filter(codes, lambda x: x = a))))[2], 0) >= 0.3 * len(codes)""", VCF, ALLELES))(
    lambda spark, d: S.parse_vcf(vcf_lines(spark, d), SAMPLES, "chr03", 1000, 60000, True, True, 0.3, 0.4).groupBy("id", "pos").agg(F.count(F.lit(1)).alias("calls"))
)


@query("vcf_body", v.sql("SELECT chrom || chr(9) || pos || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || coalesce(CAST(CAST(qual AS BIGINT) AS VARCHAR), '.') || chr(9) || CASE WHEN filter = '' THEN 'PASS' ELSE filter END || chr(9) || 'DP=' || dp || CASE WHEN db THEN ';DB' ELSE '' END || chr(9) || 'GT' || chr(9) || g1 || chr(9) || g2 || chr(9) || './.' AS value FROM v_vcf", VCF))
def vcf_body(spark, d) -> DataFrame:
    """Records parsed, cut to two samples and written for three: the missing one is ./. ."""
    kept = V.subset(S.parse_vcf(vcf_lines(spark, d), SAMPLES), ["s1", "s2"])
    return S.vcf_text(kept, SAMPLES).select("value")


@query("vcf_meta", v.sql("SELECT 'contig' AS section, 'chr' || n_nationkey AS id, CAST(n_nationkey * 1000 AS VARCHAR) AS value FROM nation UNION ALL SELECT 'FILTER', n_name, 'nation ' || n_name FROM nation UNION ALL SELECT 'meta', n_name, CAST(n_regionkey AS VARCHAR) FROM nation"))
def vcf_meta(spark, d) -> DataFrame:
    n, key = v.table(spark, d, "nation"), F.col("n_nationkey").cast("string")
    contig = F.concat(F.lit("##contig=<ID=chr"), key, F.lit(",length="), (F.col("n_nationkey") * 1000).cast("string"), F.lit(">"))
    listed = F.concat(F.lit("##FILTER=<ID="), F.col("n_name"), F.lit(',Description="nation '), F.col("n_name"), F.lit('">'))
    other = F.concat(F.lit("##"), F.col("n_name"), F.lit("="), F.col("n_regionkey").cast("string"))
    return S.vcf_meta(n.select(F.explode(F.array(contig, listed, other, F.lit("#CHROM"))).alias("value")))


@query("genotype_calls", v.sql("SELECT id, sample, contains(gt, '|') AS phased, gone AS missing, NOT gone AND len(list_distinct(a)) = 1 AS hom, NOT gone AND len(list_distinct(a)) > 1 AS het, NOT gone AND len(list_distinct(a)) = 1 AND a[1] = '0' AS hom_ref, NOT gone AND len(list_distinct(a)) = 1 AND a[1] NOT IN ('0', '.') AS hom_alt, CASE WHEN NOT gone THEN CAST(len(list_filter(a, lambda x: x NOT IN ('0', '.'))) AS INTEGER) END AS dosage, dp, ad FROM v_call", VCF, CALLS))
def genotype_calls(spark, d) -> DataFrame:
    gt = F.col("gt")
    return S.parse_vcf(vcf_lines(spark, d), SAMPLES).select(
        "id", "sample", V.is_phased(gt).alias("phased"), V.is_missing(gt).alias("missing"), V.is_hom(gt).alias("hom"), V.is_het(gt).alias("het"), V.is_hom_ref(gt).alias("hom_ref"), V.is_hom_alt(gt).alias("hom_alt"), V.dosage(gt).alias("dosage"),
        V.depth(F.col("fields")).alias("dp"), F.array_join(F.transform(V.allele_depths(F.col("fields")), lambda x: x.cast("string")), ",").alias("ad"),
    )


def records(spark, d) -> DataFrame:
    """One call table where each record is a site of its own."""
    return S.parse_vcf(vcf_lines(spark, d), SAMPLES).withColumn("chrom", F.col("id"))


FREQ = """v_freq AS (SELECT n.id, n.code, n.allele, coalesce(c.k, 0) AS k, coalesce(CAST(c.k AS DOUBLE) / sum(c.k) OVER (PARTITION BY n.id), 0) AS f FROM (SELECT id, unnest(range(0, len(names))) AS code, unnest(names) AS allele FROM (SELECT id, list_concat([ref], string_split(alt, ',')) AS names FROM v_vcf)) n
    LEFT JOIN (SELECT id, CAST(x AS INTEGER) AS code, count(*) AS k FROM (SELECT id, unnest(a) AS x FROM v_call WHERE NOT gone) WHERE x <> '.' GROUP BY 1, 2) c ON c.id = n.id AND c.code = n.code)"""
query("allele_frequencies", v.sql("SELECT id, allele, k AS n, round(f, 6) AS frequency FROM v_freq", VCF, CALLS, FREQ))(lambda spark, d: V.allele_frequencies(records(spark, d)).select(F.col("chrom").alias("id"), "allele", F.col("count").alias("n"), r6("frequency").alias("frequency")))
MINOR = "v_minor AS (SELECT id, coalesce(max(f) FILTER (r = 2), 0) AS maf FROM (SELECT id, f, row_number() OVER (PARTITION BY id ORDER BY k DESC, allele) AS r FROM v_freq) GROUP BY id)"
query("minor_allele_frequency", v.sql("SELECT id, round(maf, 6) AS maf FROM v_minor", VCF, CALLS, FREQ, MINOR))(lambda spark, d: V.minor_frequency(V.allele_frequencies(records(spark, d))).select(F.col("chrom").alias("id"), r6("maf").alias("maf")))


@query("vcf_summary", v.sql("""SELECT records, snps, indels, multiallelic, transitions, transversions, round(mean_maf, 6) AS mean_maf, round(mean_missing, 6) AS mean_missing, singletons, round(CAST(transitions AS DOUBLE) / transversions, 6) AS ts_tv FROM (
    SELECT count(*) AS records, count(*) FILTER (snp) AS snps, count(*) FILTER (NOT snp) AS indels, count(*) FILTER (contains(alt, ',')) AS multiallelic, count(*) FILTER (snp AND ts) AS transitions, count(*) FILTER (snp AND NOT ts) AS transversions, avg(maf) AS mean_maf, avg(missing) AS mean_missing, count(*) FILTER (maf > 0 AND maf <= 1.0 / 6) AS singletons
    FROM (SELECT a.*, m.maf, regexp_full_match(alt, '[ACGT](,[ACGT])*') AS snp, ref || substr(alt, 1, 1) IN ('AG', 'GA', 'CT', 'TC') AS ts FROM v_allele a JOIN v_minor m USING (id)))""", VCF, CALLS, FREQ, MINOR, ALLELES))
def vcf_summary(spark, d) -> DataFrame:
    calls = records(spark, d)
    sites_ = calls.groupBy("chrom", "pos", "ref", "alt").agg(F.count(F.lit(1)).alias("n"), F.avg(V.is_missing(F.col("gt")).cast("int")).alias("missing"))
    s = V.summarise_records(sites_, V.minor_frequency(V.allele_frequencies(calls)))
    return s.select("records", "snps", "indels", "multiallelic", "transitions", "transversions", r6("mean_maf").alias("mean_maf"), r6("mean_missing").alias("mean_missing"), "singletons", r6("ts_tv").alias("ts_tv"))


query("sample_subset", v.sql("SELECT chrom, pos, count(sample) FILTER (sample IN (1, 5, 9)) AS calls FROM v_geno GROUP BY 1, 2", v.GENOTYPES))(
    lambda spark, d: V.subset(v.genotypes(spark, d), [1, 5, 9]).groupBy("chrom", "pos").agg(F.count("sample").alias("calls"))
)
query("chromosome_order", v.sql("SELECT chrom, CAST(regexp_replace(chrom, '[^0-9]', '', 'g') AS BIGINT) AS place, count(*) AS sites FROM v_site GROUP BY 1, 2", v.GENOTYPES, v.SITES))(
    lambda spark, d: site(spark, d).groupBy("chrom", V.chromosome_index(F.col("chrom")).alias("place")).agg(F.count(F.lit(1)).alias("sites"))
)
query("ld_top_pairs", v.sql("SELECT chrom, pos, pos2, round(r2, 6) AS r2 FROM (SELECT *, CASE WHEN p1 * (1 - p1) * p2 * (1 - p2) > 1e-12 THEN least(1.0, d * d / (p1 * (1 - p1) * p2 * (1 - p2))) ELSE 0 END AS r2 FROM v_ld WHERE n >= 4) ORDER BY round(r2, 9) DESC, chrom, pos, pos2 LIMIT 25", v.GENOTYPES, LD))(
    lambda spark, d: V.ld_pairs(v.genotypes(spark, d), 2000, 4).orderBy(F.round("r2", 9).desc(), "chrom", "pos", "pos2").limit(25).select("chrom", "pos", "pos2", r6("r2").alias("r2"))
)


@query("top_sweeps")
def top_sweeps(spark, d) -> DataFrame:
    """The twenty windows of the highest sweep score."""
    from strandwork.plans.catalog import selection_sweeps

    return selection_sweeps(spark, d).orderBy(F.col("score").desc(), "chrom", "start").limit(20)


HAPS = "v_hap AS (SELECT chrom, start, hap, count(*) AS c FROM (SELECT chrom, ((pos - 1) // 20000) * 20000 + 1 AS start, sample, string_agg(CASE WHEN dos >= 1 THEN '1' WHEN dos = 0 THEN '0' ELSE '?' END, '' ORDER BY pos) AS hap FROM v_geno GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)"


def haplotype_counts(spark, d) -> DataFrame:
    """Allele strings per window of 20,000 bases and how many samples have them."""
    g = v.genotypes(spark, d).withColumn("start", (F.floor((F.col("pos") - 1) / 20000) * 20000 + 1).cast("long"))
    call = F.coalesce(F.when(F.col("dos") >= 1, "1").otherwise(F.when(F.col("dos") == 0, "0")), F.lit("?"))
    each = g.groupBy("chrom", "start", "sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", call.alias("c")))), lambda x: x["c"]), "").alias("hap"))
    return each.groupBy("chrom", "start", "hap").count()


query("haplotype_network", v.sql("SELECT chrom, start, head AS \"from\", hap AS \"to\", CAST(len(list_filter(range(1, least(length(head), length(hap)) + 1), lambda i: substr(head, CAST(i AS INTEGER), 1) <> substr(hap, CAST(i AS INTEGER), 1) AND substr(head, CAST(i AS INTEGER), 1) <> '?' AND substr(hap, CAST(i AS INTEGER), 1) <> '?')) AS BIGINT) AS mutations, c AS samples FROM (SELECT *, first_value(hap) OVER w AS head, row_number() OVER w AS r FROM v_hap WINDOW w AS (PARTITION BY chrom, start ORDER BY c DESC, hap)) WHERE r > 1", v.GENOTYPES, HAPS))(
    lambda spark, d: V.haplotype_network(haplotype_counts(spark, d), ["chrom", "start"])
)


@query("block_summary", v.sql("SELECT count(*) AS blocks, 20000.0::DOUBLE AS mean_length, round(avg(sites), 6) AS mean_sites, round(avg(k), 6) AS mean_haplotypes, round(avg(diversity), 6) AS mean_diversity, CAST(count(*) * 20000 AS BIGINT) AS bases FROM (SELECT chrom, start, count(*) AS k, 1 - CAST(sum(c * c) AS DOUBLE) / (sum(c) * sum(c)) AS diversity FROM v_hap GROUP BY 1, 2) JOIN (SELECT chrom, ((pos - 1) // 20000) * 20000 + 1 AS start, count(*) AS sites FROM v_site GROUP BY 1, 2) USING (chrom, start)", v.GENOTYPES, v.SITES, HAPS.replace("string_agg(CASE", "string_agg(pos || ':' || CASE").replace("END, ''", "END, ','")))
def block_summary(spark, d) -> DataFrame:
    start = (F.floor((F.col("pos") - 1) / 20000) * 20000 + 1).cast("long").alias("start")
    n = site(spark, d).groupBy("chrom", start).agg(F.count(F.lit(1)).alias("n_sites"))
    blocks = V.haplotypes(v.genotypes(spark, d), 20000).join(n, ["chrom", "start"]).withColumn("end", F.col("start") + 19999)
    return V.summarise_blocks(blocks).select("blocks", "mean_length", *(r6(c).alias(c) for c in ("mean_sites", "mean_haplotypes", "mean_diversity")), "bases")


query("subpopulations_first_sites", v.sql("SELECT sample, called, round(het, 6) AS het, round(hom_alt, 6) AS hom_alt, CASE WHEN called < 10 THEN 'Unknown' WHEN het > 0.15 THEN 'Admixed' WHEN hom_alt > 0.45 THEN 'Indica' WHEN hom_alt < 0.20 THEN 'Japonica' ELSE 'Intermediate' END AS subpopulation FROM (SELECT sample, count(dos) AS called, avg(CASE WHEN dos = 1 THEN 1.0 WHEN dos IS NOT NULL THEN 0.0 END) AS het, avg(CASE WHEN dos = 2 THEN 1.0 WHEN dos IS NOT NULL THEN 0.0 END) AS hom_alt FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY chrom, pos) AS r FROM v_geno) WHERE r <= 20 GROUP BY sample)", v.GENOTYPES))(
    lambda spark, d: V.subpopulations(v.genotypes(spark, d), 10, 20).select("sample", "called", r6("het").alias("het"), r6("hom_alt").alias("hom_alt"), "subpopulation")
)
query("domestication_hits", v.sql("SELECT chrom, pos, min_by(gene, ord) AS gene FROM (SELECT chrom, pos * 200 AS pos FROM v_site) s JOIN (VALUES " + ", ".join(f"('{c}', {p}, '{g}', {i})" for i, (c, p, g) in enumerate(V.DOMESTICATION)) + ") t(c2, locus, gene, ord) ON c2 = chrom AND abs(locus - pos) <= 500000 GROUP BY 1, 2", v.GENOTYPES, v.SITES))(
    lambda spark, d: V.domestication_hits(site(spark, d).withColumn("pos", F.col("pos") * 200), 500000)
)

# Genes with ids

KNOWN = [g for g, *_ in C.KNOWN_GENES]


def gene_ids(spark, d) -> DataFrame:
    """Orders as genes with ids of two kinds; some are ids of known genes, some are missing."""
    g, k = v.genes(spark, d), F.col("gene")
    number = F.concat(F.lit("Os"), F.lpad((F.col("chrom") + 1).cast("string"), 2, "0"), F.lit("g"), F.lpad((k * 100 % 10000000).cast("string"), 7, "0"))
    rap = F.when(k % 40 < 20, F.element_at(F.array(*map(F.lit, KNOWN)), (k % 40 + 1).cast("int"))).when(k % 5 != 0, number)
    msu = F.when(k % 7 != 0, F.concat(F.lit("LOC_Os"), F.lpad((F.col("chrom") + 1).cast("string"), 2, "0"), F.lit("g"), F.lpad((k % 100000).cast("string"), 5, "0")))
    return g.withColumn("rap", rap).withColumn("msu", msu)


IDS = "v_id AS (SELECT *, CASE WHEN gene % 40 < 20 THEN [" + ", ".join(f"'{g}'" for g in KNOWN) + "][CAST(gene % 40 + 1 AS INTEGER)] WHEN gene % 5 <> 0 THEN 'Os' || lpad(CAST(chrom + 1 AS VARCHAR), 2, '0') || 'g' || lpad(CAST(gene * 100 % 10000000 AS VARCHAR), 7, '0') END AS rap, CASE WHEN gene % 7 <> 0 THEN 'LOC_Os' || lpad(CAST(chrom + 1 AS VARCHAR), 2, '0') || 'g' || lpad(CAST(gene % 100000 AS VARCHAR), 5, '0') END AS msu FROM v_gene)"
WANTED = "v_want AS (SELECT DISTINCT id FROM (SELECT unnest([CAST(gene AS VARCHAR), rap, msu, 'nothing']) AS id FROM v_id WHERE gene % 9 = 0) WHERE id IS NOT NULL)"


@query("gene_lookup", v.sql("SELECT id, gene FROM (SELECT w.id, g.gene, row_number() OVER (PARTITION BY w.id ORDER BY g.k, g.gene) AS r FROM v_want w JOIN (SELECT CAST(gene AS VARCHAR) AS id, 0 AS k, gene FROM v_id UNION ALL SELECT rap, 1, gene FROM v_id UNION ALL SELECT msu, 2, gene FROM v_id) g USING (id)) WHERE r = 1", v.GENES, IDS, WANTED))
def gene_lookup(spark, d) -> DataFrame:
    g = gene_ids(spark, d)
    wanted = g.where("gene % 9 = 0").select(F.explode(F.array(F.col("gene").cast("string"), "rap", "msu", F.lit("nothing"))).alias("id")).where("id is not null")
    return L.by_id(g, wanted).select("id", "gene")


query("gene_search", v.sql("SELECT gene FROM v_id WHERE contains(CAST(gene AS VARCHAR), '0g00') OR contains(lower(rap), '0g00') OR contains(lower(msu), '0g00')", v.GENES, IDS))(lambda spark, d: L.search(gene_ids(spark, d), "0G00").select("gene"))
query("genes_on_chromosome", v.sql("SELECT gene, st FROM v_gene WHERE chrom = 5", v.GENES))(lambda spark, d: L.genes_on(v.genes(spark, d), 5).select("gene", "st"))
query("features_in_region", v.sql("SELECT tx, st, en FROM v_exon WHERE tx % 12 = 3 AND st <= 900000 AND en >= 200000 AND lower(type) = 'cds'", v.EXONS))(
    lambda spark, d: L.in_region(v.exons(spark, d).withColumn("chrom", F.col("tx") % 12), 3, 200000, 900000, "cds").select("tx", "st", "en")
)
query("feature_predicates", v.sql("SELECT type, type = 'CDS' AS cds, type = 'exon' AS exon, contains(lower(type), 'utr') AS utr, FALSE AS gene, count(*) FILTER (st <= tx * 1000 + 300 AND en >= tx * 1000 + 150) AS touching FROM v_exon GROUP BY type", v.EXONS))(
    lambda spark, d: v.exons(spark, d).groupBy("type", L.is_type(F.col("type"), "cds").alias("cds"), L.is_type(F.col("type"), "exon").alias("exon"), L.is_utr(F.col("type")).alias("utr"), L.is_gene(F.col("type")).alias("gene")).agg(F.count_if(L.overlaps(F.col("st"), F.col("en"), F.col("tx") * 1000 + 150, F.col("tx") * 1000 + 300)).alias("touching"))
)


@query("annotation_summary", v.sql("SELECT count(*) AS genes, count(DISTINCT chrom) AS chromosomes, count(rap) AS with_rap, count(msu) AS with_msu, (SELECT count(DISTINCT tx) FROM v_exon) AS transcripts, (SELECT count(*) FROM (SELECT en, lead(st) OVER (PARTITION BY tx ORDER BY st, en) AS nx FROM v_exon) WHERE nx > en + 1) AS introns, round(CAST((SELECT count(DISTINCT tx) FROM v_exon) AS DOUBLE) / count(*), 6) AS per_gene FROM v_id", v.GENES, IDS, v.EXONS))
def annotation_summary(spark, d) -> DataFrame:
    parts = v.exons(spark, d)
    return L.summary(gene_ids(spark, d), parts.select("tx").distinct(), A.introns(parts)).withColumn("per_gene", r6("per_gene"))


_KNOWN_SQL = "(VALUES " + ", ".join(f"('{g}')" for g in KNOWN) + ")"
_FLOWER_SQL = "(VALUES " + ", ".join(f"('{s}', '{g}', '{c}', '{p}', {str(x).lower()}, '{e}')" for s, g, c, p, x, e in C.FLOWERING) + ") f(symbol, gene, chrom, pathway, photoperiod, effect)"
_STRESS_SQL = "(VALUES " + ", ".join(f"('{k}', '{g}')" for k, x in C.STRESS.items() for g in x.split()) + ") t(name, gene)"
query("gene_statistics", v.sql(f"SELECT count(*) AS genes, count(*) FILTER (rap IN (SELECT * FROM {_KNOWN_SQL})) AS known, count(*) FILTER (rap IN (SELECT gene FROM {_FLOWER_SQL})) AS flowering FROM v_id", v.GENES, IDS))(lambda spark, d: C.gene_statistics(gene_ids(spark, d)))
query("stress_sets_of_genes", v.sql(f"SELECT v.gene, coalesce(sets, '') AS sets FROM v_id v LEFT JOIN (SELECT gene, string_agg(name, ',' ORDER BY name) AS sets FROM (SELECT DISTINCT name, gene FROM {_STRESS_SQL}) GROUP BY gene) s ON s.gene = v.rap", v.GENES, IDS))(
    lambda spark, d: C.sets_containing(gene_ids(spark, d), "rap").select("gene", F.array_join("sets", ",").alias("sets"))
)
query("flowering_pathways", v.sql(f"SELECT pathway, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS symbols, count(*) FILTER (photoperiod) AS photoperiod FROM {_FLOWER_SQL} GROUP BY pathway"))(lambda spark, d: C.pathway_summary(spark))


@query("flowering_annotation", v.sql(f"SELECT f.symbol, f.effect, count(*) AS genes FROM v_id v JOIN {_FLOWER_SQL} ON f.gene = v.rap WHERE f.photoperiod GROUP BY 1, 2", v.GENES, IDS))
def flowering_annotation(spark, d) -> DataFrame:
    """Annotated genes by photoperiod gene of the catalogue."""
    f = F.broadcast(C.flowering_genes(spark).where("photoperiod").select(F.col("gene").alias("rap"), "symbol", "effect"))
    return gene_ids(spark, d).join(f, "rap").groupBy("symbol", "effect").agg(F.count(F.lit(1)).alias("genes"))


query("known_gene_symbols", v.sql("SELECT v.gene, k.symbol, k.full_name FROM v_id v JOIN (VALUES " + ", ".join(f"('{g}', '{s}', '{n}')" for g, s, n, _ in C.KNOWN_GENES) + ") k(rap, symbol, full_name) USING (rap) WHERE lower(symbol) = 'wx'", v.GENES, IDS))(
    lambda spark, d: gene_ids(spark, d).join(F.broadcast(C.by_symbol(spark, F.lit("WX")).withColumnRenamed("gene", "rap")), "rap").select("gene", "symbol", "full_name")
)
query("subpopulation_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', '{e}', '{o}')" for n, c, e, o in C.SUBPOPULATIONS) + ") t(name, code, ecotype, origin) WHERE code IN ('ind', 'trj') OR name = 'Aus'")(
    lambda spark, d: C.subpopulation_table(spark).where("code in ('ind', 'trj') or name = 'Aus'")
)
query("gene_places", v.sql("SELECT rap AS id, CAST(substr(rap, 3, 2) AS INTEGER) AS chrom, CAST(substr(rap, 6, 7) AS INTEGER) AS locus, row_number() OVER (ORDER BY substr(rap, 3, 2), CAST(substr(rap, 6, 7) AS INTEGER), rap) AS place FROM (SELECT DISTINCT rap FROM v_id WHERE rap IS NOT NULL)", v.GENES, IDS))(
    lambda spark, d: L.place(gene_ids(spark, d).where("rap is not null").select(F.col("rap").alias("id")).distinct())
)
query("id_parsers", v.sql("SELECT gene, rap, msu, 'chr' || lpad(CAST(CAST(coalesce(substr(rap, 3, 2), substr(msu, 7, 2)) AS INTEGER) AS VARCHAR), 2, '0') AS chrom FROM v_id", v.GENES, IDS))(
    lambda spark, d: gene_ids(spark, d).withColumn("t", F.concat(F.lit("gene of "), F.coalesce("rap", F.lit("-")), F.lit(" also ")))
    .withColumn("m", F.concat(F.lit("x "), F.coalesce("msu", F.lit("-"))))
    .select("gene", L.rap_id(F.col("t")).alias("rap"), L.msu_id(F.col("m")).alias("msu"), L.chromosome_of(F.coalesce("rap", "msu")).alias("chrom"))
)
query("normalised_chromosomes", v.sql("SELECT raw, CASE WHEN d = '' THEN raw ELSE 'chr' || CASE WHEN length(d) < 2 THEN lpad(d, 2, '0') ELSE d END END AS chrom FROM (SELECT raw, regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^0+', '') AS d FROM (SELECT DISTINCT p_brand AS raw FROM part UNION SELECT DISTINCT p_type FROM part))"))(
    lambda spark, d: _normalised(spark, d)
)


def _normalised(spark, d) -> DataFrame:
    from strandwork.functions.sequence import normalise_chromosome

    p = v.table(spark, d, "part")
    names = p.select(F.col("p_brand").alias("raw")).unionByName(p.select(F.col("p_type").alias("raw"))).distinct()
    return names.select("raw", normalise_chromosome(F.col("raw")).alias("chrom"))


# Gene models and consequences

query("consequences", v.sql("""SELECT id, feature, CASE WHEN NOT snp THEN CASE feature WHEN 'CDS' THEN 'frameshift' WHEN 'exon' THEN 'exon_indel' ELSE 'indel' END ELSE CASE feature WHEN 'CDS' THEN 'missense_or_synonymous' WHEN 'exon' THEN 'exon_SNP' WHEN 'UTR' THEN 'UTR_SNP' WHEN 'intron' THEN 'intronic' END END AS consequence FROM (
    SELECT id, feature, length(ref) = 1 AND regexp_full_match(alt, '[ACGT](,[ACGT])*') AS snp FROM v_vcf JOIN (SELECT RECORD_ID AS id, CASE l_returnflag WHEN 'A' THEN 'CDS' WHEN 'N' THEN 'exon' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'UTR' ELSE 'intron' END END AS feature FROM lineitem) USING (id))""".replace("RECORD_ID", RECORD_ID), VCF))(
    lambda spark, d: vcf_columns(spark, d).join(v.table(spark, d, "lineitem").select(record_id().alias("id"), F.when(F.col("l_returnflag") == "A", "CDS").when(F.col("l_returnflag") == "N", "exon").when(F.col("l_linenumber") % 2 == 0, "UTR").otherwise("intron").alias("feature")), "id")
    .select("id", "feature", A.consequence(V.is_snp(F.col("ref"), F.split("alt", ",")), F.col("feature")).alias("consequence"))
)


@query("gene_model_order", v.sql("SELECT gene, CASE WHEN strand = '+' THEN string_agg(CAST(e.st AS VARCHAR), ',' ORDER BY e.st, e.en, e.type) ELSE string_agg(CAST(e.st AS VARCHAR), ',' ORDER BY e.st DESC, e.en DESC, e.type DESC) END AS starts FROM v_gene g JOIN v_exon e ON e.tx = g.gene GROUP BY gene, strand", v.GENES, v.EXONS))
def gene_model_order(spark, d) -> DataFrame:
    """The starts of each transcript's parts, in order of transcription."""
    g = v.genes(spark, d).select("gene", "strand")
    m = A.gene_models(g, g.select("gene", F.col("gene").alias("tx")), v.exons(spark, d))
    t = m.select("gene", F.explode("transcripts").alias("t")).where("t.parts is not null")
    return t.select("gene", F.array_join(F.transform("t.parts", lambda p: p["st"].cast("string")), ",").alias("starts"))


query("flat_gene_models", v.sql("SELECT 'gene_' || tx AS gene, tx, min(st) AS st, max(en) AS en FROM v_exon GROUP BY tx", v.EXONS))(
    lambda spark, d: A.flat_gene_models(v.exons(spark, d).withColumn("chrom", F.lit("chr01")).withColumn("strand", F.lit("+"))).select("gene", "tx", "st", "en")
)
query("primary_transcripts", v.sql("SELECT gene, tx, n AS cds_length FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, tx) AS r FROM (SELECT tx // 4 AS gene, tx, CAST(sum(en - st + 1) AS BIGINT) AS n FROM v_exon WHERE type = 'CDS' GROUP BY 1, 2)) WHERE r = 1", v.EXONS))(
    lambda spark, d: A.primary_transcripts(v.exons(spark, d).select(F.floor(F.col("tx") / 4).alias("gene"), "tx").distinct(), v.exons(spark, d).where("type = 'CDS'"))
)

# GFF3 and GTF lines made of exons


def _gff(spark, d, raw) -> DataFrame:
    e = v.exons(spark, d)
    return e.select(F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("tx") % 12).cast("string")), F.lit("src"), "type", F.col("st").cast("string"), F.col("en").cast("string"), F.lit("."), F.when(F.col("tx") % 2 == 0, "+").otherwise("-"), F.lit("0"), raw).alias("value"))


def gff_lines(spark, d) -> DataFrame:
    tx = F.col("tx").cast("string")
    return _gff(spark, d, F.concat(F.lit("ID=part"), F.col("st").cast("string"), F.lit(";Parent=tx"), tx, F.lit(",all;Note=a%20b%3Bc"), tx))


def gtf_lines(spark, d) -> DataFrame:
    tx = F.col("tx").cast("string")
    return _gff(spark, d, F.concat(F.lit('gene_id "g'), F.floor(F.col("tx") / 4).cast("string"), F.lit('"; transcript_id "t'), tx, F.lit('";')))


query("gff3_features", v.sql("SELECT 'chr' || (tx % 12) AS seqname, type, CAST(st AS INTEGER) AS start, CAST(en AS INTEGER) AS \"end\", CASE WHEN tx % 2 = 0 THEN '+' ELSE '-' END AS strand, 0 AS phase, 'part' || st AS id, 'tx' || tx || '|all' AS parents, 'a b;c' || tx AS note FROM v_exon", v.EXONS))(
    lambda spark, d: S.parse_gff3(gff_lines(spark, d)).select("seqname", "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "strand", "phase", L.attribute(F.col("attributes"), "ID").alias("id"), F.array_join(F.try_element_at("attributes", F.lit("Parent")), "|").alias("parents"), L.attribute(F.col("attributes"), "Note").alias("note"))
)
query("gff3_lines", v.sql("SELECT 'chr' || (tx % 12) || chr(9) || 'src' || chr(9) || type || chr(9) || st || chr(9) || en || chr(9) || '.' || chr(9) || CASE WHEN tx % 2 = 0 THEN '+' ELSE '-' END || chr(9) || '0' || chr(9) || 'ID=part' || st || ';Parent=tx' || tx || ',all;Note=a b%3Bc' || tx AS value FROM v_exon", v.EXONS))(
    lambda spark, d: S.gff3_text(S.parse_gff3(gff_lines(spark, d))).select("value")
)
query("gtf_features", v.sql("SELECT 'chr' || (tx % 12) AS seqname, type, CAST(st AS INTEGER) AS start, 't' || tx AS id, 't' || tx AS parent, 'g' || (tx // 4) AS gene FROM v_exon", v.EXONS))(
    lambda spark, d: S.parse_gtf(gtf_lines(spark, d)).select("seqname", "type", F.col("start").cast("int").alias("start"), L.attribute(F.col("attributes"), "ID").alias("id"), L.attribute(F.col("attributes"), "Parent").alias("parent"), L.attribute(F.col("attributes"), "gene_id").alias("gene"))
)

# Sequence records


def _fasta(spark, d) -> DataFrame:
    """Two records in one text per document: one of its letters, one with a comment and lower case."""
    s = F.col("s")
    return v.dna(spark, d).select("doc_id", F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" the text\n"), F.substring(s, 1, 70), F.lit("\n"), F.substring(s, 71, 30), F.lit("\n>e\n;note\n"), F.lower(F.substring(s, 1, 10))).alias("t"))


query("fasta_records", v.sql("SELECT doc_id, 'd' || doc_id AS id, 'the text' AS description, substr(s, 1, 100) AS sequence FROM v_dna UNION ALL SELECT doc_id, 'e', '', substr(s, 1, 10) FROM v_dna", v.DNA))(
    lambda spark, d: _fasta(spark, d).select("doc_id", F.explode(S.fasta_records(F.col("t"))).alias("r")).select("doc_id", "r.id", "r.description", "r.sequence")
)
query("fasta_lines", v.sql("SELECT '>' || doc_id || CASE WHEN substr(s, 1, 80) = '' THEN chr(10) ELSE chr(10) || substr(s, 1, 80) END || CASE WHEN length(s) > 80 THEN chr(10) || substr(s, 81, 50) ELSE '' END AS value FROM v_dna", v.DNA))(
    lambda spark, d: S.record_text(v.dna(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("description"), F.substring("s", 1, 130).alias("sequence")), "fasta")
)
query("fastq_records", v.sql("SELECT 'r' || doc_id AS id, substr(s, 1, 30) AS sequence, 30 * 40 AS quality FROM v_dna WHERE length(s) >= 30", v.DNA))(
    lambda spark, d: v.dna(spark, d).where("length(s) >= 30").select(F.explode(S.fastq_texts(F.concat(F.lit("@r"), F.col("doc_id").cast("string"), F.lit(" x\n"), F.substring("s", 1, 30), F.lit("\n+\n"), F.expr("repeat('I', 30)")))).alias("r")).select("r.id", "r.sequence", F.aggregate("r.quality", F.lit(0), lambda a, x: a + x).alias("quality"))
)


@query("record_store", v.sql("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT 10000000 + s_suppkey, 'new' FROM supplier"))
def record_store(spark, d) -> DataFrame:
    """A keyed store after new records came: those of known ids replace the old ones."""
    old = v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    new = old.where("id % 3 = 0").select("id", F.lit("new").alias("value")).unionByName(v.table(spark, d, "supplier").select((F.col("s_suppkey") + 10000000).alias("id"), F.lit("new").alias("value")))
    return S.merge_records(old, new)


# Expression

query("matrix_slice", v.sql("SELECT gene, sample, value FROM v_expr WHERE gene IN (5, 3, 11, 999999999) AND sample IN (2, 7)", v.EXPRESSION))(lambda spark, d: E.submatrix(v.expression(spark, d), [5, 3, 11, 999999999], [2, 7]).select("gene", "sample", "value"))
query("fpkm_of_totals", v.sql("SELECT gene, sample, round(coalesce(value * 1e9 / nullif(length * CAST(1000000 + sample AS DOUBLE), 0), 0), 4) AS fpkm FROM v_expr", v.EXPRESSION))(
    lambda spark, d: E.fpkm(v.expression(spark, d), spark.range(10).select(F.col("id").alias("sample"), (F.col("id") + 1000000).alias("total"))).withColumn("fpkm", F.round("fpkm", 4))
)
query("coexpressed_top", v.sql("SELECT gene, n, round(r, 6) AS r FROM (SELECT b.gene, count(*) AS n, corr(a.value, b.value) AS r FROM v_expr a JOIN v_expr b USING (sample) WHERE a.gene = 1 AND b.gene <> 1 GROUP BY b.gene HAVING count(*) >= 6) WHERE NOT isnan(r) AND abs(r) >= 0.7 ORDER BY round(abs(r), 9) DESC, gene LIMIT 20", v.EXPRESSION))(
    lambda spark, d: E.coexpressed(v.expression(spark, d), 1, 0.7, 20, 6).withColumn("r", r6("r"))
)
query("top_edges", v.sql("SELECT a, b, round(r, 6) AS r FROM (SELECT a.gene AS a, b.gene AS b, corr(a.value, b.value) AS r FROM v_expr a JOIN v_expr b ON a.sample = b.sample AND a.gene < b.gene GROUP BY 1, 2 HAVING count(*) >= 8) WHERE abs(r) >= 0.8 ORDER BY round(abs(r), 9) DESC, a, b LIMIT 100", v.EXPRESSION))(
    lambda spark, d: E.top_edges(v.expression(spark, d), 0.8, 100, 8).select("a", "b", r6("r").alias("r"))
)
query("expression_flags", v.sql("SELECT gene, padj <= 0.05 AND abs(lfc) >= 1 AS significant, padj <= 0.05 AND lfc >= 1 AS up, padj <= 0.05 AND lfc <= -1 AS down FROM (SELECT gene, sum(value) % 101 / 1000.0 AS padj, log2(max(value) / 25.0) AS lfc FROM v_expr GROUP BY gene HAVING max(value) >= 10)", v.EXPRESSION))(
    lambda spark, d: E.flags(v.expression(spark, d).groupBy("gene").agg((F.sum("value") % 101 / 1000.0).alias("padj"), F.log2(F.max("value") / 25.0).alias("lfc"), F.max("value").alias("m1"), F.lit(0).alias("m2")), 10.0).select("gene", "significant", "up", "down")
)
