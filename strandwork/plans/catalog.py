"""The queries of the reference operators and their DuckDB twins. Doubles are rounded to 6 places in both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import protein as P
from strandwork.functions import sequence as S
from strandwork.functions import tables as T
from strandwork.operators import annotation as A
from strandwork.operators import expression as E
from strandwork.operators import popgen as G
from strandwork.operators import variants as V
from strandwork.operators.relational import islands
from strandwork.plans import views as v

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def n_of(letters: str) -> str:
    return f"(length(s) - length(translate(s, '{letters}', '')))"


# Sequence projections and aggregates

query("gc_content", v.sql(f"SELECT doc_id, round(CASE WHEN length(s) = 0 THEN 0 ELSE {n_of('GC')} * 100.0 / length(s) END, 6) AS gc, round(CASE WHEN length(s) < 14 THEN 2.0 * {n_of('AT')} + 4.0 * {n_of('GC')} ELSE 64.9 + 41.0 * ({n_of('GC')} - 16.4) / length(s) END, 6) AS tm FROM v_dna", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", r6(S.gc_content(F.col("s"))).alias("gc"), r6(S.melting_temperature(F.col("s"))).alias("tm"))
)

query("base_counts", v.sql("SELECT base, count(*) AS n FROM (SELECT unnest(string_split(s, '')) AS base FROM v_dna WHERE s <> '') GROUP BY base", v.DNA))(
    lambda spark, d: v.dna(spark, d).where("s <> ''").select(F.explode(F.split("s", "")).alias("base")).where("base <> ''").groupBy("base").agg(F.count(F.lit(1)).alias("n"))
)

query("alphabet_check", v.sql("SELECT doc_id, regexp_full_match(s, '[ATGC]*') AS is_dna, regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY*]*') AS is_protein, CASE WHEN contains(s, 'U') THEN 'rna' WHEN regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY*]*') AND regexp_matches(s, '[EFIJLOPQXZ]') THEN 'protein' ELSE 'dna' END AS kind FROM v_dna", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", S.is_valid(F.col("s"), "DNA").alias("is_dna"), S.is_valid(F.col("s"), "PROTEIN").alias("is_protein"), S.infer_kind(F.col("s")).alias("kind"))
)

query("reverse_complement", v.sql("SELECT doc_id, reverse(translate(s, 'ATGC', 'TACG')) AS rc, replace(s, 'T', 'U') AS rna, replace(replace(s, 'T', 'U'), 'U', 'T') = s AS back FROM v_dna", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", S.reverse_complement(F.col("s")).alias("rc"), S.transcribe(F.col("s")).alias("rna"), (S.back_transcribe(S.transcribe(F.col("s"))) == F.col("s")).alias("back"))
)

FRAMES = """SELECT doc_id, frame, string_agg(aa, '' ORDER BY i) AS all_aa FROM (
    SELECT doc_id, frame, i, aa FROM (SELECT doc_id, frame, unnest(range(0, (length(x) - off) // 3)) AS i, x, off FROM (
        SELECT doc_id, s AS x, '+' || CAST(o + 1 AS VARCHAR) AS frame, o AS off FROM v_dna, range(3) t(o)
        UNION ALL SELECT doc_id, reverse(translate(s, 'ATGC', 'TACG')), '-' || CAST(o + 1 AS VARCHAR), o FROM v_dna, range(3) t(o))
    ) JOIN v_codon ON codon = substr(x, CAST(off + i * 3 + 1 AS INTEGER), 3)) GROUP BY 1, 2"""

query("six_frame_translation", v.sql(f"SELECT d.doc_id, f.frame, coalesce(string_split(g.all_aa, '*')[1], '') AS protein FROM v_dna d CROSS JOIN (SELECT unnest(['+1', '+2', '+3', '-1', '-2', '-3']) AS frame) f LEFT JOIN ({FRAMES}) g ON g.doc_id = d.doc_id AND g.frame = f.frame", v.DNA, v.CODONS))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.six_frames(F.col("s"))).alias("x")).select("doc_id", "x.frame", "x.protein")
)

query("find_motif", v.sql("SELECT doc_id, p - 1 AS pos FROM (SELECT doc_id, s, unnest(range(1, length(s) - 3)) AS p FROM v_dna WHERE length(s) >= 5) WHERE substr(s, CAST(p AS INTEGER), 5) = 'TATAA'", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.find_motif(F.col("s"), "TATAA")).alias("pos")).select("doc_id", F.col("pos").cast("long"))
)



@query("virtual_digest", v.sql("""SELECT doc_id, count(*) AS fragments, CAST(max(b - a) AS BIGINT) AS longest, CAST(sum(b - a) AS BIGINT) AS total FROM (
    SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (
        SELECT doc_id, 0 AS a FROM v_dna UNION SELECT doc_id, length(s) FROM v_dna
        UNION SELECT doc_id, p - 1 + 1 FROM (SELECT doc_id, s, unnest(range(1, length(s) - 4)) AS p FROM v_dna WHERE length(s) >= 6) WHERE substr(s, CAST(p AS INTEGER), 6) IN ('GAATTC', 'GGATCC'))
    ) WHERE b IS NOT NULL GROUP BY doc_id""", v.DNA))
def virtual_digest(spark, d) -> DataFrame:
    parts = v.dna(spark, d).select("doc_id", F.explode(S.virtual_digest(F.col("s"), ["EcoRI", "BamHI"])).alias("f"))
    n = F.length("f").cast("long")
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fragments"), F.max(n).alias("longest"), F.sum(n).alias("total"))


@query("find_orfs", v.sql("""SELECT doc_id, frame, start, stop + 3 AS "end", stop - start AS coding FROM (
    SELECT doc_id, frame, start, codon, min(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN start END) OVER (PARTITION BY doc_id, frame ORDER BY start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM (
        SELECT doc_id, p % 3 + 1 AS frame, p AS start, substr(s, CAST(p + 1 AS INTEGER), 3) AS codon FROM (SELECT doc_id, s, unnest(range(0, length(s) - 2)) AS p FROM v_dna WHERE length(s) >= 3))
    ) WHERE codon = 'ATG' AND stop IS NOT NULL AND stop + 3 - start >= 100""", v.DNA))
def find_orfs(spark, d) -> DataFrame:
    c = v.dna(spark, d).select("doc_id", F.posexplode(S.kmers(F.col("s"), 3)).alias("p", "codon")).select("doc_id", F.col("p").cast("long").alias("start"), (F.col("p") % 3 + 1).cast("long").alias("frame"), "codon").where(F.col("codon").isin("ATG", "TAA", "TAG", "TGA"))
    w = Window.partitionBy("doc_id", "frame").orderBy("start").rowsBetween(0, Window.unboundedFollowing)
    c = c.withColumn("stop", F.min(F.when(F.col("codon") != "ATG", F.col("start"))).over(w))
    return c.where((F.col("codon") == "ATG") & (F.col("stop") + 3 - F.col("start") >= 100)).select("doc_id", "frame", "start", (F.col("stop") + 3).alias("end"), (F.col("stop") - F.col("start")).alias("coding"))


query("gc_skew_windows", v.sql(f"SELECT doc_id, p AS pos, round(CASE WHEN g + c = 0 THEN 0 ELSE CAST(g - c AS DOUBLE) / (g + c) END, 6) AS skew FROM (SELECT doc_id, p, length(w) - length(replace(w, 'G', '')) AS g, length(w) - length(replace(w, 'C', '')) AS c FROM (SELECT doc_id, p, substr(s, CAST(p + 1 AS INTEGER), 100) AS w FROM (SELECT doc_id, s, unnest(range(0, length(s) - 99, 10)) AS p FROM v_dna WHERE length(s) >= 100)))", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.gc_skew(F.col("s"))).alias("x")).select("doc_id", "x.pos", r6("x.skew").alias("skew"))
)

query("bubble_stability", v.sql("SELECT doc_id, count(*) AS windows, round(avg((10 - length(translate(w, 'AT', ''))) / 10.0), 6) AS mean_at, round(max((10 - length(translate(w, 'AT', ''))) / 10.0), 6) AS max_at FROM (SELECT doc_id, substr(s, CAST(p + 1 AS INTEGER), 10) AS w FROM (SELECT doc_id, s, unnest(range(0, length(s) - 9)) AS p FROM v_dna WHERE length(s) >= 10)) GROUP BY doc_id", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.bubble_stability(F.col("s"))).alias("x")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), r6(F.avg("x.at")).alias("mean_at"), r6(F.max("x.at")).alias("max_at"))
)


def _kmer_sql(k: int) -> str:
    return f"SELECT doc_id, substr(s, CAST(p + 1 AS INTEGER), {k}) AS kmer FROM (SELECT doc_id, s, unnest(range(0, length(s) - {k - 1})) AS p FROM v_dna WHERE length(s) >= {k})"


def _counted(seqs: DataFrame, k: int, name: str) -> DataFrame:
    """Occurrences of each k-mer and texts with it: a text's k-mers are sorted, its first of a kind marked, so one aggregation over k-mers does."""
    marked = S.let(F.array_sort(S.kmers(F.col("s"), k)), lambda a: F.transform(a, lambda x, i: F.struct(x.alias("x"), ((i == 0) | (F.get(a, i - 1) != x)).cast("long").alias("new"))))
    return seqs.select(F.explode(marked).alias("y")).groupBy(F.col("y.x").alias(name)).agg(F.count(F.lit(1)).alias("n"), F.sum("y.new").alias("docs"))


query("kmer_counts", v.sql(f"SELECT kmer, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_kmer_sql(6)}) GROUP BY kmer", v.DNA))(
    lambda spark, d: _counted(v.dna(spark, d), 6, "kmer")
)


@query("dinucleotide_frequency", v.sql(f"SELECT kmer AS dinucleotide, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS freq FROM ({_kmer_sql(2)}) GROUP BY kmer", v.DNA))
def dinucleotide_frequency(spark, d) -> DataFrame:
    n = v.dna(spark, d).select(F.explode(S.kmers(F.col("s"), 2)).alias("dinucleotide")).groupBy("dinucleotide").agg(F.count(F.lit(1)).alias("n"))
    return n.select("dinucleotide", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("freq"))


CODON_COUNT = "v_cc AS (SELECT codon, count(*) AS n FROM (SELECT substr(s, CAST(i * 3 + 1 AS INTEGER), 3) AS codon FROM (SELECT s, unnest(range(0, length(s) // 3)) AS i FROM v_dna)) GROUP BY codon)"


def codon_usage(spark, d) -> DataFrame:
    return v.dna(spark, d).select(F.explode(S.codons(F.col("s"))).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))


query("codon_usage", v.sql("SELECT * FROM v_cc", v.DNA, CODON_COUNT))(codon_usage)


@query("codon_adaptation", v.sql("SELECT codon, aa, n, round(CASE WHEN fam = 0 THEN 0 ELSE n / fam END, 6) AS rscu FROM (SELECT c.codon, c.aa, coalesce(n, 0) AS n, avg(coalesce(n, 0)) OVER (PARTITION BY aa) AS fam FROM v_codon c LEFT JOIN v_cc USING (codon) WHERE aa <> '*')", v.DNA, v.CODONS, CODON_COUNT))
def codon_adaptation(spark, d) -> DataFrame:
    dim = spark.createDataFrame(list(T.codon_table().items()), "codon string, aa string").where("aa <> '*'")
    n = F.coalesce("n", F.lit(0))
    fam = F.avg(n).over(Window.partitionBy("aa"))
    return dim.join(codon_usage(spark, d), "codon", "left").select("codon", "aa", n.alias("n"), r6(F.when(fam == 0, 0.0).otherwise(n / fam)).alias("rscu"))


@query("shannon_entropy", v.sql("SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT doc_id, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, unnest(string_split(s, '')) AS b FROM v_dna WHERE s <> '') GROUP BY doc_id, b) GROUP BY doc_id", v.DNA))
def shannon_entropy(spark, d) -> DataFrame:
    return v.dna(spark, d).where("s <> ''").select("doc_id", r6(S.entropy(F.col("s"))).alias("entropy"))


def _complexity_sql(text: str, most: int = 8) -> str:
    seen = " + ".join(f"len(list_distinct(list_transform(range(1, greatest(length({text}) - {k - 2}, 1)), lambda i: substr({text}, CAST(i AS INTEGER), {k}))))" for k in range(1, most + 1))
    could = " + ".join(f"greatest(least({4**k}, length({text}) - {k - 1}), 0)" for k in range(1, most + 1))
    return f"CASE WHEN {could} = 0 THEN 0 ELSE CAST({seen} AS DOUBLE) / ({could}) END"




@query("te_content", v.sql(f"SELECT doc_id, count(*) AS windows, round(avg(CASE WHEN cx < 0.4 - 1e-9 OR gc > 75 OR gc < 25 THEN 1.0 ELSE 0.0 END), 6) AS te FROM (SELECT doc_id, {_complexity_sql('w')} AS cx, (500 - length(translate(w, 'GC', ''))) / 5.0 AS gc FROM (SELECT doc_id, substr(s, CAST(k * 500 + 1 AS INTEGER), 500) AS w FROM (SELECT doc_id, s, unnest(range(0, length(s) // 500)) AS k FROM v_dna))) GROUP BY doc_id", v.DNA))
def te_content(spark, d) -> DataFrame:
    w = v.dna(spark, d).select("doc_id", F.explode(S.windows(F.col("s"), 500, 500)).alias("w"))
    gc = S.count_of(F.col("w"), "GC") / 5.0
    low = (S.linguistic_complexity(F.col("w")) < 0.4 - 1e-9) | (gc > 75) | (gc < 25)
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), r6(F.avg(low.cast("double"))).alias("te"))


@query("assembly_stats", v.sql("""SELECT n, CAST(total AS BIGINT) AS total, mean, shortest, longest, n50, l50, n90, l90 FROM (SELECT count(*) AS n, sum(length(s)) AS total, round(avg(length(s)), 6) AS mean, min(length(s)) AS shortest, max(length(s)) AS longest FROM v_dna),
    (SELECT max(len) FILTER (cum >= 0.5 * tot) AS n50, min(r) FILTER (cum >= 0.5 * tot) AS l50, max(len) FILTER (cum >= 0.9 * tot) AS n90, min(r) FILTER (cum >= 0.9 * tot) AS l90 FROM (
        SELECT length(s) AS len, row_number() OVER (ORDER BY length(s) DESC, doc_id) AS r, sum(length(s)) OVER (ORDER BY length(s) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS cum, sum(length(s)) OVER () AS tot FROM v_dna))""", v.DNA))
def assembly_stats(spark, d) -> DataFrame:
    """Counts per length first: cumulative sums run over distinct lengths, not over sequences."""
    n = v.dna(spark, d).groupBy(F.length("s").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    down = Window.orderBy(F.col("len").desc())
    n = n.withColumn("cum", F.sum(F.col("len") * F.col("c")).over(down)).withColumn("before", F.sum("c").over(down) - F.col("c")).withColumn("tot", F.sum(F.col("len") * F.col("c")).over(Window.partitionBy()))

    def at_share(x: float) -> tuple[Column, Column]:
        reach = F.col("cum") >= x * F.col("tot")
        within = F.ceil((x * F.col("tot") - (F.col("cum") - F.col("len") * F.col("c"))) / F.greatest("len", F.lit(1)))
        return F.max(F.when(reach, F.col("len"))), F.min(F.when(reach, F.col("before") + F.greatest(within, F.lit(1)))).cast("long")

    (n50, l50), (n90, l90) = at_share(0.5), at_share(0.9)
    total = F.sum(F.col("len") * F.col("c"))
    return n.agg(F.sum("c").alias("n"), total.alias("total"), r6(total / F.sum("c")).alias("mean"), F.min("len").alias("shortest"), F.max("len").alias("longest"), n50.alias("n50"), l50.alias("l50"), n90.alias("n90"), l90.alias("l90"))


@query("cis_motif_counts", v.sql("SELECT 'G-box' AS motif, strand, CAST(sum((length(x) - length(replace(x, 'CACGTG', ''))) // 6) AS BIGINT) AS n FROM (SELECT '+' AS strand, s AS x FROM v_dna UNION ALL SELECT '-', reverse(translate(s, 'ATGC', 'TACG')) FROM v_dna) GROUP BY strand UNION ALL SELECT 'TATA', strand, CAST(sum((length(x) - length(replace(x, 'TATAAAT', ''))) // 7) AS BIGINT) FROM (SELECT '+' AS strand, s AS x FROM v_dna UNION ALL SELECT '-', reverse(translate(s, 'ATGC', 'TACG')) FROM v_dna) GROUP BY strand", v.DNA))
def cis_motif_counts(spark, d) -> DataFrame:
    both = v.dna(spark, d).select(F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("s").alias("x")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.col("s")).alias("x")))).alias("y")).select("y.*")
    hits = F.array(F.struct(F.lit("G-box").alias("motif"), F.regexp_count("x", F.lit("CACGTG")).alias("n")), F.struct(F.lit("TATA").alias("motif"), F.regexp_count("x", F.lit("TATAAAT")).alias("n")))
    return both.select("strand", F.explode(hits).alias("h")).groupBy("h.motif", "strand").agg(F.sum("h.n").alias("n"))


# Proteins

def aa_total(values: dict) -> str:
    return "(" + " + ".join(f"{n_of(a)} * {x!r}" for a, x in sorted(values.items()) if x) + ")"


ALL20 = n_of("ACDEFGHIKLMNPQRSTVWY")

query("protein_profile", v.sql(f"""SELECT doc_id, length(s) AS len, CAST(round({aa_total(T.MASS)} - (length(s) - 1) * 18.02, 4) AS DOUBLE) AS mw, round({aa_total(T.HYDROPATHY)} / {ALL20}, 6) AS gravy, round({aa_total(T.BOMAN)} / {ALL20}, 6) AS boman,
    round(CAST({n_of('FHWY')} AS DOUBLE) / length(s), 6) AS aromaticity, round(CAST({n_of('AVILMFWP')} AS DOUBLE) / length(s), 6) AS hydrophobic, round(100.0 * ({n_of('A')} + 2.9 * {n_of('V')} + 3.9 * {n_of('IL')}) / length(s), 6) AS aliphatic,
    CAST({n_of('W')} * 5500.0 + {n_of('Y')} * 1490.0 + {n_of('C')} * 125.0 AS DOUBLE) AS extinction FROM v_prot WHERE s <> ''""", v.PROTEIN))(
    lambda spark, d: v.protein(spark, d).where("s <> ''").select("doc_id", P.figures(F.col("s")).alias("x")).select("doc_id", "x.len", F.round("x.weight", 4).alias("mw"), *(r6(f"x.{c}").alias(c) for c in ("gravy", "boman", "aromaticity", "hydrophobic", "aliphatic")), "x.extinction")
)


def charge_sql(ph: float) -> str:
    part = [f"1.0 / (1.0 + pow(10.0, {ph} - 8.0)) - 1.0 / (1.0 + pow(10.0, 3.1 - {ph}))"]
    part += [(f"- {n_of(a)} * (1.0 / (1.0 + pow(10.0, {k} - {ph})))" if a in "DECY" else f"+ {n_of(a)} * (1.0 / (1.0 + pow(10.0, {ph} - {k})))") for a, k in T.PKA.items()]
    return " ".join(part)


query("charge_profile", v.sql(" UNION ALL ".join(f"SELECT doc_id, CAST({float(ph)} AS DOUBLE) AS ph, round({charge_sql(float(ph))}, 6) AS charge FROM v_prot" for ph in range(0, 15, 2)), v.PROTEIN))(
    lambda spark, d: v.protein(spark, d).select("doc_id", F.explode(F.array(*(F.struct(F.lit(float(ph)).alias("ph"), r6(P.charge_at(F.col("s"), float(ph))).alias("charge")) for ph in range(0, 15, 2)))).alias("x")).select("doc_id", "x.ph", "x.charge")
)

query("amino_acid_composition", v.sql("SELECT doc_id, aa, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS fraction FROM (SELECT doc_id, unnest(string_split(s, '')) AS aa FROM v_prot WHERE s <> '') GROUP BY 1, 2", v.PROTEIN))(
    lambda spark, d: v.protein(spark, d).where("s <> ''").select("doc_id", F.length("s").alias("len"), F.explode(F.array(*(F.struct(F.lit(a).alias("aa"), S.count_of(F.col("s"), a).alias("n")) for a in T.RESIDUES))).alias("x")).where("x.n > 0").select("doc_id", "x.aa", "x.n", r6(F.col("x.n") / F.col("len")).alias("fraction"))
)

query("dipeptide_composition", v.sql("SELECT dipeptide, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, substr(s, CAST(p + 1 AS INTEGER), 2) AS dipeptide FROM (SELECT doc_id, s, unnest(range(0, length(s) - 1)) AS p FROM v_prot WHERE length(s) >= 2)) GROUP BY 1", v.PROTEIN))(
    lambda spark, d: _counted(v.protein(spark, d), 2, "dipeptide")
)

DIWV = "map {" + ", ".join(f"'{k}': {x!r}" for k, x in T.INSTABILITY.items()) + "}"

query("instability_index", v.sql(f"SELECT doc_id, round(10.0 * sum(coalesce(m[substr(s, CAST(p + 1 AS INTEGER), 2)], 1.0)) / max(length(s)), 4) AS instability FROM (SELECT doc_id, s, unnest(range(0, length(s) - 1)) AS p FROM v_prot WHERE length(s) >= 2), (SELECT {DIWV} AS m) GROUP BY doc_id", v.PROTEIN))(
    lambda spark, d: v.protein(spark, d).where("length(s) >= 2").select("doc_id", F.round(P.instability_index(F.col("s")), 4).alias("instability"))
)

INTERFACE = "map {" + ", ".join(f"'{k}': {x!r}" for k, x in T.INTERFACE.items()) + "}"


@query("interface_residues", v.sql(f"SELECT doc_id, count(*) AS n, count(*) FILTER (score >= 1.05 - 1e-9) AS likely, round(max(score), 6) AS best FROM (SELECT doc_id, avg(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS score FROM (SELECT doc_id, p, coalesce(m[substr(s, CAST(p + 1 AS INTEGER), 1)], 1.0) AS x FROM (SELECT doc_id, s, unnest(range(0, length(s))) AS p FROM v_prot WHERE s <> ''), (SELECT {INTERFACE} AS m))) GROUP BY doc_id", v.PROTEIN))
def interface_residues(spark, d) -> DataFrame:
    x = v.protein(spark, d).where("s <> ''").select("doc_id", P.interface_residues(F.col("s")).alias("x"))
    score = F.transform("x", lambda e: e["score"])
    return x.select("doc_id", F.size("x").cast("long").alias("n"), F.size(F.filter(score, lambda e: e >= 1.05 - 1e-9)).cast("long").alias("likely"), r6(F.array_max(score)).alias("best"))


KD = "map {" + ", ".join(f"'{k}': {x!r}" for k, x in T.HYDROPATHY.items()) + "}"
CC = "map {" + ", ".join(f"'{k}': {x!r}" for k, x in T.COILED_COIL.items()) + "}"


def _segments_sql(table: str, width: int, least: float, touch: int) -> str:
    return f"""SELECT doc_id, min(p) AS start, max(p) + {width} AS "end", count(*) AS windows FROM (
        SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (
            SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {touch} THEN 0 ELSE 1 END AS n FROM (
                SELECT doc_id, p, full_len, avg(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS score FROM (
                    SELECT doc_id, p, length(s) AS full_len, m[substr(s, CAST(p + 1 AS INTEGER), 1)] AS x FROM (SELECT doc_id, s, unnest(range(0, length(s))) AS p FROM v_prot WHERE s <> ''), (SELECT {table} AS m)))
            WHERE p <= full_len - {width} AND score >= {least} - 1e-9)) GROUP BY doc_id, island"""


def _segments(df: DataFrame, values: dict, width: int, least: float, touch: int) -> DataFrame:
    """Runs of windows of a mean of at least `least`: prefix sums give the means, islands the runs."""
    x = P.residue_values(F.col("s"), values, 0.0)
    long = df.where("s <> ''").select("doc_id", F.posexplode(x).alias("p", "x"))
    w = Window.partitionBy("doc_id").orderBy("p")
    ahead = w.rowsBetween(Window.currentRow, width - 1)
    win = long.withColumn("score", F.avg("x").over(ahead)).withColumn("full", F.count(F.lit(1)).over(ahead) == width).where(F.col("full") & (F.col("score") >= least - 1e-9))
    win = win.select("doc_id", F.col("p").cast("long").alias("a"), (F.col("p") + touch).cast("long").alias("b"))
    return islands(win, ["doc_id"], "a", "b").select("doc_id", "start", (F.col("end") - touch + width).alias("end"), F.col("members").alias("windows"))


query("coiled_coil_segments", v.sql(_segments_sql(CC, 21, 1.1, 21), v.PROTEIN))(lambda spark, d: _segments(v.protein(spark, d), T.COILED_COIL, 21, 1.1, 21))
query("transmembrane_helices", v.sql(_segments_sql(KD, 19, 1.6, 1), v.PROTEIN))(lambda spark, d: _segments(v.protein(spark, d), T.HYDROPATHY, 19, 1.6, 1))

RG = ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{n}' END" for n, p in T.RGENE_PATTERNS.items())

query("rgene_evidence", v.sql(f"SELECT doc_id, list_contains(e, 'p_loop') OR list_contains(e, 'rnbs') OR list_contains(e, 'mhd') OR (list_contains(e, 'lrr') AND list_contains(e, 'kinase')) AS likely, list_sort(e) AS evidence FROM (SELECT doc_id, list_filter([{RG}, CASE WHEN len(regexp_extract_all(s, '{T.RGENE_LRR}')) >= 2 THEN 'lrr' END, CASE WHEN regexp_matches(substr(s, 1, 300), '{T.RGENE_TIR}') THEN 'tir' END, CASE WHEN length(s) > 25 AND 25 - length(translate(substr(s, 1, 25), 'AVILMFWP', '')) > 12.5 THEN 'signal' END], lambda x: x IS NOT NULL) AS e FROM v_prot)", v.PROTEIN))(
    lambda spark, d: v.protein(spark, d).select("doc_id", P.rgene_evidence(F.col("s")).alias("e")).select("doc_id", P.is_rgene(F.col("e")).alias("likely"), F.array_sort("e").alias("evidence"))
)

query("metal_binding_residues", v.sql(f"SELECT doc_id, {n_of('HCDEM')} AS n FROM v_prot", v.PROTEIN))(lambda spark, d: v.protein(spark, d).select("doc_id", F.size(P.metal_binding(F.col("s"))).cast("long").alias("n")))

# Variants

SAMPLES = 40


def site(spark, d) -> DataFrame:
    return V.sites(v.genotypes(spark, d))


query("variant_sites", v.sql("SELECT chrom, pos, n, called, alt, round(p, 6) AS p, round(maf, 6) AS maf, round(het, 6) AS het, round(missing, 6) AS missing FROM v_site", v.GENOTYPES, v.SITES))(
    lambda spark, d: site(spark, d).select("chrom", "pos", "n", "called", "alt", *(r6(c).alias(c) for c in ("p", "maf", "het", "missing")))
)
query("variant_filter", v.sql("SELECT chrom, pos, round(maf, 6) AS maf FROM v_site WHERE maf >= 0.2 - 1e-12 AND missing <= 0.3 + 1e-12", v.GENOTYPES, v.SITES))(lambda spark, d: V.passing(site(spark, d), 0.2 - 1e-12, 0.3 + 1e-12).select("chrom", "pos", r6("maf").alias("maf")))
query("variant_summary", v.sql("SELECT count(*) AS n_sites, count(DISTINCT chrom) AS n_chroms, round(avg(maf), 6) AS avg_maf, round(avg(missing), 6) AS avg_missing, count(*) FILTER (maf > 0 AND maf <= 1.0 / greatest(2 * n, 1)) AS singletons FROM v_site", v.GENOTYPES, v.SITES))(
    lambda spark, d: V.summarise(site(spark, d)).select("n_sites", "n_chroms", r6("avg_maf").alias("avg_maf"), r6("avg_missing").alias("avg_missing"), "singletons")
)
query("variant_classes", v.sql("SELECT count(*) FILTER (ref <> alt) AS snps, count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS transitions, count(*) FILTER (ref <> alt AND ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS transversions FROM v_var", v.VARIANTS))(
    lambda spark, d: v.variants(spark, d).agg(F.count_if((F.col("ref") != F.col("alt")) & V.is_snp(F.col("ref"), F.array("alt"))).alias("snps"), F.count_if(V.is_transition(F.col("ref"), F.col("alt"))).alias("transitions"), F.count_if((F.col("ref") != F.col("alt")) & ~V.is_transition(F.col("ref"), F.col("alt"))).alias("transversions"))
)
query("snp_density", v.sql("SELECT g.chrom, g.k * 20000 + 1 AS start, count(t.pos) AS n_snps, round(coalesce(sum(CAST(round(2 * t.p * (1 - t.p) * 1000000000000) AS BIGINT)), 0) / 1e12::DOUBLE / 20000, 12) AS pi FROM (SELECT chrom, unnest(range(0, (max(pos) - 1) // 20000 + 1)) AS k FROM v_site GROUP BY chrom) g LEFT JOIN v_site t ON t.chrom = g.chrom AND (t.pos - 1) // 20000 = g.k GROUP BY 1, 2", v.GENOTYPES, v.SITES))(
    lambda spark, d: V.tumbling(site(spark, d), 20000).select("chrom", "start", "n_snps", F.round("pi", 12).alias("pi"))
)
_n = 2 * SAMPLES
_a1, _a2 = V._sums(_n)
_b1, _b2 = (_n + 1) / (3 * (_n - 1)), 2 * (_n * _n + _n + 3) / (9 * _n * (_n - 1))
_e1, _e2 = (_b1 - 1 / _a1) / _a1, (_b2 - (_n + 2) / (_a1 * _n) + _a2 / (_a1 * _a1)) / (_a1 * _a1 + _a2)
WINDOWS = "v_win AS (SELECT chrom, k * 10000 + 1 AS start, count(*) AS c, sum(CAST(round(2 * p * (1 - p) * 1000000000000) AS BIGINT)) / 1e12::DOUBLE AS h FROM (SELECT chrom, p, unnest(range(CAST(greatest(0, ceil((pos - 20000) / 10000.0)) AS BIGINT), (pos - 1) // 10000 + 1)) AS k FROM v_site WHERE p > 0 AND p < 1) GROUP BY 1, 2)"


def windowed_diversity(spark, d) -> DataFrame:
    w = V.diversity(site(spark, d), SAMPLES, 20000, 10000)
    return w.select("chrom", "start", "n_snps", F.round("pi", 12).alias("pi"), F.round("theta_w", 12).alias("theta_w"), r6("tajima_d").alias("tajima_d"))


query("windowed_diversity", v.sql(f"SELECT chrom, start, c AS n_snps, round(h / 20000, 12) AS pi, round(c / (CAST({_a1!r} AS DOUBLE) * 20000), 12) AS theta_w, round(CASE WHEN c < 2 THEN 0 ELSE (h * {_n} / {_n - 1}.0 - c / CAST({_a1!r} AS DOUBLE)) / sqrt(CAST({_e1!r} AS DOUBLE) * c + CAST({_e2!r} AS DOUBLE) * CAST(c AS DOUBLE) * (c - 1)) END, 6) AS tajima_d FROM v_win", v.GENOTYPES, v.SITES, WINDOWS))(windowed_diversity)
query("selection_windows", v.sql("SELECT chrom, start, c AS n_snps, round(z, 6) AS z FROM (SELECT *, (h / 20000 - avg(h / 20000) OVER ()) / greatest(stddev_pop(h / 20000) OVER (), 0.001) AS z FROM v_win WHERE c >= 5) WHERE abs(z) >= 0.5", v.GENOTYPES, v.SITES, WINDOWS))(
    lambda spark, d: V.outlier_windows(V.diversity(site(spark, d), SAMPLES, 20000, 10000), z=0.5).select("chrom", "start", "n_snps", r6("z").alias("z"))
)


@query("selection_sweeps", v.sql("""SELECT chrom, k * 50000 + 1 AS start, count(*) AS n_snps, round(avg(f), 6) AS fst, round(avg(dp), 6) AS dp, round(avg(f) * avg(dp) * ln(count(*) + 1), 6) AS score FROM (
    SELECT chrom, dp, CASE WHEN ht > 0 THEN (ht - hs) / ht ELSE 0 END AS f, unnest(range(CAST(greatest(0, ceil((pos - 200000) / 50000.0)) AS BIGINT), (pos - 1) // 50000 + 1)) AS k FROM (
        SELECT a.chrom, a.pos, abs(a.p - b.p) AS dp, 2 * (a.p + b.p) / 2 * (1 - (a.p + b.p) / 2) AS ht, a.p * (1 - a.p) + b.p * (1 - b.p) AS hs FROM
            (SELECT chrom, pos, coalesce(CAST(sum(dos) AS DOUBLE) / nullif(2 * count(dos), 0), 0) AS p FROM v_geno WHERE sample < 20 GROUP BY 1, 2) a JOIN
            (SELECT chrom, pos, coalesce(CAST(sum(dos) AS DOUBLE) / nullif(2 * count(dos), 0), 0) AS p FROM v_geno WHERE sample >= 20 GROUP BY 1, 2) b USING (chrom, pos))) GROUP BY 1, 2 HAVING count(*) >= 10""", v.GENOTYPES))
def selection_sweeps(spark, d) -> DataFrame:
    g = v.genotypes(spark, d)
    x = V.sweeps(V.sites(g.where("sample < 20")), V.sites(g.where("sample >= 20")), 200000, 50000, 10)
    return x.select("chrom", "start", "n_snps", *(r6(c).alias(c) for c in ("fst", "dp", "score")))


LD = """v_ld AS (SELECT *, n11 / n - p1 * p2 AS d FROM (SELECT a.chrom, a.pos, b.pos AS pos2, count(*) AS n, sum(a.dos * b.dos) / 4.0 AS n11, sum(a.dos) / 2.0 / count(*) AS p1, sum(b.dos) / 2.0 / count(*) AS p2
    FROM v_geno a JOIN v_geno b ON a.chrom = b.chrom AND a.sample = b.sample AND b.pos > a.pos AND b.pos - a.pos <= 2000 WHERE a.dos IS NOT NULL AND b.dos IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2))"""
query("ld_pairs", v.sql("SELECT chrom, pos, pos2, n, round(CASE WHEN vv > 1e-12 THEN least(1.0, d * d / vv) ELSE 0 END, 6) AS r2, round(CASE WHEN vv > 1e-12 AND t > 1e-12 THEN least(1.0, abs(d / t)) ELSE 0 END, 6) AS dprime FROM (SELECT *, p1 * (1 - p1) * p2 * (1 - p2) AS vv, CASE WHEN d > 0 THEN least(p1 * (1 - p2), (1 - p1) * p2) ELSE least(p1 * p2, (1 - p1) * (1 - p2)) END AS t FROM v_ld)", v.GENOTYPES, LD))(
    lambda spark, d: V.ld_pairs(v.genotypes(spark, d), 2000, 2).select("chrom", "pos", "pos2", "n", r6("r2").alias("r2"), r6("dprime").alias("dprime"))
)
query("haplotype_blocks", None)(lambda spark, d: V.haplotype_blocks(V.ld_pairs(v.genotypes(spark, d), 2000, 2), site(spark, d)))
query("haplotype_diversity", v.sql("SELECT chrom, start, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_haplotypes, max(c) AS largest, round(1 - CAST(sum(c * c) AS DOUBLE) / (sum(c) * sum(c)), 6) AS diversity FROM (SELECT chrom, start, hap, count(*) AS c FROM (SELECT chrom, ((pos - 1) // 20000) * 20000 + 1 AS start, sample, string_agg(CAST(pos AS VARCHAR) || ':' || CASE WHEN dos >= 1 THEN '1' WHEN dos = 0 THEN '0' ELSE '?' END, ',' ORDER BY pos) AS hap FROM v_geno GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) GROUP BY 1, 2", v.GENOTYPES))(
    lambda spark, d: V.haplotypes(v.genotypes(spark, d), 20000).select("chrom", "start", "n", "n_haplotypes", "largest", r6("diversity").alias("diversity"))
)
query("subpopulations", v.sql("SELECT sample, called, round(het, 6) AS het, round(hom_alt, 6) AS hom_alt, CASE WHEN called < 50 THEN 'Unknown' WHEN het > 0.15 THEN 'Admixed' WHEN hom_alt > 0.45 THEN 'Indica' WHEN hom_alt < 0.20 THEN 'Japonica' ELSE 'Intermediate' END AS subpopulation FROM (SELECT sample, count(dos) AS called, avg(CASE WHEN dos = 1 THEN 1.0 WHEN dos IS NOT NULL THEN 0.0 END) AS het, avg(CASE WHEN dos = 2 THEN 1.0 WHEN dos IS NOT NULL THEN 0.0 END) AS hom_alt FROM v_geno GROUP BY sample)", v.GENOTYPES))(
    lambda spark, d: V.subpopulations(v.genotypes(spark, d), 50).select("sample", "called", r6("het").alias("het"), r6("hom_alt").alias("hom_alt"), "subpopulation")
)
query("dosage_matrix", v.sql("SELECT chrom, pos, " + ", ".join(f"coalesce(max(CASE WHEN sample = {i} THEN coalesce(dos, -1) END), -1) AS s{i}" for i in range(SAMPLES)) + " FROM v_geno GROUP BY 1, 2", v.GENOTYPES))(lambda spark, d: V.dosage_matrix(v.genotypes(spark, d), list(range(SAMPLES))))
CHROMS = "v_chrom(name, size, lo, hi) AS (VALUES " + ", ".join(f"('{k}', {n}, {lo}, {hi})" for k, (n, lo, hi) in T.CHROMOSOMES.items()) + ")"
ARMS = f"v_arm AS (SELECT s.chrom, s.pos, CASE WHEN s.pos * 100 <= {T.TELOMERE} OR s.pos * 100 >= size - {T.TELOMERE} THEN 'telomeric' WHEN s.pos * 100 BETWEEN lo AND hi THEN 'centromeric' WHEN s.pos * 100 < lo THEN 'short arm (p)' ELSE 'long arm (q)' END AS place FROM v_site s LEFT JOIN v_chrom ON name = s.chrom)"
query("chromosome_positions", v.sql("SELECT place, count(*) AS n FROM v_arm GROUP BY place", v.GENOTYPES, v.SITES, CHROMS, ARMS))(
    lambda spark, d: site(spark, d).select(S.chromosome_position(F.col("chrom"), F.col("pos") * 100).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
)
query("chromosome_arms", v.sql("SELECT * FROM v_arm", v.GENOTYPES, v.SITES, CHROMS, ARMS))(lambda spark, d: site(spark, d).select("chrom", "pos", S.chromosome_position(F.col("chrom"), F.col("pos") * 100).alias("place")))
# Annotation

JOINED = "v_hit AS (SELECT v.id, v.chrom, v.pos, g.gene FROM v_var v JOIN v_gene g ON v.chrom = g.chrom AND v.pos BETWEEN g.st AND g.en)"


def variant_ids(spark, d) -> DataFrame:
    return v.variants(spark, d).select("id", "chrom", "pos")


query("annotate_variants", v.sql("""SELECT id, chrom, pos, gene, 'genic' AS place, 0 AS distance FROM v_hit UNION ALL SELECT id, chrom, pos, gene, place, distance FROM (
    SELECT v.id, v.chrom, v.pos, g.gene, CASE WHEN (g.strand = '+' AND v.pos < g.st) OR (g.strand = '-' AND v.pos > g.en) THEN 'upstream' ELSE 'downstream' END AS place, least(abs(g.st - v.pos), abs(g.en - v.pos)) AS distance,
        row_number() OVER (PARTITION BY v.id ORDER BY least(abs(g.st - v.pos), abs(g.en - v.pos)), g.gene) AS r
    FROM v_var v JOIN v_gene g ON v.chrom = g.chrom AND g.st BETWEEN v.pos - 7000 AND v.pos + 2000 AND least(abs(g.st - v.pos), abs(g.en - v.pos)) <= 2000 WHERE v.id NOT IN (SELECT id FROM v_hit)) WHERE r = 1""", v.VARIANTS, v.GENES, JOINED))(
    lambda spark, d: A.annotate(variant_ids(spark, d), v.genes(spark, d)).withColumn("distance", F.col("distance").cast("long"))
)
query("genes_in_region", v.sql("SELECT gene, st, en FROM v_gene WHERE chrom = 3 AND st <= 60000 AND en >= 20000", v.GENES))(lambda spark, d: v.genes(spark, d).where("chrom = 3 and st <= 60000 and en >= 20000").select("gene", "st", "en"))
query("promoters", v.sql("SELECT gene, chrom, greatest(CASE WHEN strand = '+' THEN st - 2000 ELSE en - 200 END, 1) AS p_start, CASE WHEN strand = '+' THEN st + 200 ELSE en + 2000 END AS p_end FROM v_gene", v.GENES))(lambda spark, d: A.promoters(v.genes(spark, d)))
query("introns", v.sql("SELECT tx, en + 1 AS i_start, nx - 1 AS i_end FROM (SELECT tx, en, lead(st) OVER (PARTITION BY tx ORDER BY st, en) AS nx FROM v_exon) WHERE nx > en + 1", v.EXONS))(lambda spark, d: A.introns(v.exons(spark, d)))
query("splice_sites", v.sql("SELECT i_start AS site FROM i UNION SELECT i_end FROM i", v.EXONS, "i AS (SELECT en + 1 AS i_start, nx - 1 AS i_end FROM (SELECT tx, en, lead(st) OVER (PARTITION BY tx ORDER BY st, en) AS nx FROM v_exon) WHERE nx > en + 1)"))(lambda spark, d: A.splice_sites(A.introns(v.exons(spark, d))))


@query("gene_models", v.sql("SELECT o_orderkey AS gene, count(tx) AS n_parts, CAST(coalesce(sum(en - st + 1) FILTER (type = 'CDS'), 0) AS BIGINT) AS cds_length FROM orders LEFT JOIN v_exon ON tx = o_orderkey GROUP BY 1", v.EXONS))
def gene_models(spark, d) -> DataFrame:
    g = v.genes(spark, d).select("gene")
    m = A.gene_models(g, g.select("gene", F.col("gene").alias("tx")), v.exons(spark, d))
    parts = F.coalesce(F.flatten(F.transform("transcripts", lambda t: F.coalesce(t["parts"], F.array()))), F.array())
    cds = F.aggregate(F.filter(parts, lambda x: x["type"] == "CDS"), F.lit(0).cast("long"), lambda a, x: a + x["en"] - x["st"] + 1)
    return m.select("gene", F.size(parts).cast("long").alias("n_parts"), cds.alias("cds_length"))


@query("feature_types", v.sql("SELECT p.id, coalesce(min(CASE e.type WHEN 'CDS' THEN '1CDS' WHEN 'exon' THEN '2exon' WHEN 'five_prime_UTR' THEN '3UTR' END)[2:], 'intron') AS feature FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS tx, l_orderkey * 1000 + l_partkey % 800 AS pos FROM lineitem) p LEFT JOIN v_exon e ON e.tx = p.tx AND p.pos BETWEEN e.st AND e.en GROUP BY p.id", v.EXONS))
def feature_types(spark, d) -> DataFrame:
    line = v.table(spark, d, "lineitem")
    points = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("tx"), (F.col("l_orderkey") * 1000 + F.col("l_partkey") % 800).alias("pos"))
    return A.feature_at(points, v.exons(spark, d)).groupBy("id").agg(F.min("feature").alias("feature"))


# Expression

query("tpm", v.sql("SELECT gene, sample, round(coalesce(rpk * 1e6 / sum(rpk) OVER (PARTITION BY sample), 0), 4) AS tpm FROM (SELECT *, coalesce(value * 1000.0 / nullif(length, 0), 0) AS rpk FROM v_expr)", v.EXPRESSION))(lambda spark, d: E.tpm(v.expression(spark, d)).withColumn("tpm", F.round("tpm", 4)))
query("fpkm", v.sql("SELECT gene, sample, round(coalesce(value * 1e9 / nullif(length * sum(value) OVER (PARTITION BY sample), 0), 0), 4) AS fpkm FROM v_expr", v.EXPRESSION))(lambda spark, d: E.fpkm(v.expression(spark, d)).withColumn("fpkm", F.round("fpkm", 4)))
query("log2_expression", v.sql("SELECT gene, sample, round(log2(value + 1.0), 6) AS value FROM v_expr", v.EXPRESSION))(lambda spark, d: v.expression(spark, d).select("gene", "sample", r6(E.log2_transform(F.col("value"))).alias("value")))
query("size_factors", v.sql("SELECT sample, round(ratio, 6) AS factor FROM (SELECT sample, ratio, row_number() OVER (PARTITION BY sample ORDER BY ratio) AS r, count(*) OVER (PARTITION BY sample) AS n FROM (SELECT sample, value / exp(avg(ln(value)) OVER (PARTITION BY gene)) AS ratio FROM v_expr WHERE value > 0)) WHERE r = n // 2 + 1", v.EXPRESSION))(lambda spark, d: E.size_factors(v.expression(spark, d)).withColumn("factor", r6("factor")))
query("quantile_normalise", v.sql("SELECT r.gene, r.sample, round(m.mean, 6) AS value FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value DESC) AS rk FROM v_expr) r JOIN (SELECT place, avg(value) AS mean FROM (SELECT value, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS place FROM v_expr) GROUP BY place) m ON m.place = r.rk", v.EXPRESSION))(lambda spark, d: E.quantile_normalise(v.expression(spark, d)).withColumn("value", r6("value")))

WELCH = """v_w AS (SELECT *, v1 / n1 AS s1, v2 / n2 AS s2 FROM (SELECT gene, count(*) FILTER (sample < 5) AS n1, count(*) FILTER (sample >= 5) AS n2, avg(value) FILTER (sample < 5) AS m1, avg(value) FILTER (sample >= 5) AS m2,
    var_samp(value) FILTER (sample < 5) AS v1, var_samp(value) FILTER (sample >= 5) AS v2 FROM v_expr GROUP BY gene))"""


def welch(spark, d) -> DataFrame:
    return E.welch(v.expression(spark, d), F.col("sample") < 5)


query("differential_expression", v.sql("SELECT gene, n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round(log2((coalesce(m1, 0) + 1) / (coalesce(m2, 0) + 1)), 6) AS lfc, round(CASE WHEN n1 > 1 AND n2 > 1 AND s1 + s2 > 0 THEN (m1 - m2) / sqrt(s1 + s2) ELSE 0 END, 6) AS t, round(CASE WHEN n1 > 1 AND n2 > 1 AND s1 + s2 > 0 THEN (s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) END, 5) AS df FROM v_w", v.EXPRESSION, WELCH))(
    lambda spark, d: welch(spark, d).select("gene", "n1", "n2", *(r6(c).alias(c) for c in ("m1", "m2", "lfc", "t")), F.round("df", 5).alias("df"))
)
query("differential_expression_p", None)(lambda spark, d: E.benjamini_hochberg(E.t_p_values(welch(spark, d).select("gene", "t", "df"))))
query("bh_adjust", v.sql("SELECT gene, round(least(p * count(*) OVER () / row_number() OVER (ORDER BY p, gene), 1.0), 6) AS padj FROM (SELECT gene, max(value) * 37 % 1009 / 1009.0 AS p FROM v_expr GROUP BY gene)", v.EXPRESSION))(
    lambda spark, d: E.benjamini_hochberg(v.expression(spark, d).groupBy("gene").agg((F.max("value") * 37 % 1009 / 1009.0).alias("p"))).select("gene", r6("padj").alias("padj"))
)
query("coexpressed_with", v.sql("SELECT b.gene, count(*) AS n, round(coalesce(CASE WHEN isnan(corr(a.value, b.value)) THEN 0 ELSE corr(a.value, b.value) END, 0), 6) AS r FROM v_expr a JOIN v_expr b USING (sample) WHERE a.gene = 1 AND b.gene <> 1 GROUP BY b.gene HAVING count(*) >= 3", v.EXPRESSION))(lambda spark, d: E.correlated_with(v.expression(spark, d), 1).withColumn("r", r6("r")))
query("coexpression_edges", v.sql("SELECT a, b, n, round(r, 6) AS r FROM (SELECT a.gene AS a, b.gene AS b, count(*) AS n, corr(a.value, b.value) AS r FROM v_expr a JOIN v_expr b ON a.sample = b.sample AND a.gene < b.gene GROUP BY 1, 2 HAVING count(*) >= 8) WHERE abs(r) >= 0.95", v.EXPRESSION))(
    lambda spark, d: E.edges(v.expression(spark, d), 0.95, 8).withColumn("r", r6("r"))
)
query("tissue_tau", v.sql("SELECT gene, round(tau, 6) AS tau, CASE WHEN tau >= 0.85 THEN 'Highly tissue-specific' WHEN tau >= 0.65 THEN 'Tissue-enhanced' WHEN tau >= 0.35 THEN 'Mixed/tissue-preferred' ELSE 'Housekeeping / broadly expressed' END AS pattern FROM (SELECT gene, CASE WHEN max(value) > 0 AND count(*) > 1 THEN (count(*) - CAST(sum(value) AS DOUBLE) / max(value)) / (count(*) - 1) ELSE 0 END AS tau FROM v_expr GROUP BY gene)", v.EXPRESSION))(
    lambda spark, d: E.tau(v.expression(spark, d)).withColumn("tau", r6("tau"))
)


# Population statistics: the 50 letters of the alignment are the first letters of words in part names, all of one length.

query("pairwise_distance", v.sql("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(coalesce(CAST(len(list_filter(range(1, least(length(a.n_name), length(b.n_name)) + 1), lambda i: substr(a.n_name, CAST(i AS INTEGER), 1) <> substr(b.n_name, CAST(i AS INTEGER), 1))) AS DOUBLE) / nullif(least(length(a.n_name), length(b.n_name)), 0), 1), 6) AS p FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"))(
    lambda spark, d: v.table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).join(v.table(spark, d, "nation").select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y")), F.col("a") < F.col("b")).select("a", "b", r6(G.p_distance(F.col("x"), F.col("y"))).alias("p"))
)


def keys_as_dna(spark, d) -> DataFrame:
    """Order keys in base 4 as aligned sequences of 12 bases, in two populations."""
    o = v.table(spark, d, "orders")
    letter = lambda i: F.substring(F.lit("ACGT"), (F.floor(F.col("o_orderkey") * 2654435761 % 4294967296 / F.lit(4**i)) % 4 + 1).cast("int"), F.lit(1))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(*(letter(i) for i in range(2, 14))).alias("s"), (F.col("o_custkey") % 2).cast("int").alias("pop"))


KEYS = "v_key AS (SELECT o_orderkey AS id, " + " || ".join(f"substr('ACGT', CAST(o_orderkey * 2654435761 % 4294967296 // {4**i} % 4 + 1 AS INTEGER), 1)" for i in range(2, 14)) + " AS s, CAST(o_custkey % 2 AS INTEGER) AS pop FROM orders)"
COLS = "v_col AS (SELECT id, pop, c, substr(s, CAST(c + 1 AS INTEGER), 1) AS base FROM v_key, range(12) t(c))"

query("consensus", v.sql("SELECT CAST(c AS INTEGER) AS col, CASE WHEN n / tot >= 0.2 THEN base ELSE 'X' END AS base, round(n / tot, 6) AS share FROM (SELECT c, base, n, sum(n) OVER (PARTITION BY c) AS tot, row_number() OVER (PARTITION BY c ORDER BY n DESC, base) AS r FROM (SELECT c, base, count(*) AS n FROM v_col GROUP BY 1, 2)) WHERE r = 1", KEYS, COLS))(lambda spark, d: G.consensus(keys_as_dna(spark, d), 0.2).withColumn("share", r6("share")))
query("fst_columns", v.sql("SELECT round(avg(ht), 6) AS ht, round(avg(hs), 6) AS hs, round((avg(ht) - avg(hs)) / avg(ht), 6) AS fst FROM (SELECT c, 1 - sum(pow(n / tot, 2)) AS ht FROM (SELECT c, base, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY c) AS tot FROM v_col GROUP BY 1, 2) GROUP BY c) JOIN (SELECT c, avg(h) AS hs FROM (SELECT c, pop, 1 - sum(pow(n / tot, 2)) AS h FROM (SELECT c, pop, base, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY c, pop) AS tot FROM v_col GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY c) USING (c)", KEYS, COLS))(
    lambda spark, d: G.fst(keys_as_dna(spark, d)).select(*(r6(c).alias(c) for c in ("ht", "hs", "fst")))
)


# DNA and RNA interactions


# Fingerprint similarity

query("tanimoto_screen", v.sql("SELECT q.vec_id AS query, f.vec_id, round(CAST(len(list_intersect(f.bits, q.bits)) AS DOUBLE) / (len(f.bits) + len(q.bits) - len(list_intersect(f.bits, q.bits))), 6) AS tanimoto, round(2.0 * len(list_intersect(f.bits, q.bits)) / (len(f.bits) + len(q.bits)), 6) AS dice, round(len(list_intersect(f.bits, q.bits)) / sqrt(CAST(len(f.bits) * len(q.bits) AS DOUBLE)), 6) AS cosine FROM v_fp f, v_fp q WHERE q.vec_id % 50 = 0 AND CAST(len(list_intersect(f.bits, q.bits)) AS DOUBLE) / (len(f.bits) + len(q.bits) - len(list_intersect(f.bits, q.bits))) >= 0.4", v.BITS))(
    lambda spark, d: _screen(v.bits(spark, d))
)


def _screen(fp: DataFrame) -> DataFrame:
    """Rows like those whose id is divisible by 50, found in blocks; the other two measures of the pairs found."""
    from strandwork.operators.similarity import cosine, dice, screen

    ids = fp.withColumnRenamed("vec_id", "id")
    hits = screen(ids.where("id % 50 = 0"), ids, 0.4).join(ids.withColumnRenamed("bits", "b"), "id").join(ids.select(F.col("id").alias("query"), F.col("bits").alias("q")), "query")
    return hits.select("query", F.col("id").alias("vec_id"), r6("tanimoto").alias("tanimoto"), r6(dice(F.col("b"), F.col("q"))).alias("dice"), r6(cosine(F.col("b"), F.col("q"))).alias("cosine"))


# Alignment, trees, folding

def nation_pairs(spark, d) -> DataFrame:
    n = v.table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")).join(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y")), F.col("a") < F.col("b"))


def _aligned(mode: str):
    from strandwork.operators.alignment import align_column

    def run(spark, d) -> DataFrame:
        return nation_pairs(spark, d).select("a", "b", align_column(F.col("x"), F.col("y"), mode=mode).alias("al")).select("a", "b", "al.*")

    return run


for _mode in ("global", "local", "semiglobal"):
    query(f"align_{_mode}")(_aligned(_mode))


@query("upgma_tree")
def upgma_tree(spark, d) -> DataFrame:
    from strandwork.operators.phylogeny import trees

    p = nation_pairs(spark, d).select(F.lit(0).alias("tree"), "a", "b", G.p_distance(F.col("x"), F.col("y")).alias("d"))
    return trees(p, "tree")


@query("neighbour_joining_tree")
def neighbour_joining_tree(spark, d) -> DataFrame:
    from strandwork.operators.phylogeny import neighbour_joining, trees

    p = nation_pairs(spark, d).select(F.lit(0).alias("tree"), "a", "b", G.p_distance(F.col("x"), F.col("y")).alias("d"))
    return trees(p, "tree", neighbour_joining)


@query("rna_fold")
def rna_fold(spark, d) -> DataFrame:
    from strandwork.operators.alignment import fold_column

    return keys_as_dna(spark, d).select("id", fold_column(S.transcribe(F.col("s"))).alias("f")).select("id", "f.*")


@query("kmer_seed_hits", v.sql("SELECT a.id AS query, b.id AS subject, count(*) AS seeds FROM (SELECT DISTINCT id, substr(s, CAST(p + 1 AS INTEGER), 11) AS kmer FROM v_key, range(2) t(p)) a JOIN (SELECT DISTINCT id, substr(s, CAST(p + 1 AS INTEGER), 11) AS kmer FROM v_key, range(2) t(p)) b USING (kmer) GROUP BY 1, 2", KEYS))
def kmer_seed_hits(spark, d) -> DataFrame:
    from strandwork.operators.alignment import seed_hits

    k = keys_as_dna(spark, d).select("id", "s")
    return seed_hits(k, k, 11)


# Models

def _nb_sql(features: list[str], classes: dict) -> tuple[str, list[str]]:
    import math

    parts = []
    for prior, means, variances in classes.values():
        terms = " ".join(f"- {0.5 * math.log(2 * math.pi * x)!r}::DOUBLE - ({f} - {m}) * ({f} - {m}) / {2 * x!r}::DOUBLE" for f, m, x in zip(features, means, variances))
        parts.append(f"({math.log(prior + 1e-10)!r}::DOUBLE {terms})")
    return parts, list(classes)


def _promoter_sql() -> str:
    from strandwork.operators.models import BUILT_IN

    (a, b), _ = _nb_sql(["f1", "f2", "f3", "f4", "f5"], BUILT_IN["promoter"][1])
    return f"""SELECT doc_id, CASE WHEN a >= b THEN 'promoter' ELSE 'non-promoter' END AS label, round(1 / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS confidence FROM (SELECT doc_id, {a} AS a, {b} AS b FROM (
        SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE {n_of('GC')} / CAST(length(s) AS DOUBLE) END AS f1, coalesce(((length(s) - length(replace(s, 'CG', ''))) / 2.0) / nullif(length(s) - 1, 0), 0) AS f2,
            CASE WHEN regexp_matches(s, 'TATAAAA|TATAAAT|TATAAAG|TATAATG') THEN 1.0 WHEN contains(s, 'TATAA') THEN 0.5 WHEN contains(s, 'TATA') THEN 0.2 ELSE 0 END AS f3,
            CASE WHEN contains(s, 'GGGCGG') THEN 1.0 WHEN contains(s, 'GGCGG') THEN 0.6 WHEN {n_of('GC')} > 0.65 * length(s) AND s <> '' THEN 0.3 ELSE 0 END AS f4, CASE WHEN contains(s, 'CAAT') THEN 0.8 ELSE 0 END AS f5 FROM v_dna))"""


@query("nb_promoter", v.sql(_promoter_sql(), v.DNA))
def nb_promoter(spark, d) -> DataFrame:
    from strandwork.operators.predictors import predict

    return v.dna(spark, d).select("doc_id", predict("promoter", F.col("s")).alias("x")).select("doc_id", "x.label", r6("x.confidence").alias("confidence"))


# Motif table functions

def _seqs(spark, d) -> DataFrame:
    return v.dna(spark, d).select(F.col("doc_id").alias("id"), "s")


@query("microsatellite_summary")
def microsatellite_summary(spark, d) -> DataFrame:
    """Counts by kind and motif with totals, as grouping sets."""
    from strandwork.operators.motifs import microsatellites as find

    return find(_seqs(spark, d)).withColumn("length", F.col("end") - F.col("start") + 1).rollup("kind", "motif").agg(F.count(F.lit(1)).alias("n"), F.avg("repeats").alias("avg_repeats"), F.sum("length").alias("total_length"))


@query("te_classes")
def te_classes(spark, d) -> DataFrame:
    from strandwork.operators.motifs import te_classes as classify

    return classify(_seqs(spark, d).withColumn("name", F.concat(F.lit("seq"), F.col("id").cast("string"))))


@query("primer_candidates")
def primer_candidates(spark, d) -> DataFrame:
    from strandwork.operators.motifs import primers

    return primers(_seqs(spark, d).withColumn("target_start", F.floor(F.length("s") / 3).cast("int")).withColumn("target_end", F.floor(2 * F.length("s") / 3).cast("int")))


from strandwork.plans import catalog_genome, catalog_molecule, catalog_protein, catalog_sequence  # noqa: E402, F401  (they register their queries)
