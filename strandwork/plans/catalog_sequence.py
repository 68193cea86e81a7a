"""Further queries of sequences: enzymes, repeats, motifs, reading frames, interactions, search and report figures, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions import sequence as S
from strandwork.functions import tables as T
from strandwork.operators import expression as E
from strandwork.operators import popgen as G
from strandwork.operators.motifs import _regex
from strandwork.plans import views as v
from strandwork.plans.catalog import COLS, CODON_COUNT, KEYS, WELCH, _complexity_sql, _kmer_sql, keys_as_dna, n_of, query, r6, welch

POSITIONS = "v_pos AS (SELECT doc_id, p, s FROM (SELECT doc_id, s, unnest(range(0, length(s))) AS p FROM v_dna))"
_SITES = {k: [(e, x, c) for e, (x, c) in T.ENZYMES.items() if len(x) == k] for k in sorted({len(x) for x, _ in T.ENZYMES.values()})}
query("restriction_digest", v.sql(" UNION ALL ".join(f"SELECT enzyme, doc_id, p AS pos, p + cut AS cut FROM ({_kmer_sql(k).replace('AS kmer', 'AS kmer, p')}) JOIN (VALUES {', '.join(f'({e!r}, {x!r}, {c})' for e, x, c in sites)}) t(enzyme, site, cut) ON kmer = site" for k, sites in _SITES.items()), v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.digest(F.col("s"))).alias("x")).select("x.enzyme", "doc_id", "x.pos", "x.cut")
)

# Tandem repeats as runs of places whose base equals the one k further on: a run of at least (m - 1) k such places holds m repeats.
_RUNS = "SELECT doc_id, {k} AS k, min(p) AS a, count(*) AS n FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM v_pos WHERE p + {k} < length(s) AND substr(s, CAST(p + 1 AS INTEGER), 1) = substr(s, CAST(p + {k} + 1 AS INTEGER), 1)) GROUP BY doc_id, island HAVING count(*) >= {least}"
# A match ends after whole repeats, up to k - 1 places into the next run; what is left of that run counts from there.
RUNS = "v_raw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY a) AS rn, CASE k " + " ".join(f"WHEN {k} THEN {(m - 1) * k}" for k, m in T.SSR_LEAST.items()) + " END AS least FROM (" + " UNION ALL ".join(_RUNS.format(k=k, least=(m - 1) * k) for k, m in T.SSR_LEAST.items()) + "))"
WALK = "v_walk(doc_id, k, rn, a, n, e, fine) AS (SELECT doc_id, k, rn, a, n, a + (n // k + 1) * k, TRUE FROM v_raw WHERE rn = 1 UNION ALL SELECT doc_id, k, rn, b, m, CASE WHEN m >= least THEN b + (m // k + 1) * k ELSE e END, m >= least FROM (SELECT r.doc_id, r.k, r.rn, r.least, w.e, greatest(r.a, w.e) AS b, r.n - greatest(w.e - r.a, 0) AS m FROM v_walk w JOIN v_raw r ON r.doc_id = w.doc_id AND r.k = w.k AND r.rn = w.rn + 1))"
query("microsatellites", v.sql("SELECT doc_id AS id, a + 1 AS start, a + (n // r.k + 1) * r.k AS \"end\", substr(s, CAST(a + 1 AS INTEGER), CAST(r.k AS INTEGER)) AS motif, CAST(n // r.k + 1 AS INTEGER) AS repeats, CASE r.k WHEN 1 THEN 'mono' WHEN 2 THEN 'di' WHEN 3 THEN 'tri' WHEN 4 THEN 'tetra' WHEN 5 THEN 'penta' ELSE 'hexa' END AS kind FROM v_walk r JOIN v_dna USING (doc_id) WHERE fine", v.DNA, POSITIONS, RUNS, WALK).replace("WITH ", "WITH RECURSIVE ", 1))(
    lambda spark, d: _found(spark, d)
)


def _found(spark, d) -> DataFrame:
    from strandwork.operators.motifs import microsatellites as find

    return find(v.dna(spark, d).select(F.col("doc_id").alias("id"), "s"))


_CIS = [(e, m, _regex(m)) for e, ms in T.CIS_MOTIFS.items() for m in ms.split("|")]


@query("cis_elements", v.sql("SELECT element, motif, strand, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS docs FROM (" + " UNION ALL ".join(f"SELECT {e!r} AS element, {m!r} AS motif, strand, len(regexp_extract_all(x, {r!r})) AS n FROM v_both" for e, m, r in _CIS) + ") GROUP BY 1, 2, 3 HAVING sum(n) > 0", v.DNA, "v_both AS (SELECT doc_id, '+' AS strand, s AS x FROM v_dna UNION ALL SELECT doc_id, '-', reverse(translate(s, 'ATGC', 'TACG')) FROM v_dna)"))
def cis_elements(spark, d) -> DataFrame:
    from strandwork.operators.motifs import cis_elements as find

    hits = find(v.dna(spark, d).select(F.col("doc_id").alias("id"), "s"))
    per = hits.groupBy("element", "motif", "strand", "id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("element", "motif", "strand").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


query("linguistic_complexity", v.sql(f"SELECT doc_id, round({_complexity_sql('s', 3)}, 6) AS complexity FROM v_dna", v.DNA))(lambda spark, d: v.dna(spark, d).select("doc_id", r6(S.linguistic_complexity(F.col("s"), 3)).alias("complexity")))
query("orf_proteins", v.sql("""SELECT doc_id, frame, start, stop + 3 AS "end", (stop - start) // 3 AS length FROM (
    SELECT doc_id, frame, start, codon, min(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN start END) OVER (PARTITION BY doc_id, frame ORDER BY start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM (
        SELECT doc_id, CAST(p % 3 + 1 AS INTEGER) AS frame, p AS start, substr(s, CAST(p + 1 AS INTEGER), 3) AS codon FROM v_pos WHERE p + 3 <= length(s)))
    WHERE codon = 'ATG' AND stop IS NOT NULL AND stop + 3 - start >= 100""", v.DNA, POSITIONS))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.orfs(F.col("s"), 100)).alias("x")).select("doc_id", "x.frame", "x.start", "x.end", F.length("x.protein").cast("long").alias("length"))
)
query("rna_strands", v.sql("SELECT doc_id, translate(replace(s, 'T', 'U'), 'AUGC', 'UACG') AS complement, reverse(translate(replace(s, 'T', 'U'), 'AUGC', 'UACG')) AS rc FROM v_dna", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", S.complement(S.transcribe(F.col("s")), True).alias("complement"), S.reverse_complement(S.transcribe(F.col("s")), True).alias("rc"))
)
query("rna_translation", v.sql("SELECT d.doc_id, coalesce(string_split(string_agg(aa, '' ORDER BY i), '*')[1], '') AS protein FROM v_dna d LEFT JOIN (SELECT doc_id, unnest(range(0, length(s) // 3)) AS i FROM v_dna) USING (doc_id) LEFT JOIN v_codon ON codon = substr(s, CAST(i * 3 + 1 AS INTEGER), 3) GROUP BY d.doc_id", v.DNA, v.CODONS))(
    lambda spark, d: v.dna(spark, d).select("doc_id", S.translate_rna(S.transcribe(F.col("s"))).alias("protein"))
)
query("first_start_translation", v.sql("SELECT doc_id, instr(s, 'ATG') AS at FROM v_dna WHERE contains(s, 'ATG')", v.DNA))(
    lambda spark, d: v.dna(spark, d).withColumn("p", S.translate_from_start(F.col("s"))).where(F.col("p").startswith("M") & F.col("p").isNotNull()).select("doc_id", F.instr("s", "ATG").cast("long").alias("at"))
)
query("codon_roles", v.sql("SELECT codon, n, codon = 'ATG' AS start, codon IN ('TAA', 'TAG', 'TGA') AS stop, codon IN ('TAA', 'TAG', 'AGA', 'AGG') AS mitochondrial_stop FROM v_cc", v.DNA, CODON_COUNT))(
    lambda spark, d: v.dna(spark, d).select(F.explode(S.codons(F.col("s"))).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n")).select("codon", "n", S.is_start(F.col("codon")).alias("start"), S.is_stop(F.col("codon")).alias("stop"), S.is_stop(F.col("codon"), 2).alias("mitochondrial_stop"))
)
query("sequence_slices", v.sql("SELECT doc_id, substr(s, 11, 20) AS part, length(s) AS n FROM v_dna", v.DNA))(lambda spark, d: v.dna(spark, d).select("doc_id", S.at(F.col("s"), F.lit(10), 20).alias("part"), F.length("s").cast("long").alias("n")))
_CODES = " ".join(f"WHEN '{''.join(sorted(b))}' THEN '{k}'" for k, b in T.IUPAC.items())
query("ambiguity_codes", v.sql(f"SELECT doc_id, CASE k WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' {_CODES} ELSE 'N' END AS code FROM (SELECT doc_id, list_aggregate(list_sort(list_distinct(string_split(substr(s, 1, 3), ''))), 'string_agg', '') AS k FROM v_dna WHERE length(s) >= 3)", v.DNA))(
    lambda spark, d: v.dna(spark, d).where("length(s) >= 3").select("doc_id", S.ambiguity_code(F.filter(F.split(F.substring("s", 1, 3), ""), lambda c: c != "")).alias("code"))
)
query("expanded_ambiguity", v.sql("SELECT doc_id, unnest(CASE k WHEN 0 THEN ['A' || x, 'G' || x] WHEN 1 THEN ['C' || x, 'T' || x] ELSE ['A' || x, 'T' || x, 'G' || x, 'C' || x] END) AS sequence FROM (SELECT doc_id, doc_id % 3 AS k, substr(s, 1, 4) AS x FROM v_dna)", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.expand_ambiguous(F.concat(F.element_at(F.array(F.lit("R"), F.lit("Y"), F.lit("N")), (F.col("doc_id") % 3 + 1).cast("int")), F.substring("s", 1, 4)))).alias("sequence"))
)

# Population statistics and interactions of the order keys as DNA

N_SEQ = "v_n AS (SELECT count(*) AS n FROM v_key)"
TAJIMA = "v_taj AS (SELECT count(*) FILTER (kinds > 1) AS s, sum((n * n - sq) / 2.0) AS diff, max(n) AS n FROM (SELECT c, count(*) AS kinds, sum(k * k) AS sq, sum(k) AS n FROM (SELECT c, base, count(*) AS k FROM v_col GROUP BY 1, 2) GROUP BY c)), v_a AS (SELECT CAST(s AS DOUBLE) AS s, CAST(n AS DOUBLE) AS n, 2.0 * diff / (CAST(n AS DOUBLE) * (n - 1)) AS k, (SELECT sum(1.0::DOUBLE / i) FROM (SELECT unnest(range(1, CAST(n AS BIGINT))) AS i)) AS a1, (SELECT sum(1.0::DOUBLE / i / i) FROM (SELECT unnest(range(1, CAST(n AS BIGINT))) AS i)) AS a2 FROM v_taj)"
query("tajimas_d", v.sql("SELECT CAST(s AS BIGINT) AS segregating, round(k / 12, 6) AS pi, round(s / a1 / 12, 6) AS theta, round((k - s / a1) / sqrt(c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1)), 4) AS tajima_d FROM (SELECT *, (n + 1) / (3 * (n - 1)) - 1 / a1 AS c1, 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1) AS c2 FROM v_a)", KEYS, COLS, TAJIMA))(
    lambda spark, d: G.tajimas_d(keys_as_dna(spark, d)).select("segregating", r6("pi").alias("pi"), r6("theta").alias("theta"), F.round("tajima_d", 4).alias("tajima_d"))
)
DNDS = "v_two AS (SELECT a.id // 2 AS g, a.s AS a, b.s AS b FROM v_key a JOIN v_key b ON a.id // 2 = b.id // 2 AND a.pop = 0 AND b.pop = 1), v_dnds AS (SELECT g, count(*) AS n, count(*) FILTER (x <> y AND p = q) AS same, count(*) FILTER (x <> y AND p <> q) AS other FROM (SELECT g, substr(a, CAST(i * 3 + 1 AS INTEGER), 3) AS x, substr(b, CAST(i * 3 + 1 AS INTEGER), 3) AS y FROM v_two, range(4) t(i)) JOIN (SELECT codon AS x, aa AS p FROM v_codon) USING (x) JOIN (SELECT codon AS y, aa AS q FROM v_codon) USING (y) GROUP BY g)"
query("dn_ds", v.sql("SELECT g, round(CASE WHEN ka >= 0.75 THEN 99.0 ELSE -0.75 * ln(1 - 4 * least(ka, 0.7499999) / 3) END, 6) AS ka, round(CASE WHEN ks >= 0.75 THEN 99.0 ELSE -0.75 * ln(1 - 4 * least(ks, 0.7499999) / 3) END, 6) AS ks FROM (SELECT g, other * 1.5::DOUBLE / n AS ka, same * 3.0::DOUBLE / n AS ks FROM v_dnds)", KEYS, v.CODONS, DNDS))(lambda spark, d: _dn_ds(spark, d))


def _dn_ds(spark, d) -> DataFrame:
    k = keys_as_dna(spark, d)
    half = lambda pop, name: k.where(F.col("pop") == pop).select(F.floor(F.col("id") / 2).cast("long").alias("g"), F.col("s").alias(name))
    x = half(0, "a").join(half(1, "b"), "g").select("g", G.dn_ds(F.col("a"), F.col("b")).alias("x"))
    known = lambda c: F.round(F.when(F.col(c) > 98, 99.0).otherwise(F.col(c)), 6)
    return x.select("g", known("x.ka").alias("ka"), known("x.ks").alias("ks"))


_STACK = {n: "map {" + ", ".join(f"'{k}': {x!r}::DOUBLE" for k, x in t.items()) + "}" for n, t in (("h", T.STACK_H), ("s", T.STACK_S))}
HYB = f"v_hyb AS (SELECT id, s, list_sum(list_transform(range(1, 12), lambda i: mh[substr(s, CAST(i AS INTEGER), 2)])) + 2 * CASE WHEN substr(s, 1, 1) IN ('G', 'C') THEN 0.1 ELSE 2.3 END AS dh, list_sum(list_transform(range(1, 12), lambda i: ms[substr(s, CAST(i AS INTEGER), 2)])) + 2 * CASE WHEN substr(s, 1, 1) IN ('G', 'C') THEN -2.8 ELSE 4.1 END + 0.368 * 11 * ln(0.05) AS ds FROM v_key, (SELECT {_STACK['h']} AS mh, {_STACK['s']} AS ms))"
query("hybridize", v.sql("SELECT id, round(dh, 6) AS dh, round(ds, 6) AS ds, round(dh - 310.15 * ds / 1000, 6) AS dg37, round(dh * 1000 / (ds + 1.987 * ln(250e-9)) - 273.15, 4) AS tm, CAST(0 AS BIGINT) AS mismatches FROM v_hyb", KEYS, HYB))(
    lambda spark, d: keys_as_dna(spark, d).select("id", S.hybridize(F.col("s"), S.reverse_complement(F.col("s"))).alias("x")).select("id", *(r6(f"x.{c}").alias(c) for c in ("dh", "ds", "dg37")), F.round("x.tm", 4).alias("tm"), "x.mismatches")
)
query("binding_affinity", v.sql("SELECT id, round(dh - 310.15 * ds / 1000 - 3.5, 6) AS circular FROM v_hyb", KEYS, HYB))(lambda spark, d: keys_as_dna(spark, d).select("id", r6(S.binding_affinity(F.col("s"), S.reverse_complement(F.col("s")), True)).alias("circular")))
query("fret_efficiency", v.sql("SELECT l_orderkey * 10 + l_linenumber AS id, round(1 / (1 + pow(l_quantity / 25.0, 6)), 6) AS efficiency FROM lineitem"))(
    lambda spark, d: v.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), r6(S.fret_efficiency(F.col("l_quantity"), F.lit(25.0))).alias("efficiency"))
)
MIRNA = "UGAGGUAGUAGGUUGUAUAGUU"
_SEED = MIRNA[1:8].translate(str.maketrans(*T.RNA_COMPLEMENT))
_HITS = " + ".join(f"CAST(substr(w, {i + 1}, 1) = '{c}' AS INTEGER)" for i, c in enumerate(_SEED))
query("mirna_targets", v.sql(f"SELECT doc_id, p AS pos, CAST(n AS BIGINT) AS matches, CASE WHEN n = 7 AND w LIKE 'A%' THEN '7mer-A1' WHEN n = 7 THEN '7mer-m8' ELSE '6mer' END AS site FROM (SELECT doc_id, p, w, {_HITS} AS n FROM (SELECT doc_id, p, substr(replace(s, 'T', 'U'), CAST(p + 1 AS INTEGER), 8) AS w FROM v_pos WHERE p + 8 <= length(s))) WHERE n >= 6", v.DNA, POSITIONS))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.mirna_sites(F.lit(MIRNA), F.col("s"))).alias("x")).select("doc_id", "x.*")
)
_BONUS = " + ".join(f"CASE WHEN substr(g, {p}, 1) = 'G' THEN {b} ELSE 0 END" for p, b in {1: 0.1, 2: 0.1, 18: 0.15, 19: 0.2, 20: 0.2}.items())
query("crispr_efficiency", v.sql(f"SELECT id, round(CAST(greatest(0, least(1, CASE WHEN gc BETWEEN 40 AND 70 THEN 1.0 ELSE 0.5 END * (1 + {_BONUS}))) AS DOUBLE), 6) AS efficiency FROM (SELECT id, g, (length(g) - length(translate(g, 'GC', ''))) * 5.0 AS gc FROM (SELECT id, s || substr(s, 1, 8) AS g FROM v_key))", KEYS))(
    lambda spark, d: keys_as_dna(spark, d).select("id", r6(S.crispr_efficiency(F.concat(F.col("s"), F.substring(F.col("s"), 1, 8)), F.concat(F.col("s"), F.substring(F.col("s"), 1, 8), F.lit("TGG")))).alias("efficiency"))
)


@query("rna_interactions")
def rna_interactions(spark, d) -> DataFrame:
    """Energies of RNA pairs, kissing loops, stems and R-loops of the order keys as sequences."""
    from strandwork.operators import alignment as L

    dealt = keys_as_dna(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # a small file is one task, and a row costs far more than its bytes
    k = dealt.select("id", "s", S.transcribe(F.concat("s", S.reverse_complement(F.col("s")))).alias("r"))
    folded = k.withColumn("f", L.fold_column(F.col("r")))
    return folded.select("id", r6(L.rna_hybridize(F.col("r"), F.col("r"))).alias("energy"), L.kissing_loops(F.col("r"), F.col("r")).alias("kiss"), r6(L.r_loop(F.col("s"), F.col("r"))).alias("r_loop"), F.size(L.stems(F.col("f.structure"))).alias("stems"), F.col("f.pairs").alias("pairs"))


@query("sequence_search", v.sql("SELECT id AS query, id AS subject, round(KAPPA * 12 * 12 * n * exp(-LAMBDA * 24), 6) AS evalue, round((LAMBDA * 24 - ln(KAPPA)) / ln(2), 4) AS bits FROM v_key, (SELECT count(*) AS n FROM v_key) WHERE id % 50 = 0".replace("KAPPA", "0.134::DOUBLE").replace("LAMBDA", "0.318::DOUBLE"), KEYS))
def sequence_search(spark, d) -> DataFrame:
    """Each order key that is divisible by 50 searched among all: the hit of the key itself, with its E-value."""
    from strandwork.operators.alignment import search

    k = keys_as_dna(spark, d).select("id", "s")
    hits = search(k.where("id % 50 = 0"), k, 11, 50, 1e9)
    return hits.where("query = subject").select("query", "subject", r6("evalue").alias("evalue"), F.round("bits", 4).alias("bits"))


# Report figures

query("dna_report_bases", v.sql(f"SELECT doc_id, base, n, round(CASE WHEN len = 0 THEN 0 ELSE n * 100.0 / len END, 6) AS percent, round(CASE WHEN base IN ('G', 'C') THEN gc / 2 ELSE (100 - gc) / 2 END, 6) AS expected FROM (SELECT doc_id, length(s) AS len, unnest(['A', 'T', 'G', 'C']) AS base, unnest([{', '.join(n_of(b) for b in 'ATGC')}]) AS n, CASE WHEN s = '' THEN 0 ELSE {n_of('GC')} * 100.0 / length(s) END AS gc FROM v_dna)", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", F.explode(S.base_report(F.col("s"))).alias("x")).select("doc_id", "x.base", "x.n", r6("x.percent").alias("percent"), r6("x.expected").alias("expected"))
)
query("dna_report_bands", v.sql(f"SELECT doc_id, CASE WHEN gc < 40 THEN 'low' WHEN gc > 60 THEN 'high' ELSE 'fine' END AS gc, CASE WHEN tm < 50 THEN 'low' WHEN tm > 75 THEN 'high' ELSE 'fine' END AS tm FROM (SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE {n_of('GC')} * 100.0 / length(s) END AS gc, CASE WHEN length(s) < 14 THEN 2.0 * {n_of('AT')} + 4.0 * {n_of('GC')} ELSE 64.9 + 41.0 * ({n_of('GC')} - 16.4) / length(s) END AS tm FROM v_dna)", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", S.traffic_lights(F.col("s")).alias("x")).select("doc_id", "x.gc", "x.tm")
)
query("dna_report_dinucleotides", v.sql(f"SELECT kmer AS dinucleotide, count(*) AS n, round((SELECT max(f) FROM v_f WHERE b = substr(kmer, 1, 1)) * (SELECT max(f) FROM v_f WHERE b = substr(kmer, 2, 1)) * 100, 6) AS expected FROM ({_kmer_sql(2)}) GROUP BY kmer", v.DNA, "v_f AS (SELECT b, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS f FROM (SELECT unnest(string_split(s, '')) AS b FROM v_dna WHERE s <> '') GROUP BY b)"))(
    lambda spark, d: _dinucleotides(spark, d)
)


def _dinucleotides(spark, d) -> DataFrame:
    """Counts of neighbouring bases and the percent that the bases alone would give."""
    s = v.dna(spark, d)
    pairs = s.select(F.explode(S.kmers(F.col("s"), 2)).alias("dinucleotide")).groupBy("dinucleotide").agg(F.count(F.lit(1)).alias("n"))
    totals = s.agg(*(F.sum(S.count_of(F.col("s"), b)).alias(b) for b in "ACGT"))
    share = lambda i: F.element_at(F.create_map(*(x for b in "ACGT" for x in (F.lit(b), F.col(b) / (F.col("A") + F.col("C") + F.col("G") + F.col("T"))))), F.substring("dinucleotide", i, 1))
    return pairs.join(F.broadcast(totals)).select("dinucleotide", "n", r6(share(1) * share(2) * 100).alias("expected"))  # totals: one row


query("mean_gc_skew", v.sql("SELECT d.doc_id, round(coalesce(avg(CASE WHEN g + c = 0 THEN 0 ELSE CAST(g - c AS DOUBLE) / (g + c) END), 0), 6) AS skew FROM v_dna d LEFT JOIN (SELECT doc_id, length(x) - length(replace(x, 'G', '')) AS g, length(x) - length(replace(x, 'C', '')) AS c FROM (SELECT doc_id, substr(s, CAST(p + 1 AS INTEGER), CAST(w AS INTEGER)) AS x FROM (SELECT doc_id, s, w, unnest(range(0, n - w + 1, step)) AS p FROM (SELECT doc_id, s, length(s) AS n, least(50, length(s) // 4 + 1) AS w, least(10, length(s) // 10 + 1) AS step FROM v_dna) WHERE n >= w))) x ON x.doc_id = d.doc_id GROUP BY d.doc_id", v.DNA))(
    lambda spark, d: v.dna(spark, d).select("doc_id", r6(S.mean_skew(F.col("s"))).alias("skew"))
)
query("dna_prompts", v.sql(f"SELECT doc_id, 'Length: ' || length(s) || ' bp' || chr(10) || 'Restriction sites: ' || (len(regexp_extract_all(s, 'GAATTC'))) || chr(10) || chr(10) || 'What is it?' AS prompt FROM v_dna", v.DNA))(lambda spark, d: _dna_prompts(spark, d))


def _dna_prompts(spark, d) -> DataFrame:
    from strandwork.operators.prompts import prompt

    s = F.col("s")
    return v.dna(spark, d).select("doc_id", prompt({"Length": F.format_string("%d bp", F.length(s)), "Restriction sites": F.size(S.find_motif(s, "GAATTC")).cast("string")}, "What is it?").alias("prompt"))


@query("dna_predictions")
def dna_predictions(spark, d) -> DataFrame:
    """Coding, promoter and splice classes of the documents as DNA."""
    from strandwork.operators.predictors import confidence_band, full_analysis

    x = v.dna(spark, d).where("length(s) >= 30").select("doc_id", full_analysis("dna", F.col("s")).alias("x"))
    return x.select("doc_id", F.col("x.coding.label").alias("coding"), F.col("x.splice.label").alias("splice"), confidence_band(F.col("x.coding.confidence")).alias("band"))


# Enrichment of gene sets among genes of large t

SETS = "v_set AS (SELECT set, count(*) AS size, count(gene) AS overlap FROM (SELECT CAST(p_partkey % 6 AS VARCHAR) AS set, w.gene FROM part LEFT JOIN (SELECT gene FROM v_w WHERE n1 > 1 AND n2 > 1 AND s1 + s2 > 0 AND abs((m1 - m2) / sqrt(s1 + s2)) >= 2) w ON w.gene = p_partkey) GROUP BY set), v_tot AS (SELECT sum(overlap) AS total FROM v_set)"
_LC = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
query("gene_set_enrichment", v.sql(f"SELECT set, size, overlap, round(overlap / (size * total / 35000.0::DOUBLE), 6) AS ratio, round(least(1.0, sum(exp({_LC('size', 'i')} + {_LC('(35000 - size)', '(total - i)')} - {_LC('35000', 'total')}))), 6) AS p FROM (SELECT *, unnest(range(overlap, CAST(least(size, total) AS BIGINT) + 1)) AS i FROM v_set, v_tot) GROUP BY set, size, overlap, total", v.EXPRESSION, WELCH, SETS))(
    lambda spark, d: E.enrichment(v.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") % 6).cast("string").alias("set")), welch(spark, d).where(F.abs("t") >= 2), 35000).select("set", "size", "overlap", r6("ratio").alias("ratio"), r6("p").alias("p"))
)
