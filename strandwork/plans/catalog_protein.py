"""Queries of protein descriptors, predictions and interactions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions import descriptors as D
from strandwork.functions import protein as P
from strandwork.functions import tables as T
from strandwork.plans import views as v
from strandwork.plans.catalog import ALL20, aa_total, charge_sql, n_of, query, r6

MAPS = {n: "map {" + ", ".join(f"'{k}': {x!r}::DOUBLE" for k, x in t.items()) + "}" for n, t in {"helix": T.HELIX, "face": T.INTERFACE}.items()}
RESIDUES_SQL = "v_res AS (SELECT doc_id, p, substr(s, CAST(p + 1 AS INTEGER), 1) AS aa, n FROM (SELECT doc_id, s, length(s) AS n, unnest(range(0, length(s))) AS p FROM v_prot WHERE length(s) > 4))"


def long_enough(spark, d) -> DataFrame:
    return v.protein(spark, d).where("length(s) > 4")


# Isoelectric point: the same bisection, a recursion of 100 steps.
PI = f"""v_n AS (SELECT doc_id, {', '.join(f"{n_of(a)} AS n_{a}" for a in T.PKA)} FROM v_prot),
    v_bis(doc_id, lo, hi, k) AS (SELECT doc_id, 0.0::DOUBLE, 14.0::DOUBLE, 0 FROM v_n UNION ALL SELECT doc_id, CASE WHEN c > 0 THEN m ELSE lo END, CASE WHEN c > 0 THEN hi ELSE m END, k + 1 FROM (SELECT b.*, (lo + hi) / 2 AS m,
        1.0 / (1.0 + pow(10.0, (lo + hi) / 2 - {T.PKA_N_TERM})) - 1.0 / (1.0 + pow(10.0, {T.PKA_C_TERM} - (lo + hi) / 2)) {' '.join(f"- n_{a} * (1.0 / (1.0 + pow(10.0, {k} - (lo + hi) / 2)))" if a in "DECY" else f"+ n_{a} * (1.0 / (1.0 + pow(10.0, (lo + hi) / 2 - {k})))" for a, k in T.PKA.items())} AS c
        FROM v_bis b JOIN v_n USING (doc_id)) WHERE k < 60)"""
query("isoelectric_point", "WITH RECURSIVE " + ", ".join([v.PROTEIN, PI]) + " SELECT doc_id, round((lo + hi) / 2, 6) AS pi FROM v_bis WHERE k = 60")(lambda spark, d: v.protein(spark, d).select("doc_id", r6(P.isoelectric_point(F.col("s"))).alias("pi")))

CLASSES = "v_cls(prop, k, letters) AS (VALUES " + ", ".join(f"('{p}', {i + 1}, '{c}')" for p, cs in T.CTD.items() for i, c in enumerate(cs)) + ")"
CTD = """v_code AS (SELECT doc_id, prop, p, k, n FROM v_res JOIN v_cls ON contains(letters, aa)),
    v_place AS (SELECT doc_id, prop, k, max(n) AS n, list(p ORDER BY p) AS ps FROM v_code GROUP BY 1, 2, 3),
    v_all AS (SELECT d.doc_id, c.prop, c.k, d.n, coalesce(q.ps, []) AS ps FROM (SELECT doc_id, length(s) AS n FROM v_prot WHERE length(s) > 4) d CROSS JOIN v_cls c LEFT JOIN v_place q ON q.doc_id = d.doc_id AND q.prop = c.prop AND q.k = c.k)"""
query("ctd_descriptors", v.sql("""SELECT doc_id, prop || '_C' || k AS feature, round(CAST(len(ps) AS DOUBLE) / n, 12) AS value FROM v_all
    UNION ALL SELECT doc_id, prop || '_T', round(CAST(count(*) FILTER (k <> nk) AS DOUBLE) / (max(n) - 1), 12) FROM (SELECT *, lead(k) OVER (PARTITION BY doc_id, prop ORDER BY p) AS nk FROM v_code) GROUP BY doc_id, prop
    UNION ALL SELECT doc_id, prop || '_' || k || '_' || name, round(coalesce(CAST(ps[CAST(CASE name WHEN 'D1' THEN 0 WHEN 'D25' THEN len(ps) // 4 WHEN 'D50' THEN len(ps) // 2 WHEN 'D75' THEN 3 * len(ps) // 4 ELSE len(ps) - 1 END + 1 AS INTEGER)] AS DOUBLE) / n, 0), 12) FROM v_all, (SELECT unnest(['D1', 'D25', 'D50', 'D75', 'D100']) AS name)""", v.PROTEIN, RESIDUES_SQL, CLASSES, CTD))(
    lambda spark, d: long_enough(spark, d).select("doc_id", F.explode(P.ctd(F.col("s"))).alias("feature", "value")).select("doc_id", "feature", F.round("value", 12).alias("value"))
)

# Sums over pairs at a lag come from inner products of a sequence's values with themselves, moved by the lag.

_LEFT, _RIGHT = "y[1:n - k]", "y[k + 1:n]"
_PRODUCT = f"list_inner_product({_LEFT}, {_RIGHT})"
_SQUARES = f"(list_inner_product({_LEFT}, {_LEFT}) + list_inner_product({_RIGHT}, {_RIGHT}) - 2 * {_PRODUCT})"


def _listed(name: str, table: dict, scale: bool = False) -> str:
    """A view with each sequence's values y, less their mean (or, scaled, as the table's values in standard deviations), and their variance."""
    if scale:
        mean = sum(table.values()) / 20
        spread = (sum((x - mean) ** 2 for x in table.values()) / 20) ** 0.5
        table = {k: (x - mean) / spread for k, x in table.items()}
    values = ", ".join(f"('{k}', {x!r}::DOUBLE)" for k, x in table.items())
    y = "xs" if scale else "list_transform(xs, lambda x: x - m)"
    return f"{name} AS (SELECT doc_id, n, {y} AS y, v FROM (SELECT doc_id, n, list(x ORDER BY p) AS xs, avg(x) AS m, var_pop(x) AS v FROM v_res JOIN (VALUES {values}) t(aa, x) USING (aa) GROUP BY 1, 2))"


_AT_LAGS = "FROM {} JOIN (SELECT unnest(range(1, 31)) AS k) ON k < n"


def _moran(view: str) -> str:
    return f"SELECT doc_id, 'Moran_hydro_lag' || k AS feature, round(CASE WHEN v = 0 THEN 0 ELSE {_PRODUCT} / (n - k) / v END, 6) AS value {_AT_LAGS.format(view)}"


def _geary(view: str, name: str) -> str:
    return f"SELECT doc_id, 'Geary_{name}_lag' || k AS feature, round(CASE WHEN v = 0 THEN 0 ELSE n * {_SQUARES} / (2.0 * (n - k) * (n - 1) * v) END, 6) AS value {_AT_LAGS.format(view)}"


def _long(spark, d, features) -> DataFrame:
    return long_enough(spark, d).select("doc_id", F.explode(features(F.col("s"))).alias("feature", "value")).select("doc_id", "feature", r6("value").alias("value"))


HYDRO = _listed("v_hydro", T.HYDROPHOBICITY)
query("moran_autocorrelation", v.sql(_moran("v_hydro"), v.PROTEIN, RESIDUES_SQL, HYDRO))(lambda spark, d: _long(spark, d, D.moran))
query("geary_autocorrelation", v.sql(f"{_geary('v_mw', 'MW')} UNION ALL {_geary('v_pk', 'pK1')}", v.PROTEIN, RESIDUES_SQL, _listed("v_mw", T.RESIDUE_MASS), _listed("v_pk", T.PK1)))(lambda spark, d: _long(spark, d, D.geary))
query("autocorrelation", v.sql(f"SELECT doc_id, max(value) FILTER (feature = 'Moran_hydro_lag1') AS moran_1, max(value) FILTER (feature = 'Moran_hydro_lag2') AS moran_2, max(value) FILTER (feature = 'Moran_hydro_lag3') AS moran_3 FROM ({_moran('v_hydro')}) GROUP BY doc_id", v.PROTEIN, RESIDUES_SQL, HYDRO))(
    lambda spark, d: long_enough(spark, d).select("doc_id", *(r6(P.autocorrelation(F.col("s"), T.HYDROPHOBICITY, k, False)).alias(f"moran_{k}") for k in (1, 2, 3)))
)

COUNTS = "v_cnt AS (SELECT d.doc_id, d.n, t.aa, coalesce(c.c, 0) AS c FROM (SELECT doc_id, max(n) AS n FROM v_res GROUP BY 1) d CROSS JOIN (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS aa) t LEFT JOIN (SELECT doc_id, aa, count(*) AS c FROM v_res GROUP BY 1, 2) c ON c.doc_id = d.doc_id AND c.aa = t.aa)"
QSO = f"v_lag AS (SELECT doc_id, k, {_SQUARES} / (n - k) AS x {_AT_LAGS.format('v_place')})"
PAAC = f"v_lag AS (SELECT doc_id, k, ({' + '.join(_SQUARES.replace('y[', f'y{i}[') for i in (1, 2, 3))}) / 3 / (n - k) AS x FROM (SELECT a.doc_id, a.n, a.y AS y1, b.y AS y2, c.y AS y3 FROM v_p1 a JOIN v_p2 b USING (doc_id) JOIN v_p3 c USING (doc_id)) JOIN (SELECT unnest(range(1, 31)) AS k) ON k < n)"


def _with_lags(head: str, lag: str, weight: float) -> str:
    total = f"(n + {weight} * total)"
    return f"SELECT doc_id, '{head}_' || aa AS feature, round(c / {total}, 6) AS value FROM v_cnt JOIN v_sum USING (doc_id) UNION ALL SELECT l.doc_id, '{head}_{lag}' || k, round({weight} * x / {total}, 6) FROM v_lag l JOIN v_sum s ON s.doc_id = l.doc_id JOIN (SELECT DISTINCT doc_id, n FROM v_cnt) q ON q.doc_id = l.doc_id"


SUMS = "v_sum AS (SELECT doc_id, sum(x) AS total FROM v_lag GROUP BY doc_id)"
query("quasi_sequence_order", v.sql(_with_lags("QSO", "lag", 0.1), v.PROTEIN, RESIDUES_SQL, COUNTS, _listed("v_place", T.ORDER_PLACE), QSO, SUMS))(lambda spark, d: _long(spark, d, D.quasi_sequence_order))
query("pseudo_composition", v.sql(_with_lags("PAAC", "lambda", 0.05), v.PROTEIN, RESIDUES_SQL, COUNTS, _listed("v_p1", T.HYDROPHOBICITY, True), _listed("v_p2", T.HYDROPHILICITY, True), _listed("v_p3", T.SIDE_MASS, True), PAAC, SUMS))(lambda spark, d: _long(spark, d, D.pseudo_composition))
query("tripeptide_composition", v.sql("SELECT doc_id, t AS tripeptide, count(*) AS n, round(CAST(count(*) AS DOUBLE) / max(n), 6) AS fraction FROM (SELECT doc_id, length(s) - 2 AS n, substr(s, CAST(p + 1 AS INTEGER), 3) AS t FROM (SELECT doc_id, s, unnest(range(0, length(s) - 2)) AS p FROM v_prot WHERE length(s) > 4)) GROUP BY 1, 2", v.PROTEIN))(
    lambda spark, d: long_enough(spark, d).select("doc_id", (F.length("s") - 2).alias("len"), F.explode(D.composition(F.col("s"), 3)).alias("tripeptide", "n")).select("doc_id", "tripeptide", "n", r6(F.col("n") / F.col("len")).alias("fraction"))
)
_SHOWN = ["AAC_A", "PC_gravy", "CTD_charge_C3", "DPC_AA"]
query("protein_features", v.sql(f"""SELECT doc_id, 'AAC_A' AS feature, round(CAST({n_of('A')} AS DOUBLE) / length(s), 6) AS value FROM v_prot WHERE length(s) > 4
    UNION ALL SELECT doc_id, 'PC_gravy', round({aa_total(T.HYDROPATHY)} / {ALL20}, 6) FROM v_prot WHERE length(s) > 4
    UNION ALL SELECT doc_id, 'CTD_charge_C3', round(CAST({n_of('HKR')} AS DOUBLE) / length(s), 6) FROM v_prot WHERE length(s) > 4
    UNION ALL SELECT doc_id, 'DPC_AA', round(CAST(len(list_filter(range(1, length(s)), lambda i: substr(s, CAST(i AS INTEGER), 2) = 'AA')) AS DOUBLE) / (length(s) - 1), 6) FROM v_prot WHERE length(s) > 4""", v.PROTEIN))(
    lambda spark, d: long_enough(spark, d).select("doc_id", F.explode(D.all_features(F.col("s"), _SHOWN)).alias("feature", "value")).where(F.col("feature").isin(_SHOWN)).select("doc_id", "feature", r6("value").alias("value"))
)
query("metal_binding_sites", v.sql("SELECT doc_id, CAST(p AS INTEGER) AS pos FROM v_res WHERE aa IN ('H', 'C', 'D', 'E', 'M')", v.PROTEIN, RESIDUES_SQL))(lambda spark, d: long_enough(spark, d).select("doc_id", F.explode(P.metal_binding(F.col("s"))).alias("pos")))

# Secondary structure: helix windows first, then sheets where a window does not start in a helix, then turns.
STRUCTURE = """v_h AS (SELECT doc_id, p, n, aa, max(CASE WHEN score >= 1.1 - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS helix FROM (SELECT doc_id, p, n, aa, CASE WHEN p <= n - 6 THEN avg(h) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) ELSE 0 END AS score FROM (SELECT doc_id, p, n, aa, coalesce(m[aa], 0.9) AS h FROM v_res, (SELECT HELIXMAP AS m)))),
    v_e AS (SELECT doc_id, p, n, CASE WHEN helix = 1 THEN 'H' WHEN max(starts) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 THEN 'E' ELSE 'C' END AS ss FROM (SELECT *, CASE WHEN helix = 0 AND p <= n - 4 AND sum(CASE WHEN contains('HYDROPHOBES', aa) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) >= 2 THEN 1 ELSE 0 END AS starts FROM v_h))""".replace("HELIXMAP", MAPS["helix"]).replace("HYDROPHOBES", T.SHEET_RESIDUES)
# Places between a helix and a sheet, on either side, are turns; of such places in a row every other one, as a turn is neither.
TURNS = "v_t AS (SELECT doc_id, ss, turn AND row_number() OVER (PARTITION BY doc_id, turn, island ORDER BY p) % 2 = 1 AS turned FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, turn ORDER BY p) AS island FROM (SELECT doc_id, p, ss, coalesce(lag(ss) OVER w || lead(ss) OVER w IN ('HE', 'EH'), FALSE) AS turn FROM v_e WINDOW w AS (PARTITION BY doc_id ORDER BY p))))"
query("secondary_structure", v.sql("SELECT doc_id, count(*) FILTER (turned) AS turns, count(*) FILTER (ss = 'H' AND NOT turned) AS helix, count(*) FILTER (ss = 'E' AND NOT turned) AS sheet FROM v_t GROUP BY doc_id", v.PROTEIN, RESIDUES_SQL, STRUCTURE, TURNS))(
    lambda spark, d: long_enough(spark, d).select("doc_id", D.secondary_structure(F.col("s")).alias("ss")).select("doc_id", *(F.regexp_count("ss", F.lit(c)).cast("long").alias(n) for c, n in (("T", "turns"), ("H", "helix"), ("E", "sheet"))))
)

# Pairs of proteins: each document with the one of the next id.

_SHARE = lambda letters: f"CAST({n_of(letters)} AS DOUBLE) / length(s)"
FIGURES = f"v_fig AS (SELECT doc_id, s, length(s) AS n, CAST({aa_total(T.MASS)} - (length(s) - 1) * 18.02 AS DOUBLE) AS weight, CAST({aa_total(T.HYDROPATHY)} AS DOUBLE) / {ALL20} AS gravy, {_SHARE(T.HYDROPHOBIC)} AS hydro, {charge_sql(7.0)} AS charge FROM v_prot WHERE length(s) > 4)"
FACE = f"v_face AS (SELECT doc_id, CAST(count(*) FILTER (score >= 1.05 - 1e-9) AS DOUBLE) / count(*) AS face FROM (SELECT doc_id, avg(x) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS score FROM (SELECT doc_id, p, coalesce(m[aa], 1.0) AS x FROM v_res, (SELECT {MAPS['face']} AS m))) GROUP BY doc_id)"
PAIRS = "v_dip AS (SELECT doc_id, d, CAST(count(*) AS DOUBLE) / max(n - 1) AS f FROM (SELECT doc_id, n, substr(s, CAST(p + 1 AS INTEGER), 2) AS d FROM (SELECT doc_id, n, s, unnest(range(0, n - 1)) AS p FROM v_fig)) GROUP BY 1, 2), v_pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM v_fig a JOIN v_fig b ON b.doc_id = a.doc_id + 1), v_sim AS (SELECT x.a, sum(least(p.f, q.f)) AS sim FROM v_pair x JOIN v_dip p ON p.doc_id = x.a JOIN v_dip q ON q.doc_id = x.b AND q.d = p.d GROUP BY x.a)"


def protein_pairs(spark, d) -> DataFrame:
    p = long_enough(spark, d)
    return p.select(F.col("doc_id").alias("a"), F.col("s").alias("x")).join(p.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("s").alias("y")), "a")


query("protein_interaction", v.sql("""SELECT a, b, round(raw, 6) AS score, round(least(1.0, 1.2 * raw), 6) AS confidence, least(1.0, 1.2 * raw) >= 0.5 AS likely FROM (
    SELECT p.a, p.b, CASE WHEN f.charge * g.charge < 0 THEN 1.0 ELSE 0.3 END * 0.25 + (1 - abs(f.hydro - g.hydro)) * 0.20 + CASE WHEN f.gravy * g.gravy < 0 THEN 0.8 ELSE 0.4 END * 0.15 + (h.face + i.face) / 2 * 0.25 + exp(-abs(log2(CAST(f.n AS DOUBLE) / g.n)) / 3) * 0.10 + coalesce(s.sim, 0) * 0.05 AS raw
    FROM v_pair p JOIN v_fig f ON f.doc_id = p.a JOIN v_fig g ON g.doc_id = p.b JOIN v_face h ON h.doc_id = p.a JOIN v_face i ON i.doc_id = p.b LEFT JOIN v_sim s ON s.a = p.a)""", v.PROTEIN, RESIDUES_SQL, FIGURES, FACE, PAIRS))(
    lambda spark, d: protein_pairs(spark, d).select("a", "b", D.interaction(F.col("x"), F.col("y")).alias("i")).select("a", "b", r6("i.score").alias("score"), r6("i.confidence").alias("confidence"), "i.likely")
)
query("conjunction_features", v.sql("""SELECT p.a, round(f.weight / g.weight, 6) AS mw_ratio, round(f.gravy + g.gravy, 6) AS gravy_sum, round(f.gravy * g.gravy, 6) AS gravy_product, round(f.charge * g.charge, 4) AS charge_product, round(CAST(f.n AS DOUBLE) / g.n, 6) AS length_ratio, round(coalesce(f.hydro / nullif(g.hydro, 0), 0), 6) AS hydro_ratio,
    round((CAST(length(f.s) - length(replace(f.s, 'A', '')) AS DOUBLE) / f.n) * (CAST(length(g.s) - length(replace(g.s, 'A', '')) AS DOUBLE) / g.n), 6) AS aac_prod_a FROM v_pair p JOIN v_fig f ON f.doc_id = p.a JOIN v_fig g ON g.doc_id = p.b""", v.PROTEIN, FIGURES, "v_pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM v_fig a JOIN v_fig b ON b.doc_id = a.doc_id + 1)"))(
    lambda spark, d: protein_pairs(spark, d).select("a", D.conjunction(F.col("x"), F.col("y")).alias("c")).select("a", *(F.round(F.element_at("c", F.lit(k)), 4 if k == "charge_product" else 6).alias(n) for k, n in (("MW_ratio", "mw_ratio"), ("GRAVY_sum", "gravy_sum"), ("GRAVY_product", "gravy_product"), ("charge_product", "charge_product"), ("length_ratio", "length_ratio"), ("hydro_ratio", "hydro_ratio"), ("AAC_prod_A", "aac_prod_a"))))
)
query("physicochemical_profile", v.sql(f"SELECT doc_id, 'gravy' AS feature, round({aa_total(T.HYDROPATHY)} / {ALL20}, 6) AS value FROM v_prot WHERE length(s) > 4 UNION ALL SELECT doc_id, 'length', CAST(length(s) AS DOUBLE) FROM v_prot WHERE length(s) > 4 UNION ALL SELECT doc_id, 'chargeAtPH7', round({charge_sql(7.0)}, 6) FROM v_prot WHERE length(s) > 4", v.PROTEIN))(
    lambda spark, d: long_enough(spark, d).select("doc_id", F.explode(P.profile(F.col("s"))).alias("feature", "value")).where(F.col("feature").isin("gravy", "length", "chargeAtPH7")).select("doc_id", "feature", r6("value").alias("value"))
)
query("protein_report", v.sql(f"SELECT doc_id, CASE WHEN inst < 40 THEN 'stable' ELSE 'unstable' END AS stability, CASE WHEN boman > 2.48 THEN 'high' WHEN boman < 1.0 THEN 'low' ELSE 'moderate' END AS boman_band, CASE WHEN gravy > 0 THEN 'hydrophobic' ELSE 'hydrophilic' END AS nature, CASE WHEN charge > 0 THEN 'positive' WHEN charge < 0 THEN 'negative' ELSE 'near zero' END AS net FROM (SELECT f.doc_id, gravy, charge, CAST({aa_total(T.BOMAN)} AS DOUBLE) / {ALL20} AS boman FROM v_fig f) JOIN (SELECT doc_id, 10.0 * sum(coalesce(m[substr(s, CAST(p + 1 AS INTEGER), 2)], 1.0)) / max(length(s)) AS inst FROM (SELECT doc_id, s, unnest(range(0, length(s) - 1)) AS p FROM v_prot WHERE length(s) > 4), (SELECT map {{{', '.join(f"'{k}': {x!r}" for k, x in T.INSTABILITY.items())}}} AS m) GROUP BY doc_id) USING (doc_id)", v.PROTEIN, FIGURES))(
    lambda spark, d: long_enough(spark, d).select("doc_id", D.report(F.col("s")).alias("r")).select("doc_id", "r.stability", "r.boman_band", "r.nature", "r.net")
)
