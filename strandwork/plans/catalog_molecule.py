"""Queries of molecules, with DuckDB twins in closed form: parts become chains of known composition with a known end group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions import molecule as M
from strandwork.functions import protein as P
from strandwork.functions import sequence as S
from strandwork.functions import tables as T
from strandwork.operators import predictors as R
from strandwork.operators.models import BUILT_IN
from strandwork.plans import views as v
from strandwork.plans.catalog import _nb_sql, charge_sql, n_of, query, r6

# End groups of the chains.
TAILS = ["", "O", "N", "C(=O)O", "Cl", "S", "C=CC(=O)O", "C(N)C(=O)O"]


def smiles(spark, d) -> DataFrame:
    """A chain of 1 to 9 carbons with one of eight end groups, on a benzene ring or not, per part."""
    k = F.col("p_partkey")
    ring = F.when(F.floor(k / 8) % 2 == 1, "c1ccccc1").otherwise("")
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (k % 8 + 1).cast("int"))
    parts = v.table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a file of 10 MB is one task, and a row costs far more than its bytes
    return parts.select(k.alias("id"), F.col("p_size").alias("activity"), F.concat(ring, F.expr("repeat('C', cast(1 + p_partkey % 9 as int))"), tail).alias("smiles"))


def molecules(spark, d) -> DataFrame:
    return smiles(spark, d).withColumn("d", M.descriptors(F.col("smiles")))


# The same in closed form: n carbons in the chain, t kind of end, r rings; L atoms along the chain, ends included.
CHAIN = """v_chain AS (SELECT *, c * 12.011 + h * 1.008 + ni * 14.007 + o * 15.999 + cl * 35.453 + su * 32.065 AS weight FROM (SELECT id, activity, n, t, r, n + CASE t WHEN 3 THEN 1 WHEN 6 THEN 3 WHEN 7 THEN 2 ELSE 0 END + 6 * r AS c,
    2 * n + CASE r WHEN 1 THEN 5 ELSE 1 END + CASE t WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 3 ELSE 4 END AS h, CASE WHEN t IN (2, 7) THEN 1 ELSE 0 END AS ni, CASE WHEN t = 1 THEN 1 WHEN t IN (3, 6, 7) THEN 2 ELSE 0 END AS o,
    CASE WHEN t = 4 THEN 1 ELSE 0 END AS cl, CASE WHEN t = 5 THEN 1 ELSE 0 END AS su, n + CASE WHEN t = 0 THEN 0 WHEN t = 6 THEN 3 WHEN t = 7 THEN 2 ELSE 1 END AS len FROM (SELECT p_partkey AS id, p_size AS activity, 1 + p_partkey % 9 AS n, p_partkey % 8 AS t, p_partkey // 8 % 2 AS r FROM part)))"""
MOL = f"""v_mol AS (SELECT *, c + ni + o + cl + su AS heavy, c + ni + o + cl + su + h AS atoms, c + ni + o + cl + su - 1 + r AS bonds, CASE WHEN t = 7 THEN 2 WHEN t IN (1, 2, 3, 6) THEN 1 ELSE 0 END AS hbd, ni + o AS hba,
    CASE t WHEN 1 THEN 20.23 WHEN 2 THEN 26.02 WHEN 3 THEN 37.30 WHEN 5 THEN 34.14 WHEN 6 THEN 37.30 WHEN 7 THEN 63.32 ELSE 0 END AS tpsa, greatest(0, len - 1 + r - CASE WHEN r = 1 THEN 0 ELSE 1 END - CASE WHEN t IN (3, 6, 7) THEN 0 ELSE 1 END - CASE WHEN t = 6 THEN 1 ELSE 0 END) AS rotatable,
    h * {M.LOGP['H']} + 6 * r * {M.LOGP['C_ar']} + (n + CASE WHEN t = 7 THEN 1 ELSE 0 END) * {M.LOGP['C_sp3']} + ni * {M.LOGP['N_sp3']} + CASE WHEN t = 1 THEN {M.LOGP['O_sp3']} WHEN o = 2 THEN 2 * {M.LOGP['O_co2']} ELSE 0 END + cl * {M.LOGP['Cl']} + su * {M.LOGP['S']} AS logp,
    CAST(n + CASE WHEN t = 7 THEN 1 ELSE 0 END AS DOUBLE) / c AS fsp3, 0.029 * weight + 1.512 * (c + ni) + 0.686 * (o + su) AS refractivity FROM v_chain)"""
PASSED = "v_pass AS (SELECT *, weight <= 500 AND logp <= 5 AND hbd <= 5 AND hba <= 10 AS lipinski, tpsa <= 140 AND rotatable <= 10 AS veber, weight BETWEEN 160 AND 480 AND logp BETWEEN -0.4 AND 5.6 AND refractivity BETWEEN 40 AND 130 AND atoms BETWEEN 20 AND 70 AS ghose, tpsa <= 131.6 AND logp BETWEEN -1.0 AND 5.88 AS egan, CAST(weight BETWEEN 200 AND 600 AS INTEGER) + CAST(logp BETWEEN -2 AND 5 AS INTEGER) + CAST(tpsa <= 150 AS INTEGER) + CAST(r <= 7 AS INTEGER) + CAST(heavy > 4 AS INTEGER) + CAST(atoms > heavy AS INTEGER) + CAST(rotatable <= 15 AS INTEGER) + CAST(hbd <= 5 AS INTEGER) + CAST(hba <= 10 AS INTEGER) AS muegge, CASE WHEN t = 6 THEN 'Michael Acceptor' ELSE '' END || CASE WHEN r = 1 AND t = 7 THEN 'Potential Nitro Group' ELSE '' END AS alerts FROM v_mol)"


@query("molecule_descriptors", v.sql("SELECT id, 'C' || CASE WHEN c > 1 THEN CAST(c AS VARCHAR) ELSE '' END || 'H' || h || CASE WHEN cl = 1 THEN 'Cl' ELSE '' END || CASE WHEN ni = 1 THEN 'N' ELSE '' END || CASE o WHEN 0 THEN '' WHEN 1 THEN 'O' ELSE 'O2' END || CASE WHEN su = 1 THEN 'S' ELSE '' END AS formula, round(CAST(weight AS DOUBLE), 4) AS weight, round(CAST(logp AS DOUBLE), 4) AS logp, CAST(hbd AS INTEGER) AS hbd, CAST(hba AS INTEGER) AS hba, round(CAST(tpsa AS DOUBLE), 4) AS tpsa, CAST(rotatable AS INTEGER) AS rotatable, CAST(r AS INTEGER) AS rings, CAST(r AS INTEGER) AS aromatic_rings, CAST(heavy AS INTEGER) AS heavy, CAST(atoms AS INTEGER) AS atoms, CAST(bonds AS INTEGER) AS bonds, round(fsp3, 6) AS fsp3, round(CAST(refractivity AS DOUBLE), 4) AS refractivity, CAST(0 AS INTEGER) AS stereocenters FROM v_mol", CHAIN, MOL))
def molecule_descriptors(spark, d) -> DataFrame:
    whole = ("formula", "hbd", "hba", "rotatable", "rings", "aromatic_rings", "heavy", "atoms", "bonds", "stereocenters")
    return molecules(spark, d).select("id", *(f"d.{c}" for c in whole), *(F.round(f"d.{c}", 4).alias(c) for c in ("weight", "logp", "tpsa", "refractivity")), r6("d.fsp3").alias("fsp3"))


query("drug_filters", v.sql("SELECT id, lipinski, veber, ghose, egan, CAST(muegge AS INTEGER) AS muegge FROM v_pass", CHAIN, MOL, PASSED))(
    lambda spark, d: molecules(spark, d).select("id", M.lipinski(F.col("d")).alias("lipinski"), M.veber(F.col("d")).alias("veber"), M.ghose(F.col("d")).alias("ghose"), M.egan(F.col("d")).alias("egan"), M.muegge(F.col("d")).alias("muegge"))
)
query("drug_report", v.sql("SELECT id, CAST(passed AS INTEGER) AS passed, alerts, CASE WHEN passed >= 4 AND alerts = '' THEN 'Excellent' WHEN passed >= 3 THEN 'Acceptable' ELSE 'Concerns' END AS verdict FROM (SELECT id, alerts, CAST(lipinski AS INTEGER) + CAST(veber AS INTEGER) + CAST(ghose AS INTEGER) + CAST(egan AS INTEGER) + CAST(muegge >= 7 AS INTEGER) AS passed FROM v_pass)", CHAIN, MOL, PASSED))(
    lambda spark, d: molecules(spark, d).select("id", M.filters_passed(F.col("d")).alias("passed"), F.array_join(M.alerts(F.col("d")), "").alias("alerts"), M.verdict(F.col("d")).alias("verdict"))
)
query("admet", v.sql("""SELECT id, CASE WHEN tpsa < 60 AND logp BETWEEN 0 AND 3 THEN 'High' WHEN tpsa > 140 OR logp > 5 OR logp < -2 THEN 'Low' ELSE 'Moderate' END AS oral, CASE WHEN tpsa < 60 AND weight < 500 AND logp > 0 THEN 'High' ELSE 'Low' END AS caco2, logp > 3 AND weight > 400 AND r >= 2 AS pgp,
    CASE WHEN tpsa < 75 AND logp BETWEEN -1 AND 4 THEN 'High (>80%)' WHEN tpsa > 120 THEN 'Low (<20%)' ELSE 'Moderate (20-80%)' END AS hia, logp BETWEEN 1 AND 3.5 AND weight < 450 AND tpsa < 90 AND hbd <= 3 AND hba <= 7 AS bbb, round(CAST(CASE WHEN logp > 3 THEN 2.5 + (logp - 3) * 0.5 WHEN logp < 0 THEN 0.2 ELSE 0.7 + logp * 0.6 END AS DOUBLE), 6) AS vdss,
    CASE WHEN logp > 3 THEN 'High >90%' WHEN logp > 1 THEN 'Moderate 50-90%' ELSE 'Low <50%' END AS binding, FALSE AS cyp3a4, ni > 0 AS cyp2d6, o > 0 AND logp BETWEEN 1 AND 5 AS cyp2c9, FALSE AS cyp3a4_inhibitor, ni > 0 AND r >= 1 AS cyp2d6_inhibitor, CASE WHEN weight < 200 THEN 'Short <2h' ELSE 'Moderate 2-8h' END AS half_life,
    CASE WHEN logp < 1 AND weight < 300 THEN 'High' ELSE 'Low/Moderate' END AS renal, logp > 2 AND ni > 0 AS herg, 'Non-mutagenic' AS ames, CASE WHEN weight < 200 AND logp < 1 THEN 'Class I (Low risk)' ELSE 'Class II (Moderate risk)' END AS oral_toxicity, su > 0 AND logp > 2 AS skin FROM v_mol""", CHAIN, MOL))(
    lambda spark, d: molecules(spark, d).select("id", M.admet(F.col("d")).alias("a")).select("id", "a.*").withColumn("vdss", r6("vdss"))
)

# Molecules with documents as proteins, and as DNA: part k with document k mod 500.


def _with_hosts(spark, d, texts: DataFrame, figures: Column) -> DataFrame:
    """Molecules with the figures of their document: computed once per document, so no text travels with a molecule.

    Only ids between -499 and 499 can be met. Their figures are broadcast behind a count; many equal ids are joined by shuffle.
    """
    some = texts.where(F.col("doc_id").between(-499, 499)).select("doc_id", figures.alias("h"))
    hosts = F.broadcast(some) if texts.where(F.col("doc_id").between(-499, 499)).count() <= 10_000 else some.hint("shuffle_hash")
    return molecules(spark, d).withColumn("doc_id", F.col("id") % 500).join(hosts, "doc_id")


HOST = f"v_host AS (SELECT doc_id, length(s) AS n, {n_of('DESTYNQH')} AS acceptors, {n_of('STYKRHNQW')} AS donors, {n_of('AVILMFWPY')} AS water, {n_of('FYWH')} AS aromatic, {charge_sql(7.0)} AS charge FROM v_prot)"
query("drug_protein_binding", v.sql("SELECT id, round(dg, 9) AS dg, round(least(1, greatest(0, (-dg - 2) / 8)), 12) AS confidence, dg < -5 AND least(1, greatest(0, (-dg - 2) / 8)) > 0.4 AS binder FROM (SELECT id, CAST(-(least(hbd, acceptors) + least(hba, donors)) * 0.9 - CASE WHEN logp > 0 THEN logp * coalesce(CAST(water AS DOUBLE) / nullif(p.n, 0), 0) * 0.8 ELSE 0 END - least(r * aromatic * 0.3, 3.0) + tpsa * 0.02 + rotatable * 0.3 AS DOUBLE) AS dg FROM v_mol m JOIN v_host p ON p.doc_id = m.id % 500)", v.PROTEIN, CHAIN, MOL, HOST))(
    lambda spark, d: _with_hosts(spark, d, v.protein(spark, d), M.host(F.col("s"))).select("id", M.host_binding(F.col("d"), F.col("h")).alias("b")).select("id", F.round("b.dg", 9).alias("dg"), F.round("b.confidence", 12).alias("confidence"), "b.binder")
)
query("drug_dna_binding", v.sql(f"SELECT id, round(inter, 6) AS intercalation, round(groove, 6) AS groove, risk, CASE WHEN inter > 4 THEN 'Intercalation' WHEN groove > 3 THEN 'Minor groove binding' WHEN risk = 'High' THEN 'Covalent alkylation' ELSE 'Electrostatic / non-specific' END AS mode FROM (SELECT id, CAST(CASE WHEN r = 1 THEN 0.9 ELSE 0 END + gc / 200.0 AS DOUBLE) AS inter, CAST(greatest(0, 1 - rotatable * 0.1) * 2 + (100 - gc) / 100.0 * 1.5 + hbd * 0.5 + CASE WHEN weight BETWEEN 300 AND 600 THEN 1 ELSE 0 END AS DOUBLE) AS groove, CASE WHEN alerts = '' THEN 'Low' ELSE 'Moderate' END AS risk FROM v_pass JOIN (SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE {n_of('GC')} * 100.0 / length(s) END AS gc FROM v_dna) g ON g.doc_id = id % 500)", v.DNA, CHAIN, MOL, PASSED))(
    lambda spark, d: _with_hosts(spark, d, v.dna(spark, d), S.gc_content(F.col("s"))).select("id", M.dna_binding(F.col("d"), F.col("h")).alias("b")).select("id", r6("b.intercalation").alias("intercalation"), r6("b.groove").alias("groove"), "b.risk", "b.mode")
)
query("drug_rna_binding", v.sql("SELECT id, round(CAST((p_size % 20) / 50.0 * 2 + r * 0.4 + ni * 0.3 - logp * 0.2 AS DOUBLE), 4) AS score FROM v_mol JOIN part ON p_partkey = id", CHAIN, MOL))(
    lambda spark, d: molecules(spark, d).select("id", F.round(M.rna_binding(F.col("d"), F.col("activity") % 20, F.lit(50)), 4).alias("score"))
)
query("metal_coordination", v.sql("SELECT p_partkey AS id, TRUE AS metal, 1.5::DOUBLE * (p_partkey % 5) + 1.5 AS score FROM part"))(
    lambda spark, d: v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("[Fe]"), F.expr("repeat('(N)', cast(p_partkey % 5 as int))"), F.lit("(C)O")).alias("smiles")).select("id", M.descriptors(F.col("smiles")).alias("d")).select("id", (F.col("d.metals") > 0).alias("metal"), F.col("d.coordination").alias("score"))
)
query("pharmacophore_match", v.sql("SELECT id, round((CASE WHEN t IN (1, 2, 3, 6, 7) THEN 1 ELSE 0 END + CASE WHEN ni + o > 0 THEN 1 ELSE 0 END + CASE WHEN r = 1 THEN 1 ELSE 0 END) / 3.0::DOUBLE, 6) AS match FROM v_mol", CHAIN, MOL))(
    lambda spark, d: smiles(spark, d).select("id", r6(M.pharmacophore_match(F.create_map(F.lit("HBD"), F.array(F.lit(0)), F.lit("HBA"), F.array(F.lit(0)), F.lit("Aromatic"), F.array(F.lit(1)), F.lit("Positive"), F.array().cast("array<int>")), M.pharmacophore(F.col("smiles")))).alias("match"))
)
_QSAR = {"mw": "weight", "logP": "logp", "hbd": "hbd", "hba": "hba", "tpsa": "tpsa", "rotB": "rotatable", "rings": "r", "mr": "refractivity", "fsp3": "fsp3"}
FIT = f"v_fit AS (SELECT avg(activity) AS intercept, {', '.join(f'corr(CAST({c} AS DOUBLE), activity) AS k_{k}' for k, c in _QSAR.items())} FROM v_mol)"
query("qsar_model", v.sql("SELECT round(intercept, 6) AS intercept, " + ", ".join(f'round(k_{k}, 6) AS "{k}"' for k in _QSAR) + " FROM v_fit", CHAIN, MOL, FIT))(lambda spark, d: M.train_qsar(molecules(spark, d)).select(r6("intercept").alias("intercept"), *(r6(k).alias(k) for k in _QSAR)))
query("qsar_predictions", v.sql("SELECT id, round(intercept + " + " + ".join(f"k_{k} * CAST({c} AS DOUBLE)" for k, c in _QSAR.items()) + ", 4) AS prediction FROM v_mol, v_fit", CHAIN, MOL, FIT))(
    lambda spark, d: M.predict_qsar(molecules(spark, d), M.train_qsar(molecules(spark, d))).select("id", F.round("prediction", 4).alias("prediction"))
)


def _predictions(model: str, columns: list[str]) -> str:
    parts, labels = _nb_sql([f"CAST({c} AS DOUBLE)" for c in columns], BUILT_IN[model][1])
    names = [f"a{i}" for i in range(len(labels))]
    top = f"greatest({', '.join(names)})"
    label = "CASE " + " ".join(f"WHEN {a} = {top} THEN '{x}'" for a, x in zip(names, labels)) + " END"
    return f"SELECT id, '{model}' AS model, {label} AS label, round(1 / ({' + '.join(f'exp({a} - {top})' for a in names)}), 6) AS confidence FROM (SELECT id, {', '.join(f'{x} AS {a}' for x, a in zip(parts, names))} FROM v_mol)"


@query("drug_predictions", v.sql(" UNION ALL ".join(_predictions(m, c) for m, c in (("activity", ["weight", "logp", "hbd", "hba", "tpsa", "rotatable", "r", "fsp3"]), ("toxicity", ["weight", "logp", "hbd", "hba", "tpsa", "rotatable", "r"]), ("herg", ["logp", "weight", "hbd", "hba", "r", "tpsa"]))), CHAIN, MOL))
def drug_predictions(spark, d) -> DataFrame:
    a = molecules(spark, d).select("id", R.full_analysis("molecule", F.col("d")).alias("x"))
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"x.{m}.label").alias("label"), r6(f"x.{m}.confidence").alias("confidence")) for m in ("activity", "toxicity", "herg")))
    return a.select("id", F.explode(each).alias("e")).select("id", "e.*")


@query("virtual_screening")
def virtual_screening(spark, d) -> DataFrame:
    """The twenty most similar drug-like molecules of each molecule whose id is divisible by 50, by Morgan fingerprints."""
    from strandwork.operators.similarity import screen_kinds

    fp = molecules(spark, d).where(M.lipinski(F.col("d"))).select("id", M.fingerprint(F.col("smiles")).alias("bits"))
    return screen_kinds(fp.where("id % 50 = 0"), fp, 0.4, 20).withColumn("tanimoto", r6("tanimoto"))


query("fingerprint_screen", v.sql("SELECT q.vec_id AS query, f.vec_id AS id, round(CAST(len(list_intersect(f.bits, q.bits)) AS DOUBLE) / (len(f.bits) + len(q.bits) - len(list_intersect(f.bits, q.bits))), 6) AS tanimoto FROM v_fp f, v_fp q WHERE q.vec_id % 50 = 0 AND CAST(len(list_intersect(f.bits, q.bits)) AS DOUBLE) / (len(f.bits) + len(q.bits) - len(list_intersect(f.bits, q.bits))) >= 0.5", v.BITS))(
    lambda spark, d: _screened(spark, d)
)


def _screened(spark, d) -> DataFrame:
    from strandwork.operators.similarity import screen

    fp = v.bits(spark, d).withColumnRenamed("vec_id", "id")
    return screen(fp.where("id % 50 = 0"), fp, 0.5).withColumn("tanimoto", r6("tanimoto"))


# Classifiers of proteins, and prompts made of descriptors

_SHARES = {"charged": "RKHDE", "hydro": T.HYDROPHOBIC, "aromatic": T.AROMATIC}


@query("protein_predictions")
def protein_predictions(spark, d) -> DataFrame:
    """Enzyme and membrane classes of the documents as proteins."""
    p = v.protein(spark, d, least=5).select("doc_id", R.full_analysis("protein", F.col("s")).alias("x"))
    return p.select("doc_id", F.col("x.enzyme.label").alias("enzyme"), r6("x.enzyme.confidence").alias("enzyme_confidence"), F.col("x.membrane.label").alias("membrane"), r6("x.membrane.confidence").alias("membrane_confidence"))


@query("drug_prompts", v.sql("SELECT id, 'Molecule: ' || id || chr(10) || 'Weight: ' || printf('%.3f', CAST(weight AS DOUBLE)) || ' Da' || chr(10) || 'Donors and acceptors: ' || hbd || '/' || hba || chr(10) || 'Rotatable bonds: ' || rotatable || chr(10) || 'Lipinski: ' || CASE WHEN lipinski THEN 'PASS' ELSE 'FAIL' END || CASE WHEN alerts = '' THEN '' ELSE chr(10) || 'Alerts: ' || alerts END AS prompt FROM v_pass", CHAIN, MOL, PASSED))
def drug_prompts(spark, d) -> DataFrame:
    from strandwork.operators.prompts import prompt

    m, x = molecules(spark, d), F.col("d")
    alerts = F.array_join(M.alerts(x), ", ")
    lines = {"Molecule": F.col("id").cast("string"), "Weight": F.format_string("%.3f Da", x["weight"]), "Donors and acceptors": F.format_string("%d/%d", x["hbd"], x["hba"]), "Rotatable bonds": x["rotatable"].cast("string"), "Lipinski": F.when(M.lipinski(x), "PASS").otherwise("FAIL"), "Alerts": F.when(alerts != "", alerts)}
    return m.select("id", prompt(lines).alias("prompt"))


# Ensembles of votes: a customer's orders vote by priority.

query("majority_vote", v.sql("SELECT id, label, votes, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS r FROM (SELECT o_custkey AS id, o_orderpriority AS label, count(*) AS votes, avg(CAST(o_orderkey % 100 AS DOUBLE) / 100) AS confidence FROM orders GROUP BY 1, 2)) WHERE r = 1"))(
    lambda spark, d: _votes(spark, d)
)
query("weighted_vote", v.sql("SELECT id, label, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, label) AS r FROM (SELECT id, label, sum(p * w) / max(total) AS confidence FROM (SELECT o_custkey AS id, unnest([o_orderpriority, 'other']) AS label, unnest([0.75, 0.25])::DOUBLE AS p, o_orderkey % 7 + 1 AS w, sum(o_orderkey % 7 + 1) OVER (PARTITION BY o_custkey) AS total FROM orders) GROUP BY 1, 2)) WHERE r = 1"))(
    lambda spark, d: _weighted(spark, d)
)


def _votes(spark, d) -> DataFrame:
    from strandwork.operators.models import vote

    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"))
    return vote(o).withColumn("confidence", r6("confidence"))


def _weighted(spark, d) -> DataFrame:
    from strandwork.operators.models import weighted_vote

    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.create_map("o_orderpriority", F.lit(0.75), F.lit("other"), F.lit(0.25)).alias("probabilities"), (F.col("o_orderkey") % 7 + 1).alias("weight"))
    return weighted_vote(o).withColumn("confidence", r6("confidence"))


# A tree, a forest, a linear and a nearest-neighbour model, as JSON that is loaded again

TREE = {"feature": "qty", "threshold": 25.0, "left": {"feature": "disc", "threshold": 0.05, "left": {"probabilities": {"a": 0.75, "b": 0.25}}, "right": {"probabilities": {"a": 0.5, "b": 0.5}}}, "right": {"probabilities": {"a": 0.25, "b": 0.75}}}
STUMP = {"feature": "tax", "threshold": 0.04, "left": {"probabilities": {"a": 1.0}}, "right": {"probabilities": {"b": 1.0}}}
_TREE_SQL = "CASE WHEN l_quantity <= 25 THEN CASE WHEN l_discount <= 0.05 THEN 0.75 ELSE 0.5 END ELSE 0.25 END"
_STUMP_SQL = "CASE WHEN l_tax <= 0.04 THEN 1.0 ELSE 0.0 END"


@query("loaded_models", v.sql(f"SELECT l_orderkey * 10 + l_linenumber AS id, round(CAST({_TREE_SQL} AS DOUBLE), 6) AS tree, CASE WHEN ({_TREE_SQL} + {_STUMP_SQL}) / 2 >= 0.5 THEN 'a' ELSE 'b' END AS forest, CASE WHEN 0.5 - 0.01 * l_quantity >= -0.5 + 0.02 * l_quantity THEN 'a' ELSE 'b' END AS linear, CASE WHEN 1 / (abs(l_quantity - 10) + 1e-6) + 0 >= 1 / (abs(l_quantity - 40) + 1e-6) THEN 'a' ELSE 'b' END AS near FROM lineitem"))
def loaded_models(spark, d) -> DataFrame:
    from strandwork.operators.models import load, save

    f = {"qty": F.col("l_quantity"), "disc": F.col("l_discount"), "tax": F.col("l_tax")}
    tree = load(save("decision_tree", list(f), tree=TREE))(f)
    forest = load(save("rf", list(f), trees=[TREE, STUMP], labels=["a", "b"]))(f)
    line = load(save("linear", ["qty"], classes={"a": {"bias": 0.5, "weights": [-0.01]}, "b": {"bias": -0.5, "weights": [0.02]}}))(f)
    near = load(save("knn", ["qty"], points=[{"v": [10.0], "label": "a"}, {"v": [40.0], "label": "b"}], k=2))(f)
    return v.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), r6(F.element_at(tree, F.lit("a"))).alias("tree"), forest["label"].alias("forest"), line["label"].alias("linear"), near["label"].alias("near"))


query("nearest_neighbours", v.sql("SELECT id, label, round(w / total, 6) AS confidence FROM (SELECT *, sum(w) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS r FROM (SELECT id, label, sum(1 / (dist + 1e-6)) AS w FROM (SELECT s.s_suppkey AS id, p.label, abs(s.s_acctbal / 1000.0 - p.x) AS dist, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY abs(s.s_acctbal / 1000.0 - p.x), p.pid) AS k FROM supplier s, (SELECT CAST(c_nationkey AS BIGINT) AS pid, avg(c_acctbal) / 1000.0 AS x, max(c_mktsegment) AS label FROM customer GROUP BY 1) p) WHERE k <= 3 GROUP BY 1, 2)) WHERE r = 1"))(
    lambda spark, d: _nearest(spark, d)
)


def _nearest(spark, d) -> DataFrame:
    """Suppliers by the three nations whose customers' mean balance is nearest to theirs."""
    from strandwork.operators.models import k_nearest

    c, sup = v.table(spark, d, "customer"), v.table(spark, d, "supplier")
    points = c.groupBy(F.col("c_nationkey").cast("long").alias("pid")).agg(F.array(F.avg("c_acctbal") / 1000.0).alias("v"), F.max("c_mktsegment").alias("label"))
    return k_nearest(sup.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 1000.0).alias("v")), points, 3).withColumn("confidence", r6("confidence"))


query("binding_sites", v.sql("SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS site FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (SELECT doc_id, s, unnest(range(0, length(s))) AS p FROM v_prot) WHERE contains('AVILMFWP', substr(s, CAST(p + 1 AS INTEGER), 1))) WHERE r <= 10 GROUP BY doc_id", v.PROTEIN))(
    lambda spark, d: v.protein(spark, d).select("doc_id", F.array_join(F.transform(M.binding_site(F.col("s")), lambda i: i.cast("string")), ",").alias("site")).where("site <> ''")
)
query("residue_categories", v.sql(f"SELECT doc_id, {n_of('DE')} AS acidic, {n_of('KRH')} AS basic, {n_of('AVILMFWP')} AS hydrophobic, {n_of('FHWY')} AS aromatic FROM v_prot", v.PROTEIN))(
    lambda spark, d: v.protein(spark, d).select("doc_id", P.residue_counts(F.col("s")).alias("n")).select("doc_id", P.count_in(F.col("n"), "DE").alias("acidic"), P.count_in(F.col("n"), "KRH").alias("basic"), P.count_in(F.col("n"), T.HYDROPHOBIC).alias("hydrophobic"), P.count_in(F.col("n"), T.AROMATIC).alias("aromatic"))
)
