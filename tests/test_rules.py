"""Operators against plain Python: ranks, correlations, screening, reading frames, repeats, models, prompts, RNA."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import descriptors as D
from strandwork.functions import molecule as M
from strandwork.functions import sequence as S
from strandwork.functions import tables as T
from strandwork.operators import alignment as L
from strandwork.operators import expression as E
from strandwork.operators import models, predictors, prompts, similarity


def test_ranks_come_from_buckets(spark):
    r = random.Random(1)
    rows = [(i, g, float(r.randrange(40)) if g else r.random()) for g in (0, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "gene long, sample long, value double")
    for down in (False, True):
        got = {(x.gene, x.sample): (x.place, x.rank, x.size) for x in E._ranked(df, "sample", "value", ["gene"], down).collect()}
        for g in (0, 1):
            values = sorted(((v, i) for i, s, v in rows if s == g), key=lambda x: (-x[0] if down else x[0], x[1]))
            first = {}
            for place, (v, i) in enumerate(values, 1):
                assert got[i, g] == (place, first.setdefault(v, place), 400)
    p = spark.createDataFrame([(i, r.random()) for i in range(300)] + [(900, None)], "gene long, p double")
    adjusted = {x.gene: x.padj for x in E.benjamini_hochberg(p).collect()}
    order = sorted((x.p, x.gene) for x in p.collect() if x.p is not None)
    assert all(adjusted[g] == pytest.approx(min(1.0, q * 300 / k)) for k, (q, g) in enumerate(order, 1)) and adjusted[900] is None


def test_correlations_by_blocks(spark):
    r = np.random.default_rng(2)
    rows = [(g, s, float(r.integers(0, 50))) for g in range(30) for s in range(10) if r.random() < 0.8] + [(99, s, 5.0) for s in range(10)]
    df = spark.createDataFrame(rows, "gene long, sample long, value double")
    by = collections.defaultdict(dict)
    for g, s, v in rows:
        by[g][s] = v
    want = {}
    for a in by:
        for b in by:
            both = sorted(set(by[a]) & set(by[b]))
            if a < b and len(both) >= 3:
                x, y = np.array([by[a][s] for s in both]), np.array([by[b][s] for s in both])
                want[a, b] = (len(both), float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0)
    for block in (256, 7):
        got = {(x.a, x.b): (x.n, x.r) for x in E.correlations(df, 3, block).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    empty = df.where("gene < 0")
    assert E.correlations(empty).count() == 0


def test_screening_by_blocks(spark):
    r = random.Random(3)
    rows = [(i, sorted(r.sample(range(60), r.randrange(1, 30)))) for i in range(70)] + [(70, []), (71, None)]
    df = spark.createDataFrame(rows, "id long, bits array<int>")
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in rows if x and a % 10 == 0 for b, y in rows if y}
    for block in (1024, 16):
        got = {(x.query, x.id): x.tanimoto for x in similarity.screen(df.where("id % 10 = 0"), df, 0.3, block=block).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.3}
    best = similarity.screen(df.where("id = 0"), df, 0.0, 3).collect()
    assert sorted(x.rank for x in best) == [1, 2, 3] and {x.id for x in best if x.rank == 1} == {0}


def test_reading_frames_and_proteins(spark):
    s = "NNNATGCCCGGGAAATTTCCCGGGAAATTTCCCGGGTAANNN"
    df = spark.createDataFrame([(s,), ("ATGATGTAA",), ("",), (None,)], "s string")
    got = [r.o for r in df.select(S.orfs(F.col("s"), 9).alias("o")).collect()]
    assert [(x.frame, x.start, x.end, x.protein) for x in got[0]] == [(1, 3, 39, "MPGKFPGKFPG")]
    assert [(x.start, x.end, x.protein) for x in got[1]] == [(0, 9, "MM")]
    assert not got[2] and not got[3]
    with pytest.raises(Exception, match="unknown codon"):
        df.select(S.checked_translation(F.col("s"))).collect()
    frames = df.select(S.six_frames(F.col("s")).alias("f")).collect()[1].f
    assert {x.frame: x.protein for x in frames}["+1"] == "MM" and {x.frame: x.protein for x in frames}["-1"] == "LHH"


def test_lag_descriptors(spark):
    s = "MKALVLLYLLFSSAYSRGVFRRDTHKPPVYKKVEHPLS"
    row = spark.createDataFrame([(s,), ("AAAA",), ("",)], "s string").select(D.moran(F.col("s")).alias("m"), D.geary(F.col("s")).alias("g"), D.quasi_sequence_order(F.col("s")).alias("q"), D.pseudo_composition(F.col("s")).alias("p"), D.secondary_structure(F.col("s")).alias("ss")).collect()
    x = np.array([T.HYDROPHOBICITY[c] for c in s])
    y = x - x.mean()
    assert row[0].m["Moran_hydro_lag3"] == pytest.approx((y[:-3] * y[3:]).mean() / (y * y).mean())
    z, n = np.array([T.RESIDUE_MASS[c] for c in s]), len(s)
    assert row[0].g["Geary_MW_lag2"] == pytest.approx(n * ((z[:-2] - z[2:]) ** 2).sum() / (2 * (n - 2) * (n - 1) * z.var()))
    assert sum(row[0].q.values()) == pytest.approx(1.0) and sum(row[0].p.values()) == pytest.approx(1.0)
    assert row[1].m["Moran_hydro_lag1"] == 0.0 and row[2].m == {} and row[2].ss == ""
    assert len(row[0].ss) == n and set(row[0].ss) <= set("HETC")


def test_all_features_and_pairs(spark):
    df = spark.createDataFrame([("MKALVLLYLLFSSAYSRGVFRRDTHKPPVYK", "MKDDEEELLLWWYYHHKKRRSSTTGGAAPPQQNN")], "a string, b string")
    r = df.select(D.all_features(F.col("a")).alias("f"), D.conjunction(F.col("a"), F.col("b")).alias("c"), D.interaction(F.col("a"), F.col("b")).alias("i"), D.top_interface(F.col("a"), 3).alias("t")).first()
    assert len(r.f) > 400 and len(r.c) == 47 and len(r.t) == 3
    same = df.select(D.interaction(F.col("a"), F.col("a")).alias("i")).first().i
    assert same.dipeptide_similarity == pytest.approx(1.0) and same.hydrophobic_complementarity == 1.0 and same.charge_complementarity == 0.3


def test_models_from_json(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (None,)], "x double")
    f = {"x": F.col("x")}
    for text in (
        models.save("knn", ["x"], points=[{"v": [0.0], "label": "a"}, {"v": [10.0], "label": "b"}], k=1),
        models.save("naive_bayes", ["x"], classes={"a": (0.5, [0.0], [1.0]), "b": (0.5, [10.0], [1.0])}),
        models.save("linear", ["x"], classes={"a": {"bias": 5.0, "weights": [-1.0]}, "b": {"bias": -5.0, "weights": [1.0]}}),
    ):
        assert [r.p for r in df.select(models.load(text)(f)["label"].alias("p")).collect()][:2] == ["a", "b"]
    with pytest.raises(ValueError, match="unknown algorithm"):
        models.load('{"algorithm": "magic"}')


def test_predictors_return_every_class(spark):
    dna = spark.createDataFrame([("ATGGCGTATAAAAGGCCAATCGGGCGGATC" * 4,), ("ATG",)], "s string")
    r = dna.select(predictors.full_analysis("dna", F.col("s")).alias("x")).collect()
    assert set(r[0].x.promoter.probabilities) == {"promoter", "non-promoter"} and sum(r[0].x.splice.probabilities.values()) == pytest.approx(1.0)
    d = spark.createDataFrame([("CC(=O)Oc1ccccc1C(=O)O",)], "s string").select(M.descriptors(F.col("s")).alias("d"))
    x = d.select(predictors.full_analysis("molecule", F.col("d")).alias("x"), M.admet(F.col("d")).alias("a"), M.alerts(F.col("d")).alias("t"), M.verdict(F.col("d")).alias("v")).first()
    assert x.x.toxicity.label == "class_I_low" and x.a.half_life == "Short <2h" and x.t == []
    bands = spark.range(3).select(predictors.confidence_band(F.element_at(F.array(F.lit(0.8), F.lit(0.6), F.lit(0.2)), (F.col("id") + 1).cast("int"))).alias("b")).collect()
    assert [b.b for b in bands] == ["high", "medium", "low"]


def test_alerts(spark):
    rows = [("C=CC(=O)O", ["Michael Acceptor"]), ("FC(F)(F)C(F)F", ["Polyhalogenated"]), ("c1ccccc1C(N)C(=O)O", ["Potential Nitro Group"]), ("C" * 51, ["High Complexity"]), ("CCO", [])]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string")
    assert [r.a for r in df.select(M.alerts(M.descriptors(F.col("s"))).alias("a")).collect()] == [a for _, a in rows]


def test_prompts_and_answers(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    out = df.withColumn("prompt", prompts.prompt({"Id": F.col("id").cast("string"), "Name": F.col("name")}, "Why?"))
    assert [r.prompt for r in out.orderBy("id").collect()] == ["Id: 1\nName: x\n\nWhy?", "Id: 2\n\nWhy?"]

    def send(text):
        if "Name" not in text:
            raise TimeoutError("no answer")
        return text.upper()[:5]

    said = prompts.answer(out, send).orderBy("id").collect()
    assert (said[0].response, said[0].success, said[0].error) == ("ID: 1", True, None)
    assert (said[1].response, said[1].success, said[1].error) == (None, False, "TimeoutError: no answer")


def test_rna_pairs(spark):
    def plain(a, b, match, mismatch, gap):
        h, best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0.0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0.0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
                best = max(best, h[i][j])
        return best

    r = random.Random(4)
    rows = [tuple("".join(r.choice("ACGU") for _ in range(r.randrange(1, 30))) for _ in range(2)) for _ in range(30)] + [("", "A"), ("GGGGAAAACCCC", "GGGGUUUUCCCC")]
    got = spark.createDataFrame(rows, "a string, b string").select(L.rna_hybridize(F.col("a"), F.col("b")).alias("e"), L.kissing_loops(F.col("a"), F.col("b")).alias("k"), L.fold_column(F.col("a")).alias("f")).withColumn("stems", L.stems(F.col("f.structure"))).collect()
    pairs = str.maketrans("AUGC", "UACG")
    for (a, b), x in zip(rows, got):
        assert x.e == pytest.approx(-0.7 * plain(a, b.translate(pairs), 3.0, -2.0, -5.0))
        assert [(s.start, s.end) for s in x.stems] == [(m.start(), m.end()) for m in __import__("re").finditer(r"\(+", x.f.structure)]
        found = [{q for q in L.loops(t, L.fold(t)[0])} for t in (a, b)]
        assert x.k == max((plain(p, q.translate(pairs), 2.0, -1.0, -2.0) for p in found[0] for q in found[1]), default=0.0)
    assert got[-1].k > 0 and [(s.start, s.end) for s in got[-1].stems] == [(0, 4)]


def test_search_presets(spark):
    q = spark.createDataFrame([(1, "MKALVLLYLLFSSAYSRG")], "id long, s string")
    t = spark.createDataFrame([(10, "MKALVLLYLLFSSAYSRG"), (11, "WWWWWWWW"), (12, "GGMKALVLLYAAAA")], "id long, s string")
    hits = L.best_hits(L.blastp(q, t, evalue=1.0), 1).collect()
    assert [(h.query, h.subject) for h in hits] == [(1, 10)]
    matrix = L.dna_matrix()
    assert len(matrix) == 25 and matrix["A", "A"] == 2.0 and matrix["A", "N"] == -1.0
    text = spark.createDataFrame([("ATGC", "AGC")], "a string, b string").select(L.pretty(L.align_column(F.col("a"), F.col("b"))).alias("p")).first().p
    assert text.split("\n")[0] == "ATGC" and text.split("\n")[2].replace("-", "") == "AGC"
