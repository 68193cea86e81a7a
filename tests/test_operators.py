import random

import pytest
from pyspark.sql import functions as F

from strandwork.functions import molecule as M
from strandwork.operators import alignment, annotation, expression, models, phylogeny, popgen, similarity, variants
from strandwork.operators.relational import interval_join, islands, nearest_join


def test_interval_and_nearest_join(spark):
    r = random.Random(1)
    points = [(i, r.randint(0, 1), r.randint(1, 20000)) for i in range(150)]
    spans = [(i, r.randint(0, 1), a, a + r.randint(0, 3000)) for i, a in enumerate(r.sample(range(1, 20000), 40))]
    p = spark.createDataFrame(points, "id long, chrom int, pos long")
    g = spark.createDataFrame(spans, "gene long, chrom int, st long, en long")
    got = {(x.id, x.gene) for x in interval_join(p, g, "pos", "st", "en", ["chrom"], 512).collect()}
    assert got == {(i, k) for i, c, x in points for k, d, a, b in spans if c == d and a <= x <= b}
    near = {x.id: (x.distance, x.gene) for x in nearest_join(p, g, "pos", "st", "en", ["chrom"], 700, ["id"], "gene").collect()}
    want = {}
    for i, c, x in points:
        d = [(min(abs(a - x), abs(b - x)), k) for k, e, a, b in spans if e == c and min(abs(a - x), abs(b - x)) <= 700]
        if d:
            want[i] = min(d)
    assert near == want


def test_islands(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 5, 9), ("a", 11, 12), ("b", 1, 2)], "g string, x long, y long")
    assert sorted(tuple(r) for r in islands(df, ["g"], "x", "y").collect()) == [("a", 1, 9, 2), ("a", 11, 12, 1), ("b", 1, 2, 1)]


def test_annotation_places(spark):
    v = spark.createDataFrame([(1, 1, 150), (2, 1, 90), (3, 1, 9000)], "id long, chrom int, pos long")
    g = spark.createDataFrame([(7, 1, 100, 200, "+")], "gene long, chrom int, st long, en long, strand string")
    got = {(r.id, r.gene, r.place, r.distance) for r in annotation.annotate(v, g).collect()}
    assert got == {(1, 7, "genic", 0), (2, 7, "upstream", 10)}


def test_genotype_functions(spark):
    df = spark.createDataFrame([("0/1",), ("1|1",), ("./.",), ("0/.",)], "gt string")
    assert [r[0] for r in df.select(variants.dosage(F.col("gt"))).collect()] == [1, 2, None, 0]


def test_alignments():
    assert alignment.align("ATGC", "ATGC")[3] == 1.0
    assert alignment.align("ATGC", "AGC")[4] == 1
    assert alignment.align("XXXATGCXXX", "ATGC", "local")[2] == 8
    x, y, *_ = alignment.align("ATCGATCG", "ATCG")
    assert "-" in y and x.replace("-", "") == "ATCGATCG"


def test_alignment_score_is_realised():
    r = random.Random(3)
    for _ in range(30):
        a, b = ("".join(r.choice("ACGT") for _ in range(r.randint(1, 9))) for _ in range(2))
        x, y, score, *_ = alignment.align(a, b)
        total, gap = 0.0, None
        for p, q in zip(x, y):
            kind = "x" if p == "-" else "y" if q == "-" else None
            total += (2 if p == q else -1) if kind is None else (-0.5 if gap == kind else -2)
            gap = kind
        assert total == pytest.approx(score)


def test_fold_pairs_match():
    structure, pairs, _ = alignment.fold("GGGAAAUCCC")
    assert pairs == 3 and structure.count("(") == structure.count(")") == 3


def test_multiple_alignment_and_search(spark):
    rows = spark.createDataFrame([("f", 1, "ATGCATGC"), ("f", 2, "ATGATGC"), ("f", 3, "ATGCATGG")], "family string, id long, s string")
    out = alignment.multiple_alignment(rows).collect()
    assert len({len(r.aligned) for r in out}) == 1 and {r.aligned.replace("-", "") for r in out} == {"ATGCATGC", "ATGATGC", "ATGCATGG"}
    db = spark.createDataFrame([("a", "ACGTACGTTGCAAGCT" * 3), ("b", "TTTTGGGGCCCCAAAA" * 3)], "id string, s string")
    q = spark.createDataFrame([("q", "ACGTACGTTGCAAGCTACGT")], "id string, s string")
    hits = alignment.search(q, db).collect()
    assert [h.subject for h in hits] == ["a"] and hits[0].score == 40.0


def test_trees(spark):
    import numpy as np

    d = np.array([[0, 0.1, 0.2], [0.1, 0, 0.2], [0.2, 0.2, 0]])
    text = phylogeny.to_newick(phylogeny.upgma(list("ABC"), d))
    assert phylogeny.to_newick(phylogeny.from_newick(text)) == text
    nodes = spark.createDataFrame(phylogeny.upgma(list("ABC"), d), "node int, parent int, name string, length double")
    rows = phylogeny.leaves_and_depths(spark, nodes).collect()
    assert {r.name for r in rows if r.is_leaf} == set("ABC") and max(r.depth for r in rows) == 2


def test_student_p():
    assert expression._p(2.0, 10.0) == pytest.approx(0.0733880, abs=1e-6)
    assert expression._p(0.0, 5.0) == pytest.approx(1.0)


def test_population_statistics(spark):
    seqs = ["ATGCA", "ATGCA", "TTGCA", "ATGGA"]
    got = popgen.tajimas_d(spark.createDataFrame(list(enumerate(seqs)), "id long, s string")).first()
    n, length = 4, 5
    diffs = sum(sum(x != y for x, y in zip(seqs[i], seqs[j])) for i in range(n) for j in range(i))
    assert got.segregating == 2 and got.pi == pytest.approx(2 * diffs / (n * (n - 1)) / length)


def test_molecules():
    assert M.describe("CC(=O)Oc1ccccc1C(=O)O")[0] == "C9H8O4"
    assert M.describe("CC(C)Cc1ccc(cc1)C(C)C(=O)O")[:2] == ("C13H18O2", pytest.approx(206.285))
    assert M.describe("Cn1cnc2c1c(=O)n(C)c(=O)n2C")[0] == "C8H10N4O2"
    assert M.describe("C1CCCCC1")[6] == 0


def test_similarity(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4]), (3, [])], "id long, bits array<int>")
    q = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert [round(r[0], 6) for r in df.orderBy("id").select(similarity.tanimoto(F.col("bits"), q)).collect()] == [1.0, 0.5, 0.0]
    assert [r.id for r in similarity.max_min_pick(df, 2).orderBy("rank").collect()] == [1, 3]


def test_models(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    nb = models.naive_bayes([F.col("x")], {"low": (0.5, [0.0], [1.0]), "high": (0.5, [2.0], [1.0])})
    assert [r[0] for r in df.select(nb["label"]).collect()] == ["low", "high"]
    forest = models.load('{"algorithm": "rf", "labels": ["a", "b"], "trees": [{"feature": "x", "threshold": 1, "left": {"probabilities": {"a": 1}}, "right": {"probabilities": {"b": 1}}}]}')
    assert [r[0] for r in df.select(forest({"x": F.col("x")})["label"]).collect()] == ["a", "b"]
