import random
from fractions import Fraction

from pyspark.sql import functions as F

from strandwork.functions import protein as P
from strandwork.functions import tables as T
from strandwork.operators import predictors as R
from strandwork.operators.models import BUILT_IN, naive_bayes
from strandwork.plans import catalog
from strandwork.plans import views as v

ODD = ["", None, "A", "MKKLLDE", "ACé漢\U0001f600DE", "?????", "B" * 9, "WWYCDEHKR" * 400, "MKALVLLYLLFSSAYSRGVFRRDTHKPPVYKKVEH"]


def test_predictions_read_each_text_once(spark):
    plan = catalog.QUERIES["protein_predictions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "length(" not in plan  # a filter on the length stripped the text a second time
    assert "translate(" not in plan  # some 20 passes over the text for each of ten features
    assert plan.count("ArrowEvalPython [run(") == 1 and plan.count("run(") == 1


def test_predictions_equal_those_of_single_figures(spark):
    s = F.col("s")
    x = P.figures(s)
    share = F.coalesce(F.try_divide(P.count_of(s, "RKHDE").cast("double"), F.length(s)), F.lit(0.0))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), P.instability_index(s) / 100.0))
    features = {
        "enzyme": [x["gravy"], x["hydrophobic"], x["aliphatic"], P.isoelectric_point(s), x["aromaticity"], x["charge7"], x["weight"], unit],
        "membrane": [x["gravy"], x["hydrophobic"], share, x["aliphatic"], x["aromaticity"], P.isoelectric_point(s)],
    }
    df = spark.createDataFrame([(t,) for t in ODD], "s string")
    for model, columns in features.items():
        rows = df.select(F.array(*columns).alias("want"), F.array(*R.EXTRACTORS[model](s)).alias("got")).collect()
        for r in rows:
            assert [a is None for a in r.got] == [b is None for b in r.want]
            assert all(a is None or abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(r.got, r.want))
        each = df.select(R.predict(model, s).alias("p"), naive_bayes(columns, BUILT_IN[model][1]).alias("q")).collect()
        assert len(each) == len(ODD)
        for p, q in each:
            assert p.label == q.label
            assert p.confidence is q.confidence is None or abs(p.confidence - q.confidence) < 1e-9


def test_instability_is_exact_in_hundredths(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("ACDEFHIKLNPTW", k=2000)) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", P.instability_index(F.col("s")).alias("i"), P.batch_figures(F.col("s"))["instability"].alias("b")).collect()
    for s, i, b in got:
        total = sum((Fraction(str(T.INSTABILITY.get(s[k : k + 2], 1.0))) for k in range(len(s) - 1)), Fraction(0))
        assert i == b == float(10 * total) / len(s)  # as the SQL's sum of decimals; a sum of doubles missed a tie of the rounding


def test_proteins_of_least_length(spark, tmp_path):
    texts = [None, "", "  ", "BJOUXZ bjouxz", "acde", "a-c\ndée", "a-c\ndée f", "ſıİßK acde", "ſıİßK acdef", "B" * 50_000 + "acde", "acdef" + "\n" * 50_000, "1 2 " * 9_000 + "K L M N P"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    every = v.protein(spark, str(tmp_path)).collect()
    upper = [None if t is None else "".join(c for c in t if c in v.RESIDUE).upper() for t in texts]
    assert [r.s for r in sorted(every)] == upper
    assert sorted(map(tuple, v.protein(spark, str(tmp_path), least=5).collect())) == [(i, s) for i, s in enumerate(upper) if s is not None and len(s) > 4]
