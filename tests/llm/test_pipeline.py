import random

import pytest

import corpus_pipeline
from strandwork.llm import queries
from strandwork.llm._store import cut


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted cases: toxic 0-19, a near copy 31 of 30, an exact copy 33 of 32, a passage in 40 and 41."""
    r = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(90)) for _ in range(160)]
    for i in range(20):
        texts[i] = texts[i].replace(" ", " idiot ", 2)
    texts[31] = texts[30].rsplit(" ", 1)[0] + " other"
    texts[33] = texts[32]
    passage = " ".join(words[:60])
    texts[40], texts[41] = f"{texts[40]} {passage}", f"{passage} {texts[41]}"
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 20)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), passage


def test_stages_take_effect(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = cut(stages["toxicity"](spark, docs, path), "t")
    assert {r.doc_id for r in kept.collect()} == set(range(20, 160))
    single = cut(stages["near_duplicates"](spark, kept, path), "n")
    assert {r.doc_id for r in single.collect()} == set(range(20, 160)) - {31, 33}
    cleaned = cut(stages["substring_dedup"](spark, single, path), "s")
    by = {r.doc_id: r for r in cleaned.collect()}
    assert passage not in by[40].text and passage not in by[41].text and by[40].n_chars == len(by[40].text)
    assert by[50].text == {r.doc_id: r.text for r in docs.collect()}[50]
    mixed = cut(stages["mixing"](spark, cleaned, path), "m")
    assert mixed.columns == docs.columns
    size = sum(len(r.text.split()) for r in mixed.collect())
    assert size == pytest.approx(sum(len(r.text.split()) for r in by.values()), rel=0.25)
    packed = stages["packing"](spark, mixed, path)
    assert packed.where("offset + length > 1024").count() == 0 and packed.where("piece = 0").count() == mixed.count()


def test_names_and_sql():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "mixing", "packing"]
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 11))
