import corpus_pipeline
from strandwork.llm import ngram_join


def test_ids_over_the_whole_range(spark):
    big, top = 1 << 62, (1 << 63) - 1
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(big, base), (big + 7, base + " end"), (top, "one of its kind"), (-big - 9, "another text of its own"), (None, "without an id"), (None, "without an id"), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((g.doc_id, g.class_id, g.n_links) for g in ngram_join.near_duplicates(df).collect()), key=str)
    want = [(big, big, 2), (big + 7, big, 2), (top, top, 0), (-big - 9, -big - 9, 0), (None, None, 1), (None, None, 1), (None, big, 2)]
    assert got == sorted(want, key=str)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, df, "")
    assert {r.doc_id for r in kept.collect()} == {big, top, -big - 9, None}


def test_components_of_few_edges_are_settled_in_one_task(spark):
    import random

    from strandwork.llm._graph import components

    r = random.Random(4)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(7, 7), (900, 901), (901, 902)], "a long, b long").repartition(5)
    jobs = {}
    for small in (0, 1 << 20):
        spark.sparkContext.setJobGroup(f"components-{small}", "")
        jobs[small] = sorted(map(tuple, components(edges, small).collect())), len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{small}"))
    assert jobs[0][0] == jobs[1 << 20][0] and len(jobs[0][0]) > 100
    assert jobs[1 << 20][1] * 4 < jobs[0][1]
    assert components(edges.where("a = b"), 1 << 20).count() == 0


def test_near_duplicates_join_classes_not_paths(spark, monkeypatch):
    from strandwork.llm import ngram_join

    plans, cut = [], ngram_join.cut

    def seen(df, what):
        plans.append((what, df._jdf.queryExecution().optimizedPlan().toString()))
        return cut(df, what)

    monkeypatch.setattr(ngram_join, "cut", seen)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(6)] + [(10 + i, f"some other text of its own, number {i}") for i in range(6)]
    spark.sparkContext.setJobGroup("near", "")
    got = {x.doc_id: x.class_id for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(6)} == {0} and all(got[10 + i] == 10 + i for i in range(6))
    buckets = [p for what, p in plans if what == "buckets"]
    assert len(buckets) > 1 and not any("LeftOuter" in p for p in buckets)  # a run put the component to every path, four rows a class
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near")) < 150
