"""What shows only on large tables or large keys."""

from strandwork.operators import expression
from strandwork.sources import formats


def test_gff_places_beyond_32_bits(spark):
    line = "chr1\tx\tCDS\t9000000100\t9000000120\t.\t+\t0\tID=a"
    df = formats.parse_gff3(spark.createDataFrame([(line,)], "value string"))
    assert [r.value for r in formats.gff3_text(df).collect()] == [line]


def test_enrichment_of_sets_larger_than_the_background(spark):
    sets = spark.createDataFrame([(i, "big" if i < 30 else "small") for i in range(34)], "gene long, set string")
    p = {r.set: r.p for r in expression.enrichment(sets, spark.createDataFrame([(0,), (31,)], "gene long"), 20).collect()}
    assert p["big"] == 1.0 and 0 < p["small"] < 1


def test_screen_of_kinds_equals_the_screen_of_rows(spark):
    import random

    from strandwork.operators.similarity import screen, screen_kinds

    r = random.Random(5)
    forms = [sorted(r.sample(range(12), r.randint(1, 6))) for _ in range(7)]
    fp = spark.createDataFrame([(i, r.choice(forms)) for i in range(120)], "id long, bits array<int>")
    q = fp.where("id % 10 = 0")
    for most in (1, 5, 20):
        want = {tuple(x) for x in screen(q, fp, 0.3).select("query", "id", "tanimoto").collect()}
        best = {(k, *y) for k in {x[0] for x in want} for y in [(i, t, n) for n, (t, i) in enumerate(sorted((-x[2], x[1]) for x in want if x[0] == k)[:most], 1)]}
        for f in (screen, screen_kinds):
            assert {(x.query, x.id, -x.tanimoto, x.rank) for x in f(q, fp, 0.3, most, block=16).collect()} == best


def test_binding_keeps_texts_out_of_the_join(spark, capsys):
    from strandwork.plans import catalog

    for name in ("drug_dna_binding", "drug_protein_binding"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").explain("simple")
        joined = capsys.readouterr().out
        assert "BroadcastHashJoin" in joined and "BuildRight" in joined  # the documents' figures, not the molecules


def test_molecules_are_dealt_to_tasks(spark):
    from strandwork.plans.catalog_molecule import smiles

    assert smiles(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_annotation_of_repeated_ids_shuffles_no_pairs(spark, capsys):
    import random

    from strandwork.operators.annotation import annotate

    r = random.Random(2)
    points = [(r.randint(0, 150), r.randint(0, 1), r.randint(1, 60000)) for _ in range(300)]
    spans = [(i, r.randint(0, 1), a, a + r.randint(0, 900), r.choice("+-")) for i, a in enumerate(r.sample(range(1, 60000), 30))]
    df = annotate(spark.createDataFrame(points, "id long, chrom int, pos long"), spark.createDataFrame(spans, "gene long, chrom int, st long, en long, strand string"))
    genic = [(i, c, x, g, "genic", 0) for i, c, x in points for g, d, a, b, _ in spans if c == d and a <= x <= b]
    held, best = {x[0] for x in genic}, {}
    for i, c, x in points:
        for g, d, a, b, s in spans:
            far = min(abs(a - x), abs(b - x))
            if i not in held and c == d and far <= 2000:
                best[i] = min(best.get(i, (9999,)), (far, g, c, x, "upstream" if (s == "+" and x < a) or (s == "-" and x > b) else "downstream"))
    assert sorted(tuple(x) for x in df.collect()) == sorted(genic + [(i, c, x, g, p, far) for i, (far, g, c, x, p) in best.items()])
    df.explain("simple")
    assert "Window" not in capsys.readouterr().out


def _expressed(spark, genes: int, samples: int, gone: float):
    import random

    r = random.Random(genes)
    rows = {g: {s: float(r.randint(0, 9)) for s in range(samples) if r.random() >= gone} for g in range(genes)}
    rows |= {g + 1000: rows[g] for g in range(0, genes, 3)}  # equal genes
    rows[5000] = dict.fromkeys(range(samples), 4.0)  # without variance
    return spark.createDataFrame([(g, s, x) for g, row in rows.items() for s, x in row.items()], "gene long, sample int, value double")


def test_edges_equal_all_correlations(spark):
    for genes, samples, gone in ((40, 6, 0.2), (90, 14, 0.5)):  # few classes of samples, and many
        df = _expressed(spark, genes, samples, gone)
        every = expression.correlations(df, 4).collect()
        want = sorted((x.a, x.b, x.n, round(x.r, 9)) for x in every if abs(x.r) >= 0.7)
        for block in (None, 16):
            assert sorted((x.a, x.b, x.n, round(x.r, 9)) for x in expression.edges(df, 0.7, 4, block).collect()) == want
        ranked = sorted(((-round(abs(x[3]), 9), x[0], x[1]) for x in want))
        for most in (3, 25):
            got = [(-round(abs(x.r), 9), x.a, x.b) for x in expression.top_edges(df, 0.7, most, 4, 16).collect()]
            assert got == ranked[:most]


def test_primers_of_long_texts_copy_no_text(spark):
    import random

    from strandwork.operators.motifs import primers

    r = random.Random(4)
    texts = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 30, 90, 700)]
    rows = [(i, s, a, b) for i, s in enumerate(texts) for a, b in ((len(s) // 3, 2 * len(s) // 3),)]
    df = primers(spark.createDataFrame(rows, "id long, s string, target_start int, target_end int"))
    want = set()
    for i, s, a, b in rows:
        for side, starts in (("forward", range(max(a - 50, 0), a + 1)), ("reverse", range(b, b + 51))):
            for x in starts:
                for size in range(18, 26):
                    if x + size <= len(s):
                        p = s[x : x + size]
                        p = p if side == "forward" else p.translate(str.maketrans("ACGT", "TGCA"))[::-1]
                        gc = sum(c in "GC" for c in p)
                        if 55 <= 64.9 + 41 * (gc - 16.4) / size <= 65 and 40 <= gc * 100 / size <= 60:
                            want.add((i, side, x, p))
    assert {(x.id, x.side, x.start, x.primer) for x in df.collect()} == want and want
    assert "substring(near" in df._jdf.queryExecution().optimizedPlan().toString()


def test_figures_of_texts_by_batch(spark):
    from pyspark.sql import functions as F

    from strandwork.functions import protein as P
    from strandwork.functions import tables as T

    texts = ["MKKLLDE", "A", "", None, "WWYCDEHKR" * 40]
    df = spark.createDataFrame([(x,) for x in texts], "s string").select("s", P.instability_index(F.col("s")).alias("i"), P.isoelectric_point(F.col("s")).alias("pi"))
    for s, i, pi in df.collect():
        want = 10.0 * sum(T.INSTABILITY.get(s[k : k + 2], 1.0) for k in range(len(s) - 1)) / len(s) if s else None
        assert i == want or abs(i - want) < 1e-9
        if s:
            q = 1 / (1 + 10 ** (pi - T.PKA_N_TERM)) - 1 / (1 + 10 ** (T.PKA_C_TERM - pi)) + sum(s.count(a) * (-1 / (1 + 10 ** (k - pi)) if a in "DECY" else 1 / (1 + 10 ** (pi - k))) for a, k in T.PKA.items())
            assert abs(q) < 1e-6
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from" not in plan and "aggregate(" not in plan  # no map of 400 pairs and no bisection per row


def test_named_features_compute_no_others(spark):
    from pyspark.sql import functions as F

    from strandwork.functions import descriptors as D

    df = spark.createDataFrame([("MKKLLDEAAWYRH" * 4,)], "s string")
    some = ["AAC_A", "PC_gravy", "CTD_charge_C3", "DPC_AA"]
    few = df.select(D.all_features(F.col("s"), some).alias("f"))
    every = df.select(D.all_features(F.col("s")).alias("f")).first().f
    assert {k: few.first().f[k] for k in some} == {k: every[k] for k in some}
    assert len(every) > 300 and len(few.first().f) < 150


def test_folding_is_remembered_and_dealt_to_tasks(spark):
    from strandwork.operators import alignment
    from strandwork.plans import catalog

    assert alignment.fold("GGGAAACCC")[:2] == ("(((...)))", 3)
    assert alignment.fold.cache_info().maxsize
    assert catalog.QUERIES["rna_interactions"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def _blocks_of(pos, known, strong=0.98, recomb=0.70, share=0.95):
    """The greedy blocks of one chromosome, from all its sites and the pairs known."""
    out, i = [], 0
    while i < len(pos):
        n = hard = soft = 0
        end = i
        for j in range(i + 1, len(pos)):
            found = [known.get((pos[a], pos[j])) for a in range(i, j)]
            if None in found:
                break
            n, hard, soft = n + len(found), hard + sum(x >= strong for x in found), soft + sum(x <= recomb for x in found)
            if hard < share * n or soft > (1 - share) * n:
                break
            end = j
        if end > i:
            out.append((pos[i], pos[end], end - i + 1))
        i = end + 1
    return out


def test_haplotype_blocks_of_runs_equal_those_of_chromosomes(spark):
    import random

    from strandwork.operators.variants import haplotype_blocks

    r = random.Random(11)
    sites, pairs, want = [], [], set()
    for chrom in ("a", "b", "c"):
        pos = sorted(r.sample(range(1, 4000), 160))
        dense = {"a": 0.3, "b": 0.9, "c": 1.0}[chrom]
        known = {(x, y): r.choice([1.0, 1.0, 1.0, 0.99, 0.6]) if dense < 1 else 1.0 for i, x in enumerate(pos) for y in pos[i + 1 :] if y - x <= 300 and r.random() < dense}
        sites += [(chrom, x) for x in pos]
        pairs += [(chrom, x, y, d) for (x, y), d in known.items()] + [(chrom, pos[3], pos[4] + 5000, 1.0), (chrom, pos[7], 4001, None), (chrom, pos[9], 4002, float("nan"))]
        near = {k: d for k, d in known.items() if k[1] - k[0] <= 200}
        want |= {(chrom, *x) for x in _blocks_of(pos, near)}
    got = haplotype_blocks(spark.createDataFrame(pairs, "chrom string, pos long, pos2 long, dprime double"), spark.createDataFrame([*sites, *sites[:5]], "chrom string, pos long"), span=200)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 40


def test_haplotype_blocks_deal_no_lone_site_to_python(spark, capsys):
    from strandwork.operators.variants import haplotype_blocks

    lone = spark.range(20_000).selectExpr("'a' AS chrom", "id * 7 AS pos")
    one = spark.createDataFrame([("a", 70, 77, 1.0)], "chrom string, pos long, pos2 long, dprime double")
    df = haplotype_blocks(one, lone)
    assert [tuple(x) for x in df.collect()] == [("a", 70, 77, 2)]
    df.explain("simple")
    assert "FlatMapGroupsInPandas" not in capsys.readouterr().out  # a site without pairs was a group of its own
