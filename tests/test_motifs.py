from strandwork.functions import tables as T
from strandwork.operators import motifs


def test_microsatellites_match_scan(spark):
    s = "TTACACACACACACACGG" + "A" * 12 + "GATGATGATGATGATC"
    want = []
    for k, least in T.SSR_LEAST.items():
        i = 0
        while i <= len(s) - k * least:
            n = 1
            while s[i + n * k : i + (n + 1) * k] == s[i : i + k]:
                n += 1
            if n >= least:
                want.append((i + 1, i + n * k, s[i : i + k], n))
                i += n * k
            else:
                i += 1
    got = motifs.microsatellites(spark.createDataFrame([(1, s), (2, None)], "id long, s string")).collect()
    assert sorted((r.start, r.end, r.motif, r.repeats) for r in got) == sorted(want)


def test_cis_elements(spark):
    df = spark.createDataFrame([(1, "AACACGTGAATTGACTAA")], "id long, s string")
    got = {(r.element, r.pos, r.strand) for r in motifs.cis_elements(df, {"G-box": "CACGTG", "W-box": "TTGACY"}).collect()}
    assert got == {("G-box", 3, "+"), ("G-box", 3, "-"), ("W-box", 11, "+")}


def test_te_classes_and_primers(spark):
    df = spark.createDataFrame([(1, "MUTATOR-7", "ACGT"), (2, "x", "CACTTTTTTTTTTT"), (3, "y", "ACGTTGCATCGA")], "id long, name string, s string")
    got = {r.id: r.family for r in motifs.te_classes(df).collect()}
    assert got == {1: "MUTATOR", 2: "CACTA", 3: None}
    t = spark.createDataFrame([(1, "ACGTTGCATCGAGGCTAGCTAGCTAACGGATCGATCGGCTAGCATCGATCGATTACG" * 3, 60, 100)], "id long, s string, target_start int, target_end int")
    rows = motifs.primers(t).collect()
    assert rows and all(18 <= len(r.primer) <= 25 and 55 <= r.tm <= 65 and 40 <= r.gc <= 60 for r in rows)
