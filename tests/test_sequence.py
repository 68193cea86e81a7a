import itertools

import pytest
from pyspark.sql import functions as F

from strandwork.functions import protein as P
from strandwork.functions import sequence as S
from strandwork.functions import tables as T


def values(spark, text, **columns):
    return spark.createDataFrame([(text,)], "s string").select(*(c.alias(n) for n, c in columns.items())).first()


def test_basic_sequence_functions(spark):
    s = F.col("s")
    r = values(spark, "ATGCATGC", gc=S.gc_content(s), rc=S.reverse_complement(s), rna=S.transcribe(s), hits=S.find_motif(s, "ATG"), n=S.count_of(s, "A"))
    assert (r.gc, r.rc, r.rna, r.hits, r.n) == (50.0, "GCATGCAT", "AUGCAUGC", [0, 4], 2)
    assert values(spark, "ATGATGATG", h=S.find_motif(s, "ATG")).h == [0, 3, 6]
    assert values(spark, "TTAATTAATTAA", h=S.find_motif(s, "TTAATTAA")).h == [0, 4]
    assert values(spark, "ATGX", ok=S.is_valid(s, "DNA")).ok is False


def test_translation(spark):
    s = F.col("s")
    assert values(spark, "ATGGCCATTGTAATGGGCCGCTGAAAGGGTGCCCGATAG", p=S.translate(s)).p == "MAIVMGR"
    assert values(spark, "NNNATGGCCATTTGA", p=S.translate_from_start(s)).p == "MAI"
    assert T.codon_table(2)["TGA"] == "W" and T.codon_table()["TGA"] == "*"
    assert len(values(spark, "ATGCCCGGG", x=S.six_frames(s)).x) == 6


def test_digest_and_windows_match_brute_force(spark):
    s, text = F.col("s"), "GAATTCATGCGGATCCTTAATTAATTAAGCGGCCGCTTTTAAAA"
    got = {(x.enzyme, x.pos, x.cut) for x in values(spark, text, d=S.digest(s)).d}
    want = {(n, i, i + cut) for n, (site, cut) in T.ENZYMES.items() for i in range(len(text)) if text.startswith(site, i)}
    assert got == want
    fragments = values(spark, "GAATTCATGCGGATCC", f=S.virtual_digest(s, ["EcoRI", "BamHI"])).f
    assert [len(x) for x in fragments] == [1, 10, 5]
    skew = values(spark, "GGGCCCATGC" * 15, w=S.gc_skew(s, 100, 10)).w
    assert [x.pos for x in skew] == [0, 10, 20, 30, 40, 50]
    assert values(spark, "ACGTACGTAC", k=S.kmers(s, 4)).k == ["ACGTACGTAC"[i : i + 4] for i in range(7)]


def test_complexity(spark):
    text = "ACGTACGGTTACGA"
    n = len(text)
    seen = sum(len({text[i : i + k] for i in range(n - k + 1)}) for k in range(1, 9))
    could = sum(min(4**k, n - k + 1) for k in range(1, 9))
    assert values(spark, text, c=S.linguistic_complexity(F.col("s"))).c == pytest.approx(seen / could)


def test_ambiguity(spark):
    s = F.col("s")
    assert sorted(values(spark, "RN", x=S.expand_ambiguous(s)).x) == sorted("".join(p) for p in itertools.product("AG", "ATGC"))
    assert values(spark, "", x=S.ambiguity_code(F.array(F.lit("A"), F.lit("G")))).x == "R"


PROTEIN = "MKALVLLYLLFSSAYSRGVFRRDTHKPPVYKKVEHPLSPSTVQQLLQNLEKAMVRRAAGSPVHILFLGKAMACDEFGHIKLMNPQRSTVWYMAIVMGRPKLLYCSNG"


def test_recorded_protein_figures(spark):
    s = F.col("s")
    r = values(spark, PROTEIN, mw=P.molecular_weight(s), pi=P.isoelectric_point(s), gravy=P.gravy(s), inst=P.instability_index(s), ali=P.aliphatic_index(s), boman=P.boman(s), c7=P.charge_at(s, 7.0), ext=P.extinction_coefficient(s), top=P.interface_residues(s), ctd=P.ctd(s))
    assert r.mw == pytest.approx(12147.64, abs=0.01)
    assert r.pi == pytest.approx(10.4127, abs=1e-4)
    assert r.gravy == pytest.approx(-0.00467, abs=1e-5)
    assert r.inst == pytest.approx(12.426, abs=1e-3)
    assert r.ali == pytest.approx(93.832, abs=1e-3)
    assert r.boman == pytest.approx(1.0603, abs=1e-4)
    assert r.c7 == pytest.approx(10.1762, abs=1e-4)
    assert r.ext == 13200
    best = sorted(r.top, key=lambda x: -x.score)[:3]
    assert [(x.pos, round(x.score, 4)) for x in best] == [(92, 1.1614), (88, 1.1600), (22, 1.1414)]
    assert len(r.ctd) == 95


def test_null_and_empty(spark):
    df = spark.createDataFrame([("",), (None,)], "s string")
    s = F.col("s")
    rows = df.select(S.gc_content(s), S.find_motif(s, "A"), S.kmers(s, 3), P.gravy(s), P.instability_index(s), S.linguistic_complexity(s)).collect()
    assert rows[0][0] == 0.0 and rows[0][2] == []
