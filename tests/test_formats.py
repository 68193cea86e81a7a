import pytest

from strandwork.sources import formats as f


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">seq1 some words\nATGC\natgc\n>seq2\nGCTAGCTA\n")
    rows = {r.id: r for r in f.read_fasta(spark, path).collect()}
    assert rows["seq1"].sequence == "ATGCATGC" and rows["seq1"].description == "some words" and rows["seq2"].kind == "dna"
    f.write_text(f.fasta_text(f.read_fasta(spark, path)).coalesce(1), str(tmp_path / "out"))
    assert {r.id: r.sequence for r in f.read_fasta(spark, str(tmp_path / "out")).collect()} == {"seq1": "ATGCATGC", "seq2": "GCTAGCTA"}


def test_fastq(spark, tmp_path):
    df = f.read_fastq(spark, put(tmp_path, "a.fq", "@seq1 d\nATGCATGC\n+\nIIIIIIII\n"))
    r = df.first()
    assert r.sequence == "ATGCATGC" and set(r.quality) == {40}
    assert f.fastq_text(df).first().value == "@seq1 d\nATGCATGC\n+\nIIIIIIII"


def test_genbank_and_stockholm(spark, tmp_path):
    text = "LOCUS       AB1  12 bp DNA\nDEFINITION  A gene.\nACCESSION   AB1\nFEATURES             Location/Qualifiers\n     gene            complement(2..9)\n                     /gene=\"x\"\nORIGIN\n        1 atgcatgcat gc\n//\n"
    r = f.read_genbank(spark, put(tmp_path, "a.gb", text)).first()
    assert (r.id, r.sequence, r.features[0].start, r.features[0].strand, r.features[0].qualifiers["gene"]) == ("AB1", "ATGCATGCATGC", 1, -1, ["x"])
    s = {x.id: x.sequence for x in f.read_stockholm(spark, put(tmp_path, "a.sto", "# STOCKHOLM 1.0\na  AT-G\nb  ATCG\n\na  CC\nb  C-\n//\n")).collect()}
    assert s == {"a": "ATGCC", "b": "ATCGC"}


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t10\t.\ta\tT,G\t.\tPASS\tDP=5;DB\tGT:DP\t0/1:7\t./.\nchr1\tbad\n"


def test_vcf(spark, tmp_path):
    df = f.read_vcf(spark, put(tmp_path, "a.vcf", VCF))
    rows = {r["sample"]: r for r in df.collect()}
    assert rows["s1"].ref == "A" and rows["s1"].alt == ["T", "G"] and rows["s1"].qual is None and rows["s1"].info == {"DP": "5", "DB": "true"} and rows["s1"].fields["DP"] == "7"
    assert rows["s2"].gt == "./."
    assert f.vcf_text(df, ["s1", "s2"]).first().value == "chr1\t10\t.\tA\tT,G\t.\tPASS\tDP=5;DB\tGT\t0/1\t./."


def test_gff_and_gtf(spark, tmp_path):
    df = f.read_gff3(spark, put(tmp_path, "a.gff3", "##gff-version 3\nchr1\tx\tgene\t1\t9\t.\t+\t.\tID=g1;Note=a%3Bb,c\n"))
    assert df.first().attributes == {"ID": ["g1"], "Note": ["a;b", "c"]}
    assert f.gff3_text(df).first().value.endswith("ID=g1;Note=a%3Bb,c")
    g = f.read_gtf(spark, put(tmp_path, "a.gtf", 'chr1\tx\texon\t1\t9\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\n')).first()
    assert g.attributes == {"gene_id": ["g1"], "transcript_id": ["t1"], "ID": ["t1"], "Parent": ["t1"]}


def test_expression_csv(spark, tmp_path):
    df = f.read_expression_csv(spark, put(tmp_path, "a.csv", "GeneID,s1,s2\ng1,1.5,x\ng2,,3\n"))
    assert {(r.gene, r.sample): r.value for r in df.collect()} == {("g1", "s1"): 1.5, ("g1", "s2"): 0.0, ("g2", "s1"): 0.0, ("g2", "s2"): 3.0}


def test_dispatch_and_conversion(spark, tmp_path):
    from strandwork.sources import formats as S

    records = S.parse_string(spark, ">a first one\nACGT\nAC\n;note\n>b\nggg\n", "fasta")
    assert [tuple(r) for r in records.orderBy("id").collect()] == [("a", "first one", "ACGTAC", "dna"), ("b", "", "GGG", "dna")]
    S.write(records, str(tmp_path / "x.fa"), "fa")
    assert S.parse(spark, str(tmp_path / "x.fa"), "fasta").count() == 2
    assert S.convert(spark, str(tmp_path / "x.fa"), "fasta", str(tmp_path / "x.fq"), "fastq") == 2
    assert {(r.id, r.sequence, tuple(r.quality)) for r in S.parse(spark, str(tmp_path / "x.fq"), "fq").collect()} == {("a", "ACGTAC", (40,) * 6), ("b", "GGG", (40,) * 3)}
    assert S.to_string(records.where("id = 'b'"), "fasta") == ">b\nGGG\n"
    with pytest.raises(ValueError, match="unknown format"):
        S.parse(spark, "x", "docx")
    with pytest.raises(ValueError, match="cannot be written"):
        S.record_text(records, "genbank")
    with pytest.raises(ValueError, match="more than one"):
        S.read_one(spark, str(tmp_path / "x.fa"), "fasta")
    assert S.parse_string(spark, "# STOCKHOLM 1.0\nx AC-G\ny A..T\nx TT\n//", "stockholm").where("id = 'x'").first().sequence == "ACGTT"


def test_fastq_of_many_splits(spark, tmp_path):
    from strandwork.sources import formats as S

    rows = [(f"r{i}", "ACGTACGTAC", "@@IIIIIII+") for i in range(500)]
    (tmp_path / "a.fastq").write_text("".join(f"@{i} d\n{s}\n+\n{q}\n" for i, s, q in rows) + "@last\nAC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = S.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.id for r in got) == sorted(i for i, _, _ in rows) and all(r.quality[:2] == [31, 31] and r.sequence == "ACGTACGTAC" for r in got)


VCF_TEXT = "##fileformat=VCFv4.2\n##contig=<ID=chr01,length=500>\n##FILTER=<ID=q10,Description=\"low\">\n##source=x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\nchr01\t5\t.\ta\tg\t9\tPASS\tDP=3;DB\tGT:DP\t0/1:4\t1|1:5\nchr01\t90\tx\tA\tAT\t.\tq10\t.\tGT\t./.\t0/0\nchr02\t7\ty\tC\tT\t1\t.\t.\tGT\t./.\t./.\nshort\t1\n"


def test_vcf_limits_meta_and_writing(spark, tmp_path):
    from strandwork.sources import formats as S

    (tmp_path / "v.vcf").write_text(VCF_TEXT)
    path = str(tmp_path / "v.vcf")
    count = lambda **k: S.read_vcf(spark, path, **k).select("pos").distinct().count()
    assert count() == 3 and count(passed=True) == 2 and count(snps=True) == 2 and count(max_missing=0.5) == 2 and count(min_maf=0.2) == 1
    assert count(chrom="chr01", start=1, end=50) == 1
    meta = {(r.section, r.id, r.value) for r in S.vcf_meta(spark.read.text(path)).collect()}
    assert meta == {("meta", "fileformat", "VCFv4.2"), ("contig", "chr01", "500"), ("FILTER", "q10", "low"), ("meta", "source", "x")}
    S.write_vcf(S.read_vcf(spark, path), str(tmp_path / "out"), ["a", "b", "c"], {"source": "y"}, {"chr01": 500})
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    lines = text.splitlines()
    assert lines[0] == "##fileformat=VCFv4.2" and lines[3].startswith("#CHROM") and lines[4].endswith("GT\t0/1\t1|1\t./.")
    assert S.vcf_samples(spark.read.text(str(tmp_path / "out"))) == ["a", "b", "c"]


def test_gtf_ids(spark):
    from strandwork.sources import formats as S

    rows = [("gene", 'gene_id "g1";'), ("transcript", 'gene_id "g1"; transcript_id "t1";'), ("exon", 'gene_id "g1"; transcript_id "t1"; exon_number "1";')]
    lines = spark.createDataFrame([("\t".join(["c", "s", t, "1", "9", ".", "+", ".", a]),) for t, a in rows], "value string")
    got = {r.type: (r.attributes["ID"], r.attributes.get("Parent")) for r in S.parse_gtf(lines).collect()}
    assert got == {"gene": (["g1"], None), "transcript": (["t1"], ["g1"]), "exon": (["t1"], ["t1"])}
    assert S.location_parts("join(1..5,<8..>9,12)") == [(0, 5), (7, 9), (11, 12)]
