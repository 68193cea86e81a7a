"""Readers and writers of life-science text formats. Readers stream Spark's text splits; only record grouping needs Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.functions.sequence import infer_kind, let
from strandwork.operators.variants import alleles, is_missing, is_snp


FORMATS = {"fasta": "fasta", "fa": "fasta", "fastq": "fastq", "fq": "fastq", "genbank": "genbank", "gb": "genbank", "stockholm": "stockholm", "sto": "stockholm"}


def _known(form: str) -> str:
    if form.lower() not in FORMATS:
        raise ValueError(f"unknown format {form}")
    return FORMATS[form.lower()]


def parse(spark: SparkSession, path: str, form: str) -> DataFrame:
    """The records of a file of a named format."""
    return {"fasta": read_fasta, "fastq": read_fastq, "genbank": read_genbank, "stockholm": read_stockholm}[_known(form)](spark, path)


def read_one(spark: SparkSession, path: str, form: str):
    """The only record of a file, as a row; an error unless there is exactly one."""
    rows = parse(spark, path, form).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} record in {path}")
    return rows[0]


def record_text(df: DataFrame, form: str) -> DataFrame:
    """The text of each record (value), for the formats that can be written."""
    writers = {"fasta": fasta_text, "fastq": fastq_text}
    if _known(form) not in writers:
        raise ValueError(f"{form} cannot be written")
    return writers[_known(form)](df)


def write(df: DataFrame, path: str, form: str) -> None:
    record_text(df, form).write.text(path)


def to_string(df: DataFrame, form: str) -> str:
    """All records as one text on the driver, in order of id: for few records."""
    return "".join(r["value"] + "\n" for r in df.transform(lambda x: record_text(x.orderBy("id"), form)).collect())


def convert(spark: SparkSession, path: str, form: str, to: str, to_form: str) -> int:
    """Reads records, writes them in another format and returns how many there are."""
    records = parse(spark, path, form)
    write(records, to, to_form)
    return records.count()


def fasta_records(text: Column) -> Column:
    """Structs of id, description, sequence and kind from a whole FASTA text in a column."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r", ""), r"(?m)^[ \t]+", "")
    parts = F.filter(F.split(F.concat(F.lit("\n"), clean), "\n>"), lambda p: F.trim(p) != "")

    def one(p: Column) -> Column:
        head = F.split_part(p, F.lit("\n"), F.lit(1))
        body = F.upper(F.regexp_replace(F.regexp_replace(F.substring(p, F.length(head) + 1, F.length(p)), r"(?m)^;.*$", ""), r"\s", ""))
        return F.struct(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), body.alias("sequence"), infer_kind(body).alias("kind"))

    return F.filter(F.transform(parts, one), lambda x: (x["id"] != "") & ~x["id"].startswith(";"))


def fastq_texts(text: Column) -> Column:
    """Structs of id, description, sequence and quality from a whole FASTQ text in a column."""

    def of(lines: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.floor(F.size(lines) / 4).cast("int") - 1, F.lit(0)))
        line = lambda i, k: F.get(lines, i * 4 + k)
        scores = lambda q: F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
        head = lambda i: F.substring(line(i, 0), F.lit(2), F.length(line(i, 0)))
        one = lambda i: F.struct(F.split_part(head(i), F.lit(" "), F.lit(1)).alias("id"), F.trim(F.regexp_replace(head(i), r"^\S+", "")).alias("description"), F.upper(line(i, 1)).alias("sequence"), scores(line(i, 3)).alias("quality"))
        return F.when(F.size(lines) >= 4, F.transform(F.filter(firsts, lambda i: line(i, 0).startswith("@")), one)).otherwise(F.array().cast("array<struct<id:string,description:string,sequence:string,quality:array<int>>>"))

    return let(F.split(F.regexp_replace(F.trim(text), "\r", ""), "\n"), of)


def parse_string(spark: SparkSession, text: str, form: str) -> DataFrame:
    """The records of a text of a named format."""
    one = spark.createDataFrame([(text,)], "t string")
    if _known(form) == "fasta":
        return one.select(F.explode(fasta_records(F.col("t"))).alias("r")).select("r.*")
    if _known(form) == "fastq":
        return one.select(F.explode(fastq_texts(F.col("t"))).alias("r")).select("r.*")
    if _known(form) == "genbank":
        return spark.createDataFrame([r for t in text.split("\n//") if (r := parse_genbank(t))], GENBANK)
    return stockholm_records(one.select(F.posexplode(F.split("t", "\n")).alias("at", "value")))


def merge_records(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """A keyed store of records after new ones came: a new record replaces the old one of its id."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def _lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence, kind): records split at '>' line starts, ';' lines are comments."""
    r = _lines(spark, path, "\n>").select(F.regexp_replace("value", r"^>|\r", "").alias("v")).where(F.trim("v") != "")
    head = F.split_part("v", F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.regexp_replace(F.expr("substring(v, length(split_part(v, '\n', 1)) + 1)"), r"(?m)^;.*$", ""), r"\s", "")
    r = r.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), F.upper(body).alias("sequence"))
    return r.where("id <> ''").withColumn("kind", infer_kind(F.col("sequence")))


def fasta_text(df: DataFrame, width: int = 80) -> DataFrame:
    wrapped = F.array_join(F.regexp_extract_all("sequence", F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")
    return df.select(F.concat(F.lit(">"), F.trim(F.concat_ws(" ", "id", "description")), F.lit("\n"), wrapped).alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value): the lines of each file with their 0-based numbers, whatever the splits it is read in.

    A line's place in its block comes from the scan, the lines before the block from counts per block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    own = lines.withColumn("own", F.col("id") - F.min("id").over(Window.partitionBy("file", "block")))
    return own.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("own")).alias("n"), "value")


def fastq_records(lines: DataFrame) -> DataFrame:
    """(id, description, sequence, quality) from numbered lines (file, n, value): groups of four, an incomplete last group is left out."""
    at = lambda k: F.max(F.when(F.col("n") % 4 == k, F.regexp_replace("value", "\r$", "")))
    four = lines.groupBy("file", F.floor(F.col("n") / 4).alias("r")).agg(*(at(k).alias(f"v{k}") for k in range(4)), F.count(F.lit(1)).alias("lines")).where("lines = 4").where(F.col("v0").startswith("@"))
    head = F.expr("substring(v0, 2)")
    scores = F.transform(F.filter(F.split("v3", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return four.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), F.upper("v1").alias("sequence"), scores.alias("quality"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence, quality): lines are numbered over their file first, so a file is read by many tasks."""
    return fastq_records(numbered_lines(spark, path))


def fastq_text(df: DataFrame) -> DataFrame:
    best = F.expr("repeat('I', length(sequence))")
    q = F.coalesce(F.array_join(F.transform("quality", lambda x: F.char(x + 33)), ""), best) if "quality" in df.columns else best
    return df.select(F.concat(F.lit("@"), F.trim(F.concat_ws(" ", "id", "description")), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), q).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


GENBANK = "id string, description string, organism string, sequence string, features array<struct<type:string,start:int,end:int,strand:int,qualifiers:map<string,array<string>>>>"


def parse_location(text: str) -> tuple[int, int, int] | None:
    import re

    strand = -1 if "complement" in text else 1
    numbers = [int(x) for x in re.findall(r"\d+", text)]
    if not numbers:
        return None
    return (min(numbers) - 1, max(numbers), strand)


def location_parts(text: str) -> list[tuple[int, int]]:
    """The spans of a location, several for a join(), 0-based and half open."""
    import re

    return [(int(a) - 1, int(b or a)) for a, b in re.findall(r"[<>]?(\d+)(?:\.\.[<>]?(\d+))?", text)]


def parse_genbank(text: str) -> tuple | None:
    import re

    if "LOCUS" not in text:
        return None
    field = lambda k: " ".join(m[1].split()) if (m := re.search(rf"^\s*{k}\s+(.*(?:\n {{12}}.*)*)", text, re.M)) else None
    locus = field("LOCUS")
    head, _, origin = text.partition("\nORIGIN")
    features = []
    part = head.partition("\nFEATURES")[2]
    for m in re.finditer(r"^ {5}(\S+)\s+(\S+(?:\n {21}[^/\n].*)*)((?:\n {21}.*)*)", part, re.M):
        if (at := parse_location(m[2])) is None:
            continue
        q: dict = {}
        for k, v in re.findall(r"/(\w+)(?:=\"([^\"]*)\"|=\S+)?", m[3]):
            q.setdefault(k, []).append(" ".join(v.split()))
        features.append((m[1], *at, q))
    return (field("ACCESSION") or locus.split()[0], field("DEFINITION"), field("ORGANISM"), re.sub(r"[^A-Za-z]", "", origin).upper(), features)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Records end with '//' lines."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([r for t in b["value"] if (r := parse_genbank(t))], columns=["id", "description", "organism", "sequence", "features"])

    return _lines(spark, path, "\n//").mapInPandas(run, GENBANK)


def stockholm_records(lines: DataFrame) -> DataFrame:
    """(id, aligned, sequence) from lines (at, value): fragments of an id joined in order, gaps removed in sequence."""
    rows = lines.where(F.trim("value") != "").where(~F.col("value").startswith("#") & ~F.col("value").startswith("//"))
    rows = rows.select("at", F.split_part(F.trim("value"), F.lit(" "), F.lit(1)).alias("id"), F.regexp_extract("value", r"(\S+)\s*$", 1).alias("part"))
    one = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("aligned"))
    return one.withColumn("sequence", F.upper(F.regexp_replace("aligned", "[-.~]", "")))


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    return stockholm_records(_lines(spark, path).withColumn("at", F.monotonically_increasing_id()))


def _info(c: Column) -> Column:
    pairs = F.filter(F.split(c, ";"), lambda x: ~x.isin("", "."))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("true"))))


def _counts(gts: Column) -> Column:
    """Counts of each called allele of an array of calls, reference and alternatives."""
    codes = F.filter(F.flatten(F.transform(F.filter(gts, lambda g: ~is_missing(g)), alleles)), lambda a: ~a.isin(".", "*"))
    return let(codes, lambda c: F.transform(F.array_distinct(c), lambda a: F.size(F.filter(c, lambda x: x == a))))


def parse_vcf(lines: DataFrame, samples: list[str], chrom: str | None = None, start: int | None = None, end: int | None = None, passed: bool = False, snps: bool = False, min_maf: float = 0.0, max_missing: float = 1.0) -> DataFrame:
    """Long table from lines (value): a row per record and sample, one with null sample where there are none.

    Records may be limited to a region (inclusive), to those that passed all filters, to single-base changes, and by
    the frequency of their second commonest allele and their share of missing calls.
    """
    c = F.split("value", "\t")
    r = lines.where(F.length("value") > 0).where(~F.col("value").startswith("#")).where(F.size(c) >= 8).withColumn("c", c)
    g = lambda i: F.get(F.col("c"), F.lit(i))
    r = r.select(
        g(0).alias("chrom"), g(1).try_cast("long").alias("pos"), g(2).alias("id"), F.upper(g(3)).alias("ref"), F.split(F.upper(g(4)), ",").alias("alt"), g(5).try_cast("double").alias("qual"),
        F.filter(F.split(g(6), ";"), lambda x: ~x.isin(".", "PASS", "")).alias("filter"), _info(g(7)).alias("info"), F.split(g(8), ":").alias("format"), "c",
    ).where(F.col("pos").isNotNull())
    if chrom is not None:
        r = r.where((F.col("chrom") == chrom) & F.col("pos").between(start or 0, end or (1 << 62)))
    if passed:
        r = r.where(F.size("filter") == 0)
    if snps:
        r = r.where(is_snp(F.col("ref"), F.col("alt")))
    if not samples:
        return r.drop("c").withColumn("sample", F.lit(None).cast("string")).withColumn("gt", F.lit(None).cast("string")).withColumn("fields", F.lit(None).cast("map<string,string>"))
    calls = F.transform(F.array(*map(F.lit, samples)), lambda s, i: F.struct(s.alias("sample"), F.split(F.coalesce(F.get(F.col("c"), i + 9), F.lit("./.")), ":").alias("v")))
    r = r.withColumn("calls", calls)
    gts = F.transform("calls", lambda x: F.get(x["v"], F.lit(0)))
    if max_missing < 1.0:
        r = r.where(F.size(F.filter(gts, is_missing)) / float(len(samples)) <= max_missing)
    if min_maf > 0.0:
        n = F.array_sort(_counts(gts))
        r = r.where(F.coalesce(F.try_divide(F.get(n, F.size(n) - 2).cast("double"), F.aggregate(n, F.lit(0), lambda a, x: a + x)), F.lit(0.0)) >= min_maf)
    r = r.withColumn("x", F.explode("calls"))
    n = F.least(F.size("format"), F.size("x.v"))
    fields = F.map_from_arrays(F.slice("format", F.lit(1), n), F.slice("x.v", F.lit(1), n))
    return r.select(*[c for c in r.columns if c not in ("c", "x", "calls")], "x.sample", F.get("x.v", F.lit(0)).alias("gt"), fields.alias("fields"))


def vcf_samples(lines: DataFrame) -> list[str]:
    """The sample names of the header line; none without one."""
    header = lines.where(F.col("value").startswith("#CHROM")).first()
    return header["value"].split("\t")[9:] if header else []


def read_vcf(spark: SparkSession, path: str, **limits) -> DataFrame:
    """parse_vcf() of a file, with its limits."""
    lines = _lines(spark, path)
    return parse_vcf(lines, vcf_samples(lines), **limits)


def vcf_meta(lines: DataFrame) -> DataFrame:
    """(section, id, value) of the ## lines: contigs with their length, INFO, FILTER and FORMAT with their description, other keys as they are."""
    m = lines.where(F.col("value").startswith("##")).select(F.expr("substring(value, 3)").alias("v"))
    key = F.split_part("v", F.lit("="), F.lit(1))
    rest = F.regexp_replace("v", "^[^=]*=", "")
    listed = key.isin("contig", "INFO", "FILTER", "FORMAT")
    named = F.regexp_extract(rest, r"ID=([^,>]+)", 1)
    value = F.when(key == "contig", F.regexp_extract(rest, r"length=(\d+)", 1)).when(listed, F.regexp_extract(rest, r'Description="([^"]*)"', 1)).otherwise(rest)
    return m.select(F.when(listed, key).otherwise("meta").alias("section"), F.when(listed, named).otherwise(key).alias("id"), value.alias("value"))


def vcf_header(samples: list[str], meta: dict[str, str] | None = None, contigs: dict[str, int] | None = None) -> list[str]:
    out = ["##fileformat=VCFv4.2", *(f"##{k}={x}" for k, x in (meta or {}).items() if k != "fileformat"), *(f"##contig=<ID={k},length={n}>" for k, n in (contigs or {}).items())]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def vcf_text(df: DataFrame, samples: list[str]) -> DataFrame:
    """Lines of a VCF body from the long table, with chrom and pos; a missing sample is ./. ."""
    qual = F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit("."))
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    keys = ["chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alt"), qual.alias("qual"), F.when(F.size("filter") == 0, "PASS").otherwise(F.array_join("filter", ";")).alias("filter"), F.when(info == "", ".").otherwise(F.coalesce(info, F.lit("."))).alias("info")]
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]
    wide = df.select(*keys, "sample", "gt").groupBy(*names).pivot("sample", samples).agg(F.first("gt"))
    return wide.select("chrom", "pos", F.concat_ws("\t", *(F.col(n).cast("string") for n in names), F.lit("GT"), *(F.coalesce(F.col(f"`{s}`"), F.lit("./.")) for s in samples)).alias("value"))


def write_vcf(df: DataFrame, path: str, samples: list[str], meta: dict[str, str] | None = None, contigs: dict[str, int] | None = None) -> None:
    """Header and body in order of position: the files, in order of name, make up one VCF."""
    head = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(vcf_header(samples, meta, contigs))], "pos long, value string").select(F.lit(0).alias("part"), F.lit("").alias("chrom"), "pos", "value")
    body = vcf_text(df, samples).select(F.lit(1).alias("part"), "chrom", "pos", "value")
    head.unionByName(body).orderBy("part", "chrom", "pos", "value").select("value").write.text(path)


def _columns(lines: DataFrame) -> DataFrame:
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).where(F.size(c) >= 9).withColumn("c", c)
    g = lambda i: F.get(F.col("c"), F.lit(i))
    r = rows.select(g(0).alias("seqname"), g(1).alias("source"), g(2).alias("type"), g(3).try_cast("long").alias("start"), g(4).try_cast("long").alias("end"), g(5).try_cast("double").alias("score"), g(6).alias("strand"), g(7).try_cast("int").alias("phase"), g(8).alias("raw"))
    return r.where("start is not null and end is not null")


def parse_gff3(lines: DataFrame) -> DataFrame:
    """Features with attributes map<string, array<string>>; %XX escapes are decoded, commas separate values."""
    pairs = F.filter(F.split("raw", ";"), lambda x: x.contains("="))
    entry = lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.transform(F.split(F.regexp_replace(x, "^[^=]*=", ""), ","), lambda y: F.url_decode(F.replace(y, F.lit("+"), F.lit("%2B")))).alias("v"))
    return _columns(lines).withColumn("attributes", F.map_from_entries(F.transform(pairs, entry))).drop("raw")


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff3(_lines(spark, path))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Features like parse_gff3's. ID is the transcript's id, or the gene's on gene rows; Parent is the transcript on its parts, the gene on transcripts."""
    keys, values = F.regexp_extract_all("raw", F.lit(r'(\w+) "([^"]*)"'), F.lit(1)), F.regexp_extract_all("raw", F.lit(r'(\w+) "([^"]*)"'), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    merged = F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))
    f = _columns(lines).withColumn("given", merged)
    gene, tx = F.try_element_at("given", F.lit("gene_id")), F.try_element_at("given", F.lit("transcript_id"))
    kind = F.lower("type")
    own = F.when(kind == "gene", gene).otherwise(F.coalesce(tx, gene))
    parent = F.when(kind.isin("mrna", "transcript"), gene).when(kind != "gene", tx)
    extra = F.map_filter(F.create_map(F.lit("ID"), own, F.lit("Parent"), parent), lambda _, x: x.isNotNull())
    given = F.map_filter("given", lambda k, _: ~k.isin("ID", "Parent"))
    return f.withColumn("attributes", F.map_concat(given, extra)).drop("raw", "given")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(_lines(spark, path))


def gff3_text(df: DataFrame) -> DataFrame:
    escape = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit(";"), F.lit("%3B")), F.lit(","), F.lit("%2C")), F.lit("="), F.lit("%3D")), F.lit("&"), F.lit("%26"))
    a = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], F.array_join(F.transform(e["value"], escape), ","))), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return df.orderBy("seqname", "start").select(F.concat_ws("\t", "seqname", "source", "type", dot("start"), dot("end"), dot("score"), "strand", dot("phase"), a).alias("value"))


def read_expression_csv(spark: SparkSession, path: str) -> DataFrame:
    """(gene, sample, value): blanks and text count 0."""
    wide = spark.read.option("header", True).csv(path)
    key, *samples = wide.columns
    wide = wide.select(F.col(f"`{key}`").alias("gene"), *(F.coalesce(F.col(f"`{s}`").try_cast("double"), F.lit(0.0)).alias(s) for s in samples))
    return wide.unpivot("gene", samples, "sample", "value")


def expression_csv(df: DataFrame, samples: list[str]) -> DataFrame:
    return df.groupBy("gene").pivot("sample", samples).agg(F.format_string("%.4f", F.first("value")))
