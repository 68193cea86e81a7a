"""Table functions over sequences: microsatellites, regulatory motifs, transposable-element classes and primers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions import tables as T
from strandwork.functions.sequence import count_of, linguistic_complexity, melting_temperature, reverse_complement


def _per_row(df: DataFrame, find, columns: str) -> DataFrame:
    """(id, s) rows to one row per hit of find(s)."""
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(i, *hit) for i, s in zip(b["id"], b["s"]) for hit in find(s or "")], columns=names)

    return df.select("id", "s").mapInPandas(run, f"id {dict(df.dtypes)['id']}, {columns}")


def microsatellites(df: DataFrame, least: dict[int, int] | None = None) -> DataFrame:
    """Tandem repeats per motif length, leftmost first and not overlapping: 1-based start, end, motif, repeats, kind."""
    least = least or T.SSR_LEAST
    patterns = [(k, re.compile(rf"(.{{{k}}})\1{{{n - 1},}}")) for k, n in least.items()]

    def find(s: str):
        for k, p in patterns:
            for m in p.finditer(s):
                yield m.start() + 1, m.end(), m[1], (m.end() - m.start()) // k, T.SSR_NAMES.get(k, "hexa")

    return _per_row(df, find, "start long, end long, motif string, repeats int, kind string")


def _regex(motif: str) -> str:
    return "".join(f"[{T.IUPAC[c]}]" if c in T.IUPAC else c for c in motif)


def cis_elements(df: DataFrame, motifs: dict[str, str] | None = None, both: bool = True) -> DataFrame:
    """Hits of each motif alternative on both strands, not overlapping per alternative: 1-based forward position and strand."""
    alternatives = [(name, m, re.compile(_regex(m))) for name, ms in (motifs or T.CIS_MOTIFS).items() for m in ms.split("|")]
    table = str.maketrans(*T.DNA_COMPLEMENT)

    def find(s: str):
        rc = s.translate(table)[::-1] if both else ""
        for name, motif, p in alternatives:
            for m in p.finditer(s):
                yield name, motif, m.start() + 1, "+"
            for m in p.finditer(rc):
                yield name, motif, len(s) - m.end() + 1, "-"

    return _per_row(df, find, "element string, motif string, pos long, strand string")


# Name keywords and end motifs of transposable-element families.
TE_NAMES = {"MUTATOR": "MUTATOR", "CACTA": "CACTA", "HARBINGER": "HARBINGER", "TOURIST": "TOURIST_MINIATURE", "STOWAWAY": "STOWAWAY"}
TE_ENDS = {"MUTATOR": ["CAGTGGATG"], "CACTA": ["CACT", "GTGA"], "HARBINGER": ["TTAC", "GTAA"], "TOURIST_MINIATURE": ["TGGGGG", "CCCCA"]}


def te_classes(df: DataFrame) -> DataFrame:
    """Family and score of (id, name, s): by name, else by its ends, else by low complexity; null family without evidence."""
    s, name = F.col("s"), F.upper("name")
    by_name = F.lit(None).cast("string")
    for key, family in TE_NAMES.items():
        by_name = F.when(name.contains(key), family).otherwise(by_name)
    by_end = F.lit(None).cast("string")
    for family, ends in reversed(TE_ENDS.items()):
        hit = F.lit(False)
        for m in ends:
            rc = reverse_complement(F.lit(m))
            hit = hit | s.startswith(m) | s.endswith(m) | s.startswith(rc) | s.endswith(rc)
        by_end = F.when(hit, family).otherwise(by_end)
    d = df.withColumn("complexity", linguistic_complexity(s)).withColumn("n", by_name).withColumn("e", by_end)
    low = F.col("complexity") < 0.35
    score = F.when(F.col("n").isNotNull(), 0.8).when(F.col("e").isNotNull(), 0.7).when(low, 0.4)
    return d.select("id", F.coalesce("n", "e", F.when(low, "UNKNOWN")).alias("family"), score.alias("score"))


def primers(templates: DataFrame, flank: int = 50, sizes: tuple[int, int] = (18, 25), tm: tuple[float, float] = (55.0, 65.0), gc: tuple[float, float] = (40.0, 60.0)) -> DataFrame:
    """Forward and reverse primer candidates around [target_start, target_end) of (id, s): every start in the flanks, every size.

    The flanks are cut from the text first, so places and sizes multiply some flank + size letters, not the whole text.
    """
    s, reach = F.col("s"), flank + sizes[1]
    sides = F.array(
        F.struct(F.lit("forward").alias("side"), F.greatest(F.col("target_start") - flank, F.lit(0)).alias("first"), F.greatest(F.col("target_start"), F.lit(0)).alias("last")),
        F.struct(F.lit("reverse").alias("side"), F.col("target_end").alias("first"), (F.col("target_end") + flank).alias("last")),
    )
    t = templates.select("id", "s", F.explode(sides).alias("x")).select("id", "x.*", F.substring(s, F.col("x.first") + 1, F.lit(reach)).alias("near"))
    c = t.select("id", "side", "first", "near", F.explode(F.sequence("first", "last")).alias("start")).select("id", "side", "first", "near", "start", F.explode(F.sequence(F.lit(sizes[0]), F.lit(sizes[1]))).alias("size"))
    c = c.where(F.col("start") - F.col("first") + F.col("size") <= F.length("near"))
    piece = F.substring("near", F.col("start") - F.col("first") + 1, F.col("size"))
    c = c.withColumn("primer", F.when(F.col("side") == "forward", piece).otherwise(reverse_complement(piece)))
    p = F.col("primer")
    share = count_of(p, "GC") * 100.0 / F.col("size")
    c = c.withColumn("tm", melting_temperature(p)).withColumn("gc", share).where(F.col("tm").between(*tm) & F.col("gc").between(*gc))
    score = 100 - 2 * F.abs(F.col("tm") - sum(tm) / 2) - F.abs(F.col("gc") - sum(gc) / 2) + F.when(F.right(p, F.lit(1)).isin("G", "C"), 5).otherwise(0)
    return c.select("id", "side", F.col("start").cast("long"), "primer", "tm", "gc", score.alias("score"))
