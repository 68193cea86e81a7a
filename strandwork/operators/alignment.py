"""Pairwise alignment, progressive multiple alignment, k-mer search and RNA folding."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.sequence import kmers

ALIGNMENT = "a_aligned string, b_aligned string, score double, identity double, gaps int"
# Karlin-Altschul parameters.
LAMBDA, KAPPA = 0.318, 0.134


def align(a: str, b: str, mode: str = "global", match: float = 2.0, mismatch: float = -1.0, gap: float = -2.0, extend: float = -0.5, matrix: dict | None = None) -> tuple:
    """Aligned strings, score, identity and gap characters.

    Global and semi-global alignment have affine gaps (Gotoh): opening costs `gap`, each further place `extend`; local
    alignment charges `gap` for every place. Semi-global leaves gaps before and after either sequence free.
    """
    n, m = len(a), len(b)
    sub = np.array([[matrix.get((x, y), match if x == y else mismatch) if matrix else match if x == y else mismatch for y in b] for x in a], float).reshape(n, m)
    more = gap if mode == "local" else extend
    low = -1e18
    h, e, f = np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    h[0, 0] = 0.0
    for i in range(1, n + 1):
        h[i, 0] = f[i, 0] = 0.0 if mode != "global" else gap + more * (i - 1)
    for j in range(1, m + 1):
        h[0, j] = e[0, j] = 0.0 if mode != "global" else gap + more * (j - 1)
    for i in range(1, n + 1):
        f[i, 1:] = np.maximum(h[i - 1, 1:] + gap, f[i - 1, 1:] + more)
        open_or_match = np.maximum(h[i - 1, :-1] + sub[i - 1], f[i, 1:])
        for j in range(1, m + 1):
            e[i, j] = max(h[i, j - 1] + gap, e[i, j - 1] + more)
            best = max(open_or_match[j - 1], e[i, j])
            h[i, j] = max(best, 0.0) if mode == "local" else best
    if mode == "global":
        i, j = n, m
    elif mode == "local":
        i, j = np.unravel_index(int(h.argmax()), h.shape)
    else:
        right, below = int(h[n].argmax()), int(h[:, m].argmax())
        i, j = (n, right) if h[n, right] >= h[below, m] else (below, m)
    score, x, y = float(h[i, j]), [], []
    state = "h"
    while i > 0 or j > 0:
        if mode == "local" and state == "h" and h[i, j] <= 0:
            break
        if mode == "semiglobal" and (i == 0 or j == 0):
            break
        if state == "h":
            if i and j and math.isclose(h[i, j], h[i - 1, j - 1] + sub[i - 1, j - 1], abs_tol=1e-9):
                i, j = i - 1, j - 1
                x.append(a[i])
                y.append(b[j])
                continue
            state = "f" if i and math.isclose(h[i, j], f[i, j], abs_tol=1e-9) else "e"
        if state == "f":
            stay = i > 1 and math.isclose(f[i, j], f[i - 1, j] + more, abs_tol=1e-9) and not math.isclose(f[i, j], h[i - 1, j] + gap, abs_tol=1e-9)
            i -= 1
            x.append(a[i])
            y.append("-")
        else:
            stay = j > 1 and math.isclose(e[i, j], e[i, j - 1] + more, abs_tol=1e-9) and not math.isclose(e[i, j], h[i, j - 1] + gap, abs_tol=1e-9)
            j -= 1
            x.append("-")
            y.append(b[j])
        state = state if stay else "h"
    x, y = "".join(reversed(x)), "".join(reversed(y))
    both = sum(p != "-" and q != "-" for p, q in zip(x, y))
    same = sum(p == q for p, q in zip(x, y) if p != "-")
    return x, y, score, same / both if both else 0.0, x.count("-") + y.count("-")


def align_column(a: Column, b: Column, **options) -> Column:
    """The alignment of two string columns as a struct."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align(p or "", q or "", **options) for p, q in zip(x, y)], columns=[c.split()[0] for c in ALIGNMENT.split(", ")])

    return F.pandas_udf(run, ALIGNMENT, F.PandasUDFType.SCALAR)(a, b)


def multiple_alignment(rows: DataFrame, group: str = "family") -> DataFrame:
    """Progressive alignment of each family's (id, s): the most central sequence first, then the nearest ones; gaps stay."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id").reset_index(drop=True)
        seqs, n = g["s"].tolist(), len(g)
        near = np.array([[align(p, q)[3] if i != j else 1.0 for j, q in enumerate(seqs)] for i, p in enumerate(seqs)])
        order = [int(near.sum(1).argmax())]
        while len(order) < n:
            rest = [i for i in range(n) if i not in order]
            order.append(max(rest, key=lambda i: (near[i, order].max(), -i)))
        rows_ = [list(seqs[order[0]])]
        for k in order[1:]:
            profile = "".join(max(sorted(set(c) - {"-"}), key=c.count, default="-") for c in (["".join(col) for col in zip(*rows_)]))
            x, y, *_ = align(profile, seqs[k])
            where, grown = 0, [[] for _ in rows_]
            for c in x:
                for old, new in zip(rows_, grown):
                    new.append("-" if c == "-" else old[where])
                where += c != "-"
            rows_ = [*grown, list(y)]
        out = {order[i]: "".join(r) for i, r in enumerate(rows_)}
        return pd.DataFrame({group: g[group], "id": g["id"], "aligned": [out[i] for i in range(n)]})

    schema = rows.select(group, "id", F.col("s").alias("aligned")).schema
    return rows.select(group, "id", "s").groupBy(group).applyInPandas(run, schema)


def seed_hits(queries: DataFrame, subjects: DataFrame, k: int) -> DataFrame:
    """(query, subject, seeds): k-mer equi-join of (id, s) tables; a k-mer counts once per sequence on either side."""
    q = queries.select(F.col("id").alias("query"), F.explode(F.array_distinct(kmers(F.col("s"), k))).alias("kmer"))
    t = subjects.select(F.col("id").alias("subject"), F.explode(F.array_distinct(kmers(F.col("s"), k))).alias("kmer"))
    return q.join(t, "kmer").groupBy("query", "subject").agg(F.count(F.lit(1)).alias("seeds"))


def search(queries: DataFrame, subjects: DataFrame, k: int = 11, most: int = 50, evalue: float = 0.001, match: float = 2.0, mismatch: float = -3.0, gap: float = -5.0, matrix: dict | None = None) -> DataFrame:
    """Seed, extend by local alignment, score: hits of each query by E-value, at most `most` (a top-k report)."""
    n = subjects.count()
    w = Window.partitionBy("query").orderBy(F.col("seeds").desc(), "subject")
    top = seed_hits(queries, subjects, k).withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * most).drop("r")
    pairs = top.join(queries.select(F.col("id").alias("query"), F.col("s").alias("qs")), "query").join(subjects.select(F.col("id").alias("subject"), F.col("s").alias("ss")), "subject")
    hits = pairs.withColumn("al", align_column(F.col("qs"), F.col("ss"), mode="local", match=match, mismatch=mismatch, gap=gap, matrix=matrix))
    e = KAPPA * F.length("qs") * F.length("ss") * n * F.exp(-LAMBDA * F.col("al.score"))
    hits = hits.select("query", "subject", "seeds", F.col("al.score").alias("score"), ((LAMBDA * F.col("al.score") - math.log(KAPPA)) / math.log(2)).alias("bits"), e.alias("evalue"), F.col("al.identity").alias("identity")).where(F.col("evalue") <= evalue)
    best = Window.partitionBy("query").orderBy("evalue", "subject")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


@lru_cache(1 << 10)  # a row of several functions folds a sequence more than once
def fold(rna: str, hairpin: int = 3) -> tuple[str, int, float]:
    """Dot-bracket structure with the most pairs, their number, and an energy estimate."""
    s, n = rna.upper().replace("T", "U"), len(rna)
    pairs = {"AU", "UA", "GC", "CG", "GU", "UG"}
    mates = [[k for k in range(i + hairpin + 1, n) if s[i] + s[k] in pairs] for i in range(n)]
    best = [[0] * (n + 1) for _ in range(n + 1)]
    for d in range(hairpin + 1, n):
        for i in range(n - d):
            j, below = i + d, best[i + 1]
            top = below[j]
            for k in mates[i]:
                if k > j:
                    break
                x = 1 + below[k - 1] + best[k + 1][j]
                if x > top:
                    top = x
            best[i][j] = top
    out, todo = ["."] * n, [(0, n - 1)] if n else []
    while todo:
        i, j = todo.pop()
        if j - i <= hairpin:
            continue
        if best[i][j] == best[i + 1][j]:
            todo.append((i + 1, j))
            continue
        for k in mates[i]:
            if best[i][j] == 1 + best[i + 1][k - 1] + best[k + 1][j]:
                out[i], out[k] = "(", ")"
                todo += [(i + 1, k - 1), (k + 1, j)]
                break
    found = out.count("(")
    return "".join(out), found, -1.5 * found + 0.1 * (n - 2 * found)


def fold_column(s: Column) -> Column:
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fold(t or "") for t in x], columns=["structure", "pairs", "energy"])

    return F.pandas_udf(run, "structure string, pairs int, energy double", F.PandasUDFType.SCALAR)(s)


def dna_matrix(match: float = 2.0, mismatch: float = -1.0) -> dict[tuple[str, str], float]:
    """Scores of all pairs of A, T, G, C and N."""
    return {(a, b): match if a == b else mismatch for a in "ATGCN" for b in "ATGCN"}


def stems(structure: Column) -> Column:
    """Structs of start and end (0-based, half open) of the runs of opening brackets."""
    parts = F.filter(F.split(structure, r"(?<=\()(?=[^(])|(?<=[^(])(?=\()"), lambda p: p != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when(p.startswith("("), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end")))).otherwise(acc["out"]).alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def loops(rna: str, structure: str, least: int = 3) -> list[str]:
    """Unpaired stretches of at least `least` bases."""
    import re

    return [rna[m.start() : m.end()] for m in re.finditer(rf"\.{{{least},}}", structure)]


_PAIRS = str.maketrans("AUGC", "UACG")


def _score(a: str, b: str, match: float, mismatch: float, gap: float) -> float:
    """Best local score with a linear gap, by rows: the gap within a row is a running maximum."""
    if not a or not b:
        return 0.0
    y = np.frombuffer(b.encode(), np.uint8)
    step = np.arange(len(b) + 1) * gap
    row, best = np.zeros(len(b) + 1), 0.0
    for x in a.encode():
        new = np.zeros(len(b) + 1)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(y == x, match, mismatch), row[1:] + gap), 0.0)
        row = np.maximum.accumulate(new - step) + step
        best = max(best, float(row.max()))
    return best


def _pair_udf(one, a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([one(p or "", q or "") for p, q in zip(x, y)], dtype=float), "double", F.PandasUDFType.SCALAR)(a, b)


def rna_hybridize(a: Column, b: Column) -> Column:
    """Energy of two RNAs: -0.7 times the local score (3, -2, -5) of the first with the second's complement."""
    return _pair_udf(lambda p, q: -0.7 * _score(p, q.translate(_PAIRS), 3.0, -2.0, -5.0), a, b)


def kissing_loops(a: Column, b: Column) -> Column:
    """The best local score of a loop of one folded RNA with the complement of a loop of the other; 0 without loops."""

    def one(p: str, q: str) -> float:
        left, right = ({x for x in loops(s, fold(s)[0])} for s in (p.replace("T", "U"), q.replace("T", "U")))
        return max((_score(x, y.translate(_PAIRS), 2.0, -1.0, -2.0) for x in left for y in right), default=0.0)

    return _pair_udf(one, a, b)


def r_loop(dna: Column, rna: Column) -> Column:
    """Propensity of an R-loop: identity times GC share times local score over the longer length."""

    def one(p: str, q: str) -> float:
        _, _, score, identity, _ = align(p, q.replace("U", "T"), "local")
        return identity * (sum(c in "GC" for c in p) / len(p)) * score / max(len(p), len(q)) if p and q else 0.0

    return _pair_udf(one, dna, rna)


def blastn(queries: DataFrame, subjects: DataFrame, most: int = 50, evalue: float = 0.001) -> DataFrame:
    """search() of nucleotides: words of 11, match 2, mismatch -3, gap -5."""
    return search(queries, subjects, 11, most, evalue)


def blastp(queries: DataFrame, subjects: DataFrame, matrix: dict | None = None, most: int = 50, evalue: float = 0.001) -> DataFrame:
    """search() of proteins: words of 3, gap -11, with a substitution matrix as (residue, residue) -> score."""
    return search(queries, subjects, 3, most, evalue, gap=-11.0, matrix=matrix)


def best_hits(hits: DataFrame, most: int = 10) -> DataFrame:
    """Of each query the hits of the smallest E-values."""
    w = Window.partitionBy("query").orderBy("evalue", "subject")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def pretty(al: Column, width: int = 60) -> Column:
    """An alignment struct as text: blocks of both rows with a line of bars and dots between them."""

    def run(x: pd.DataFrame) -> pd.Series:
        out = []
        for a, b in zip(x["a_aligned"], x["b_aligned"]):
            marks = "".join("|" if p == q else " " if "-" in (p, q) else "." for p, q in zip(a, b))
            out.append("\n\n".join("\n".join(r[i : i + width] for r in (a, marks, b)) for i in range(0, len(a), width)))
        return pd.Series(out)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(al)
