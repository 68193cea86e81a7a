"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines) are cut at content-defined places into pieces of some 16 bytes, so that an edit changes
only the pieces it touches. The distinct 64-bit piece digests go into a sketch of a few cells: count, sum of digests
and sum of checks. Subtracting two sketches cancels what the texts share; peeling recovers the digests that differ.
Where the cells are too few, both sketches are made again with four times as many, until peeling ends with all cells
empty. Likeness is the Jaccard index of the two digest sets, from their sizes and the digests recovered.

Defined cases: null text is the empty text; two empty texts have likeness 1, an empty and another one 0; rows with
equal or null keys follow each other in the order of their texts, null keys last; the only row of a table is its own
next one; repeated rows are rows like others; extra columns are left behind.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm._store import slices
from strandwork.llm._text import U64, mix, span_hashes

CELLS = 24
PIECE = 16
SLICE_BYTES = 12 << 20
MOST_SLICES = 1024
_TAB = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_SALTS = (0x1B873593, 0x85EBCA6B, 0xC2B2AE35)


class Pieces:
    """The distinct piece digests of each text of a batch: doc (ascending) and key."""

    def __init__(self, texts: list[bytes]):
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(size)])
        self.docs = len(texts)
        if not len(data):
            self.doc, self.key = np.empty(0, np.int64), np.empty(0, U64)
        else:
            with np.errstate(over="ignore"):
                roll = np.zeros(len(data), U64)
                for j in range(8):  # the last eight bytes
                    roll[j:] += _TAB[data[: len(data) - j]] * U64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
            into = np.arange(len(data)) - np.repeat(at[:-1], size)
            stop = (mix(roll) < U64((1 << 64) // PIECE)) & (into >= 7)
            stop |= data == 10
            stop[at[1:][size > 0] - 1] = True
            ends = np.flatnonzero(stop) + 1
            starts = np.concatenate([[0], ends[:-1]])
            key = span_hashes(raw, data, starts, ends)
            doc = np.searchsorted(at, starts, "right") - 1
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            self.doc, self.key = doc[new], key[new]
        self.lo = np.searchsorted(self.doc, np.arange(self.docs + 1))
        self.size = np.diff(self.lo)

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in `docs` and the key of all pieces of these documents."""
        n = self.size[docs]
        start = np.repeat(self.lo[docs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(docs) else n
        return np.repeat(np.arange(len(docs)), n), self.key[np.arange(n.sum()) + start]


class Sketches:
    """Cells of many sketches at once; cells is a multiple of three, a third for each hash."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.sum, self.check = np.zeros(n * cells, np.int64), np.zeros(n * cells, U64), np.zeros(n * cells, U64)

    def add(self, doc: np.ndarray, key: np.ndarray, sign: np.ndarray | int) -> None:
        third = self.cells // 3
        with np.errstate(over="ignore"):
            signed = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
            by, check = signed.astype(U64), mix(key, 0x2545F491)
            for j, salt in enumerate(_SALTS):
                cell = doc * self.cells + j * third + (mix(key, salt) % U64(third)).astype(np.int64)
                np.add.at(self.count, cell, signed)
                np.add.at(self.sum, cell, key * by)
                np.add.at(self.check, cell, check * by)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """How many keys were recovered from each sketch, and whether all were."""
        found = np.zeros(self.n, np.int64)
        with np.errstate(over="ignore"):
            while True:
                at = np.flatnonzero(np.abs(self.count) == 1)
                sign = self.count[at]
                by = sign.astype(U64)
                key = self.sum[at] * by
                pure = mix(key, 0x2545F491) == self.check[at] * by
                doc, key, sign = at[pure] // self.cells, key[pure], sign[pure]
                if not len(key):
                    break
                order = np.lexsort((key, doc))
                doc, key, sign = doc[order], key[order], sign[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                doc, key, sign = doc[new], key[new], sign[new]
                found += np.bincount(doc, minlength=self.n)
                self.add(doc, key, -sign)
        left = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        return found, ~left.reshape(self.n, self.cells).any(1) if self.n else np.ones(0, bool)


def differing(a: Pieces, b: Pieces, cells: int = CELLS) -> np.ndarray:
    """How many digests differ between the texts at equal places of a and b: subtract, peel, retry larger on failure."""
    out, todo = np.zeros(a.docs, np.int64), np.arange(a.docs)
    most = 64 * int(max(a.size.max(initial=0) + b.size.max(initial=0), 1)) + cells
    while len(todo):
        s = Sketches(len(todo), cells)
        s.add(*a.of(todo), 1)
        s.add(*b.of(todo), -1)
        found, whole = s.peel()
        out[todo[whole]] = found[whole]
        todo, cells = todo[~whole], cells * 4
        if cells > most:  # two digests with the same cells: count them exactly
            for i in todo:
                out[i] = len(np.setxor1d(a.key[a.lo[i] : a.lo[i + 1]], b.key[b.lo[i] : b.lo[i + 1]], True))
            break
    return out


def likeness(a: Pieces, b: Pieces, cells: int = CELLS) -> np.ndarray:
    both, d = a.size + b.size, differing(a, b, cells)
    return np.where(both + d > 0, (both - d) / np.maximum(both + d, 1), 1.0)


def encode(p: Pieces, cells: int = CELLS) -> list[str]:
    """The sketches as text: number of digests, cells, then counts, sums and checks, little-endian, base64."""
    s = Sketches(p.docs, cells)
    s.add(p.doc, p.key, 1)
    count, sums, check = (x.reshape(p.docs, cells) for x in (s.count.astype("<i4"), s.sum, s.check))
    return [base64.b64encode(struct.pack("<II", int(p.size[i]), cells) + count[i].tobytes() + sums[i].astype("<u8").tobytes() + (check[i] >> U64(32)).astype("<u4").tobytes()).decode() for i in range(p.docs)]


def _branch(key: Column, splits: list[int], at: int) -> Column:
    """How many of the ascending splits lie at or below the key, as a tree of comparisons."""
    if not splits:
        return F.lit(at)
    m = len(splits) // 2
    return F.when(key < splits[m], _branch(key, splits[:m], at)).otherwise(_branch(key, splits[m + 1 :], at + m + 1))


RESULT = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, work, schema: str, key: str = "doc_id", text: str = "text", step_bytes: int = 1 << 20) -> DataFrame:
    """Runs work(ids, texts), where texts has one more row, the next one's, over docs in descending key order; after the last row comes the first.

    The keys' quantiles deal the rows to at most MOST_SLICES ordered slices; each slice also gets the first row of the
    next one, so texts move once. A task streams its sorted slices in steps of step_bytes, whatever their size.
    """
    n = min(slices(docs, text, SLICE_BYTES), MOST_SLICES)
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("k"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    q = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10000)).first()[0] or []
    rows = rows.withColumn("s", _branch(F.col("k"), sorted(set(q)), 0))
    heads = sorted(((r["s"], r["k"]) for r in rows.groupBy("s").agg(F.max("k").alias("k")).collect()), reverse=True)
    before = {s: heads[i - 1][0] for i, (s, _) in enumerate(heads)}  # the first slice's row goes to the last one
    own = F.struct(F.col("s"), F.lit(False).alias("guest"))
    if heads:
        to = F.element_at(F.create_map(*(x for s, k in heads for x in (F.lit(k), F.lit(before[s])))), F.col("k"))
        rows = rows.withColumn("x", F.explode(F.when(to.isNull(), F.array(own)).otherwise(F.array(own, F.struct(to.alias("s"), F.lit(True).alias("guest"))))))
    else:
        rows = rows.withColumn("x", own)
    rows = rows.select("x.s", "x.guest", "k", "id", "t").repartition("s").sortWithinPartitions("s", "guest", F.col("k").desc(), "t")

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for guest, i, t in zip(*(batch.column(c).to_pylist() for c in ("guest", "id", "t"))):
                if guest:
                    if ids:  # ends its slice; further rows with the same key are not the next one
                        yield work(ids, [*texts, t])
                        ids, texts, size = [], [], 0
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= step_bytes and len(ids) > 1:
                    yield work(ids[:-1], texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)

    return rows.select("guest", "id", "t").mapInArrow(run, schema)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", cells: int = CELLS, step_bytes: int = 1 << 20) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, that text, and the likeness to it and to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document's.
    """

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in RESULT.split(", ")]

    def work(ids, texts):
        halves = [len(t) // 2 for t in texts[:-1]]
        edited = [t[: len(t) - h] + u[:h] for t, u, h in zip(texts, texts[1:], halves)]
        plain = [t.encode() for t in texts]
        own, changed, following = Pieces(plain[:-1]), Pieces([t.encode() for t in edited]), Pieces(plain[1:])
        columns = (ids, [len(t) for t in texts[:-1]], edited, encode(own, cells), encode(changed, cells), likeness(own, changed, cells), likeness(own, following, cells))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return with_next(docs, work, RESULT, key, text, step_bytes)
