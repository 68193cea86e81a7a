"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the hashes of `anchor` consecutive words, the smallest in every run of
`length - anchor + 1`, so each window of `length` words holds one, picked from the window alone. Anchors are
joined over all documents. An anchor that occurs again is extended both ways: to every window around it whose winnowed
anchor it is, from anchor at the window's end to anchor at its start. Not each pair of occurrences is extended, as
a passage with n copies has n * n of them: the extended windows of all occurrences meet by a hash of their whole word
sequence (80 bits besides the hash range), so the hottest passage costs one key per batch. Windows that repeat and
follow each other join to maximal repeats; their first and last word are the spans returned.

Defined cases: null or empty text and texts under `length` words lose nothing; a repeat within one document counts;
repeated rows lose each window that they share; extra columns pass through, and a column named like a result is
replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandwork.llm._packed import BATCH, BLOBS, Distinct, blobs, dealt, lanes, tally, totals
from strandwork.llm._store import slices
from strandwork.llm._text import TOP, U64, Words, grams, mix, sliding, texts_of, trimmed

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 5 << 20
SPANS = "array<struct<start: bigint, end: bigint>>"
RESULTS = ("kept_text", "n_words", "n_removed", "repeats")


def anchors(w: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes at the winnowed anchors; the starts of all windows; the hash of each window's own anchor."""
    run = length - anchor + 1
    h = grams(w.hash, anchor)
    h[~w.fits(anchor)] = TOP
    low = sliding(h, run, np.minimum, TOP)
    starts = np.flatnonzero(w.fits(length))
    own = low[starts]
    low[~w.fits(length)] = U64(0)
    back = sliding(low[::-1], run, np.maximum, U64(0))[::-1]  # the largest such minimum of the windows that hold a place
    return h[(back == h) & (back > U64(0))], starts, own


def _windows(w: Words, length: int, starts: np.ndarray, own: np.ndarray, seeds: Distinct, again: np.ndarray) -> tuple[np.ndarray, Distinct]:
    """Starts of the windows whose own anchor occurs again, and their distinct keys."""
    starts = starts[again[np.searchsorted(seeds.k, own)]] if len(own) else starts
    k, c = grams(w.hash, length)[starts], (grams(w.hash, length, 0x5BD1E995)[starts] >> U64(32)).astype(np.uint32)
    return starts, Distinct(mix(k, 3), c)


def _spans(w: Words, starts: np.ndarray, length: int) -> list[list[dict]]:
    """Each document's maximal repeats, [start, end) in words: runs of repeated windows that start at consecutive words."""
    out: list[list[dict]] = [[] for _ in w.lo]
    if not len(starts):
        return out
    doc = np.searchsorted(w.hi, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    for d, s, e in zip(doc[first].tolist(), starts[first].tolist(), (starts[last] + length).tolist()):
        out[d].append({"start": s - int(w.lo[d]), "end": e - int(w.lo[d])})
    return out


def _covered(w: Words, starts: np.ndarray, length: int) -> np.ndarray:
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept(w: Words, removed: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each document's kept words joined by one space, and how many words it lost."""
    mask = np.zeros(len(w.data) + 1, np.int8)
    mask[w.starts[~removed]] += 1
    mask[w.ends[~removed] + 1] -= 1
    mask = np.cumsum(mask[:-1], dtype=np.int8) > 0
    data = w.data.copy()
    data[w.ends] = 0x20
    sums = np.cumsum(mask, dtype=np.int32)
    out, at = data[mask].tobytes(), np.where(w.at > 0, sums[w.at - 1], 0) if len(sums) else w.at
    lost = np.concatenate([[0], np.cumsum(removed)])
    return [out[s : max(s, e - 1)] for s, e in zip(at, at[1:])], lost[w.hi] - lost[w.lo]


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 35, anchor: int = 11, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs with kept_text, n_words, n_removed and repeats: every word in a window of `length` words that starts anywhere else too goes.

    repeats: the maximal repeats of the document as spans [start, end) of words.
    """
    if not 0 < anchor <= length:
        raise ValueError("an anchor is a part of a window")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS and c != text])
    batches = slices(docs, text, batch_bytes)
    n = lanes(batches)
    dealt_docs = dealt(docs, text, batches)

    def seeds(key, batch):
        w = Words(texts_of(batch.column(text)))
        return blobs(key[0].as_py(), Distinct(anchors(w, length, anchor)[0]), n)

    def extend(key, left, right):
        w = Words(texts_of(left.column(text)))
        h, starts, own = anchors(w, length, anchor)
        d = Distinct(h)
        return blobs(key[0].as_py(), _windows(w, length, starts, own, d, totals(right, d.k, n) > 1)[1], n)

    schema = docs.select("*", F.lit("").alias("kept_text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast(SPANS).alias("repeats")).schema
    arrow, kept_columns = to_arrow_schema(schema), docs.columns

    def strip(key, left, right):
        w = Words(texts_of(left.column(text)))
        h, starts, own = anchors(w, length, anchor)
        d, kind = Distinct(h), np.array(right.column("kind").to_pylist(), bool)
        starts, windows = _windows(w, length, starts, own, d, totals(right.filter(pa.array(~kind)), d.k, n) > 1)
        again = totals(right.filter(pa.array(kind)), windows.k, n)[windows.of] > 1
        kept, lost = _kept(w, _covered(w, starts[again], length))
        columns = [left.column(c) for c in kept_columns]
        spans = pa.array(_spans(w, starts[again], length), arrow.field("repeats").type)
        return pa.Table.from_arrays([*columns, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(w.counts, pa.int64()), pa.array(lost, pa.int64()), spans], names=arrow.names)

    first = tally(dealt_docs.groupBy(BATCH).applyInArrow(trimmed(seeds), BLOBS), batches)
    second = tally(dealt_docs.groupBy(BATCH).cogroup(first.groupBy("b")).applyInArrow(trimmed(extend), BLOBS), batches)
    both = first.withColumn("kind", F.lit(False)).unionByName(second.withColumn("kind", F.lit(True)))
    return dealt_docs.groupBy(BATCH).cogroup(both.groupBy("b")).applyInArrow(trimmed(strip), schema)
