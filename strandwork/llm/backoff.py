"""Stupid-backoff language-model scores, computed relationally over the whole corpus.

The corpus's n-gram counts live in hash ranges. Each batch of documents sends its exploded n-grams to these ranges,
which add up the counts and join them back to the batch (see _packed); the batch sums the scores per document.
Orders above two are sent only where both shorter n-grams inside also occur in another document, as no other can.

A document's own counts are left out, so a text does not predict itself. With c the counts of the other documents
and N their words, a word after its (at most order - 1) predecessors in the document scores c(context word) /
c(context) at the longest context with c(context word) > 0, times alpha for each word of context given up; without
context c(word) / N, or alpha / (N + 1) if no other document has the word.

With its own counts a document would know each of its n-grams and never back off. Copies count as other documents.

Defined cases: null or empty text has no words, log10_score 0 and mean_log10 null; extra columns pass through, and a
column named like a result is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandwork.llm._packed import BATCH, BLOBS, Distinct, blobs, dealt, lanes, tally, totals
from strandwork.llm._store import slices
from strandwork.llm._text import U64, Words, count_words, grams, texts_of, trimmed

BATCH_BYTES = 8 << 20
RESULTS = ("n_words", "log10_score", "mean_log10")


class _Others:
    """For the n-gram at each word (in `places`), how often the other documents have it."""

    def __init__(self, w: Words, keys: np.ndarray, places: np.ndarray):
        self.places, self.distinct, self.n = places, Distinct(keys), len(w.hash)
        doc = w.doc_of_word()[places]
        self.own = Distinct(doc.astype(np.uint64) << U64(40) | self.distinct.of.astype(np.uint64))

    def counts(self, sent: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n + 1, np.int64)
        out[self.places] = sent[self.distinct.of].astype(np.int64) - self.own.count[self.own.of]
        return out


def _level(w: Words, order: int, below: np.ndarray | None) -> _Others:
    at = np.flatnonzero(w.fits(order))
    if below is not None:  # both n-grams of the order below, at i and i + 1, must occur elsewhere
        at = at[(below[at] > 0) & (below[at + 1] > 0)]
    return _Others(w, grams(w.hash, order, 0x51ED27 * order)[at], at)


def _known(w: Words, replies: pa.Table, upto: int, parts: int) -> list[np.ndarray]:
    """Counts by the other documents of the n-grams that start at each word, for orders 1 to upto."""
    kind, out = np.array(replies.column("kind").to_pylist(), np.int64), []
    for order in range(1, upto + 1):
        level = _level(w, order, out[-1] if order > 2 else None)
        out.append(level.counts(totals(replies.filter(pa.array(kind == order)), level.distinct.k, parts)))
    return out


def _scores(w: Words, counts: list[np.ndarray], words: int, alpha: float) -> np.ndarray:
    """log10 of each word's score."""
    n, order = len(w.hash), len(counts)
    place = np.arange(n) - np.repeat(w.lo, w.counts)
    most = np.minimum(place, order - 1)
    rest = words - np.repeat(w.counts, w.counts)
    seen = counts[0][:n]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(seen > 0, np.log10(seen / rest), np.log10(alpha / (rest + 1.0))) + most * np.log10(alpha)
        for k in range(1, order):  # a longer context, where it is known, replaces a shorter one
            at = np.flatnonzero(place >= k)
            whole = counts[k][at - k]
            at, whole = at[whole > 0], whole[whole > 0]
            out[at] = np.log10(whole / counts[k - 1][at - k]) + (most[at] - k) * np.log10(alpha)
    return out


def score(docs: DataFrame, text: str = "text", order: int = 3, alpha: float = 0.4, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs with n_words, log10_score (the sum over the words) and mean_log10."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS and c != text])
    batches = slices(docs, text, batch_bytes)
    n = lanes(batches)
    table, columns = dealt(docs, text, batches), docs.columns

    def short(order):
        def send(key, batch):
            w = Words(texts_of(batch.column(text)))
            return blobs(key[0].as_py(), _level(w, order, None).distinct, n)

        return send

    def longer(order):
        def send(key, left, right):
            w = Words(texts_of(left.column(text)))
            return blobs(key[0].as_py(), _level(w, order, _known(w, right, order - 1, n)[-1]).distinct, n)

        return send

    replies = None
    for o in range(1, order + 1):
        sent = table.groupBy(BATCH).applyInArrow(trimmed(short(o)), BLOBS) if o <= 2 else table.groupBy(BATCH).cogroup(replies.groupBy("b")).applyInArrow(trimmed(longer(o)), BLOBS)
        reply = tally(sent, batches).withColumn("kind", F.lit(o))
        replies = reply if replies is None else replies.unionByName(reply)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("log10_score"), F.lit(None).cast("double").alias("mean_log10")).schema
    names = to_arrow_schema(schema).names
    words = count_words(docs, text)

    def finish(key, left, right):
        w = Words(texts_of(left.column(text)))
        each = _scores(w, _known(w, right, order, n), words, alpha)
        sums = np.concatenate([[0.0], np.cumsum(each)])
        doc = np.array([float(each[a:b].sum()) for a, b in zip(w.lo, w.hi)]) if len(w.lo) else sums[:0]
        mean = [s / c if c else None for s, c in zip(doc.tolist(), w.counts.tolist())]
        return pa.Table.from_arrays([*(left.column(c) for c in columns), pa.array(w.counts, pa.int64()), pa.array(doc, pa.float64()), pa.array(mean, pa.float64())], names=names)

    return table.groupBy(BATCH).cogroup(replies.groupBy("b")).applyInArrow(trimmed(finish), schema)

