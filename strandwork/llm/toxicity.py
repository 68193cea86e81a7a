"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are a text's lower-cased words and their first 4, 5 and 6 bytes; ASCII punctuation separates words. The
model is fitted on a sample of at most `most_rows` labelled documents, the first by a seeded hash of the id; that bound
is the only one, and scoring reads every text whole. Features are kept by a likelihood-ratio test of their presence against
the label, corrected for their number, at most `most_features`. Labels only say toxic or not, so the grades of toxic sample documents are the
terciles of how much of these features they hold: 0 clean, 1, 2, 3. All thresholds share one weight vector:
P(grade <= k) = logistic(cut_k - w.x), with x = 1 + log(count). A document is toxic if P(grade >= 1) >= 0.5.

Defined cases: null and empty texts have no features; without both labels in the sample every document is grade 0;
labels with a null id, a null label or an id that no document has are left out; ids labelled twice count twice;
repeated rows are scored once each; extra columns pass through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandwork.llm._store import cut
from strandwork.llm._text import U64, mix, small_batches, span_hashes, texts_words, trimmed

MOST_ROWS = 8000
MOST_FEATURES = 4096
LEAST_TEXTS = 3
PREFIXES = (4, 5, 6)
GRADES = 4
RESULTS = ("severity", "expected_severity", "toxic")
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


@dataclass
class Model:
    keys: np.ndarray  # feature hashes, ascending
    weights: np.ndarray
    cuts: np.ndarray  # ascending; empty if there was nothing to learn

    def grades(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. per text."""
        return 1.0 / (1.0 + np.exp(-np.clip(latent[:, None] - self.cuts[None, :], -60, 60)))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, count) of the distinct features of each text, and words per text."""
    raw, data, _, starts, ends, lo, hi = texts_words([(t or "").lower().encode() for t in texts], _BREAKS)
    doc = np.repeat(np.arange(len(texts)), hi - lo)
    keys, docs = [mix(span_hashes(raw, data, starts, ends), 1)], [doc]
    for n in PREFIXES:
        some = ends - starts > n
        keys.append(mix(span_hashes(raw, data, starts[some], starts[some] + n), 1 + n))
        docs.append(doc[some])
    k, d = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((k, d))
    k, d = k[order], d[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], k[at], np.diff(np.append(at, len(k))), hi - lo


def _latent(model: Model, texts: list[str | None]) -> np.ndarray:
    d, k, n, _ = features(texts)
    if not len(model.keys):
        return np.zeros(len(texts))
    at = np.minimum(np.searchsorted(model.keys, k), len(model.keys) - 1)
    hit = model.keys[at] == k
    return np.bincount(d[hit], (1 + np.log(n[hit])) * model.weights[at[hit]], len(texts))


NOTHING = Model(np.empty(0, U64), np.empty(0), np.empty(0))


def train(keys: np.ndarray, doc: np.ndarray, place: np.ndarray, count: np.ndarray, toxic: np.ndarray, steps: int = 600, penalty: float = 1e-5) -> Model:
    """A model from (text, place in keys, count) triples of len(toxic) texts."""
    n, pos = len(toxic), int(toxic.sum())
    if not 0 < pos < n or not len(keys):
        return NOTHING
    r, f, x = doc, place, 1 + np.log(count)
    hits = np.bincount(r, x, n)
    grade = np.zeros(n, np.int64)
    sick = toxic.astype(bool)
    grade[sick] = 1 + np.searchsorted(np.quantile(hits[sick], [1 / 3, 2 / 3]), hits[sick], "right")
    w, t = np.zeros(len(keys)), np.array([2.0, 0.0, 0.0])  # first cut, then the logarithms of the steps between cuts
    m, v, p = np.zeros(len(w) + 3), np.zeros(len(w) + 3), np.concatenate([w, t])
    for i in range(1, steps + 1):
        w, t = p[:-3], p[-3:]
        cuts = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
        z = np.bincount(r, x * w[f], n)
        s = 1.0 / (1.0 + np.exp(-np.clip(cuts[None, :] - z[:, None], -60, 60)))  # P(grade <= k)
        full = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], 1)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], 1)
        rows = np.arange(n)
        prob = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-12)
        up, down = slope[rows, grade + 1] / prob, slope[rows, grade] / prob
        dz = (up - down) / n  # of the negative log-likelihood
        dcut = np.array([(np.where(grade == k, -up, 0.0) + np.where(grade == k + 1, down, 0.0)).sum() for k in range(3)]) / n
        dt = np.array([dcut.sum(), dcut[1:].sum() * np.exp(t[1]), dcut[2] * np.exp(t[2])])
        g = np.concatenate([np.bincount(f, x * dz[r], len(w)) + penalty * w, dt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    w, t = p[:-3], p[-3:]
    return Model(keys, w, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))]))


def _useful(texts: DataFrame, n: int, pos: int, most_features: int) -> np.ndarray:
    """Hashes of the features that toxic texts have more often, so clearly that chance would make less than one of them."""

    def run(batches):
        for batch in small_batches(batches, 1):
            d, k, _, _ = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.array(batch.column(0))[d], pa.int32())], names=["k", "y"])

    each = texts.select("y", "t").mapInArrow(trimmed(run), "k long, y int").groupBy("k").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("a")).where(F.col("df") >= LEAST_TEXTS)
    each = cut(each, "features")
    common = each.count()
    rate, b = pos / n, F.col("df") - F.col("a")
    part = lambda c, share: F.when(c > 0, c * F.log(c / (F.col("df") * share))).otherwise(0.0)
    gain = part(F.col("a"), rate) + part(b, 1 - rate)
    found = each.where(F.col("a") > F.col("df") * rate).withColumn("gain", gain).where(F.col("gain") >= float(np.log(max(1, common))))
    rows = found.orderBy(F.col("gain").desc(), "k").limit(most_features).select("k").collect()
    return np.sort(np.array([r["k"] for r in rows], np.int64).view(U64))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, seed: int = 5) -> Model:
    """A model from the first most_rows labelled documents by seeded hash of the id.

    Features are counted and chosen on the executors; the driver gets the chosen ones and where the sample has them.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), (F.col(label) > 0).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most_rows)
    rows = docs.select(F.col(key).cast("long").alias("id2"), F.col(text).cast("string").alias("t")).join(F.broadcast(some), F.col("id2") == F.col("id"))
    sample = cut(rows.select("y", "t").limit(most_rows), "labelled")  # fewer rows than most_rows, unless ids repeat
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    n, pos = total["n"], total["y"] or 0
    if not 0 < pos < n:
        return NOTHING
    keys = _useful(sample, n, pos, most_features)
    if not len(keys):
        return NOTHING

    def run(batches):
        for batch in small_batches(batches, 1):
            d, k, c, words = features(batch.column(1).to_pylist())
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[at] == k
            d, at, c = d[hit], at[hit], c[hit]
            ends = np.searchsorted(d, np.arange(len(words) + 1))
            pairs = [(at[s:e].astype("<i4").tobytes(), c[s:e].astype("<u4").tobytes()) for s, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in pairs], pa.binary()), pa.array([x for _, x in pairs], pa.binary())], names=["y", "at", "c"])

    got = sample.mapInArrow(run, "y int, at binary, c binary").collect()
    at = [np.frombuffer(g["at"], "<i4") for g in got]
    doc = np.repeat(np.arange(len(got)), [len(x) for x in at])
    return train(keys, doc, np.concatenate(at), np.concatenate([np.frombuffer(g["c"], "<u4") for g in got]), np.array([g["y"] for g in got]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with severity (the likeliest grade), expected_severity (the mean grade) and toxic."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS and c != text])
    schema = T.StructType([*docs.schema.fields, T.StructField("severity", T.IntegerType()), T.StructField("expected_severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    names, kept = to_arrow_schema(schema).names, docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def run(batches):
        m = shared.value
        for batch in small_batches(batches, kept.index(text)):
            n = batch.num_rows
            above = m.grades(_latent(m, batch.column(kept.index(text)).to_pylist())) if len(m.cuts) else np.zeros((n, GRADES - 1))
            each = np.concatenate([np.ones((n, 1)), above], 1) - np.concatenate([above, np.zeros((n, 1))], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(each.argmax(1), pa.int32()), pa.array(above.sum(1), pa.float64()), pa.array(above[:, 0] >= 0.5, pa.bool_())], names=names)

    return docs.mapInArrow(trimmed(run), schema)
