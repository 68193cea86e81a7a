import math
import random

import numpy as np
from pyspark.sql import functions as F

from strandwork.llm import fingerprint, toxicity


def loss(w, cuts, x, grade, penalty):
    """Penalised negative log-likelihood of grades under P(grade <= k) = logistic(cut_k - w.x), written out per text."""
    total = 0.0
    for row, g in zip(x, grade):
        upto = [0.0, *(1 / (1 + math.exp(-(c - float(row @ w)))) for c in cuts), 1.0]
        total -= math.log(max(upto[g + 1] - upto[g], 1e-12))
    return total / len(x) + penalty * float(w @ w) / 2


def test_training_reaches_a_stationary_point():
    r = np.random.default_rng(1)
    n, m, penalty = 240, 5, 1e-2
    count = r.poisson(0.7, (n, m))
    toxic = (count[:, 0] + count[:, 1] + r.random(n) > 2.2).astype(int)
    doc, place = np.nonzero(count)
    model = toxicity.train(np.arange(m, dtype=np.uint64), doc, place, count[doc, place], toxic, steps=3000, penalty=penalty)
    x = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0.0)
    hits = x.sum(1)
    grade = np.where(toxic == 1, 1 + np.searchsorted(np.quantile(hits[toxic == 1], [1 / 3, 2 / 3]), hits, "right"), 0)
    assert list(model.cuts) == sorted(model.cuts)
    best, eps = loss(model.weights, model.cuts, x, grade, penalty), 1e-3
    for i in range(m + 3):
        for sign in (1, -1):
            w, c = model.weights.copy(), model.cuts.copy()
            if i < m:
                w[i] += sign * eps
            else:
                c[i - m] += sign * eps
            if list(c) == sorted(c):
                assert loss(w, c, x, grade, penalty) > best - 2e-6
    assert best < loss(np.zeros(m), model.cuts, x, grade, penalty)


def test_held_out_accuracy(spark):
    r = random.Random(2)
    plain, bad = [f"w{i}" for i in range(400)], [f"bad{i}" for i in range(6)]
    rows, labels = [], []
    for i in range(900):
        words = [r.choice(plain) for _ in range(r.randint(20, 120))]
        if i % 6 == 0:
            for _ in range(r.randint(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int"))
    got = {x.doc_id: x.toxic for x in toxicity.score(docs.where(F.col("doc_id") >= 600), model).collect()}
    assert sum(got[i] == (i % 6 == 0) for i in got) >= 0.98 * len(got)


def test_likeness_is_the_jaccard_index_of_pieces(spark):
    r = random.Random(3)
    line = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(40))
    texts = ["\n".join(line() for _ in range(r.randint(1, 6))) for _ in range(12)] + ["", None]
    texts.append((texts[0] or "")[:-1] + "!")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = [t or "" for t in reversed(texts)]

    def index(a, b):
        p = fingerprint.Pieces([a.encode(), b.encode()])
        x, y = (set(p.key[p.lo[i] : p.lo[i + 1]].tolist()) for i in (0, 1))
        return len(x & y) / len(x | y) if x | y else 1.0

    got = {x.doc_id: x for x in fingerprint.fingerprints(df).collect()}
    for i, t in enumerate(order):
        u, half = order[(i + 1) % len(order)], len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        x = got[len(order) - 1 - i]
        assert x.edited_text == edited
        assert math.isclose(x.near_next, index(t, u)) and math.isclose(x.near_edited, index(t, edited))
        assert x.fingerprint == fingerprint.encode(fingerprint.Pieces([t.encode()]))[0]


def test_only_row_and_null_ids(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(None, "only\ntext")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.near_next) for x in one] == [(None, 1.0)]
