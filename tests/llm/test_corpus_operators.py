import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import backoff, fingerprint, html_extract, mixing, ngram_join, nn_descent, pack, substring, toxicity, warc
from strandwork.llm._graph import components
from strandwork.llm._store import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_words long"


def corpus(n=60, seed=0, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]
    passage = " ".join(words[:50])
    for i in range(0, n, 5):
        texts[i] += " " + passage + "\n" + r.choice(words)
    texts[1] = texts[2] = texts[3]
    near = texts[4].split()
    if near:
        texts[6] = " ".join([*near[:-1], "changed"])
    return [*((i, t, f"s{i % 4}", 7) for i, t in enumerate(texts)), (n, "", None, 7), (n + 1, None, "s1", 7), (n + 2, "one", "", 7), (n, "", None, 7)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_matches_brute_force(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.remove_repeats(docs, batch_bytes=4000).collect())
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    want = collections.Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert got == want
    assert substring.remove_repeats(empty).count() == 0


def test_substring_other_lengths(spark):
    texts = ["a b c a b c a b c", "x a b c y", "z z z z z", "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in substring.remove_repeats(df, length=3, anchor=2).collect()}
    assert got == {0: "", 1: "x y", 2: "", 3: "q"}


def test_scoring_matches_brute_force(docs, rows, empty):
    import math

    words = [WORD.findall(t or "") for _, t, *_ in rows]
    c = [None] + [collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total, want = sum(map(len, words)), []
    for (doc, *_), w in zip(rows, words):
        own = [None] + [collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
        n = lambda g: c[len(g)][g] - own[len(g)][g]  # noqa: E731, B023
        score = 0.0
        for i in range(len(w)):
            most = min(i, 2)
            for k in range(most, -1, -1):
                g = tuple(w[i - k : i + 1])
                if n(g) > 0:
                    score += math.log10(n(g) / (n(g[:-1]) if k else total - len(w))) + (most - k) * math.log10(0.4)
                    break
            else:
                score += math.log10(0.4 / (total - len(w) + 1)) + most * math.log10(0.4)
        want.append((doc, len(w), round(score, 6)))
    got = [(r.doc_id, r.n_words, round(r.log10_score, 6)) for r in backoff.score(docs, batch_bytes=4000).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert backoff.score(empty).count() == 0


def test_packing_pieces_and_plan(spark, docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    long = "naïve tokens, 12 of them!\n\n" * 400
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500, long), (501, " lead and trail  "), (502, "a b \x1c c <|endoftext|> 😀\n\n世")], "doc_id long, text string"))
    whole = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in df.collect()}
    got = pack.pieces(df).collect()
    for doc, want in ids.items():
        parts = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        parts = parts[: len(parts) // sum(r.piece == 0 for r in parts)] if doc != rows[60][0] else parts[:1]
        assert b"".join(r.ids for r in parts) == np.array(want, "<u4").tobytes()
        assert [r.length for r in parts[1:]] == [1024] * (len(parts) - 1)
    placed = pack.pack_documents(df).collect()
    by = collections.defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(placed) == len(got)
    assert pack.pack_documents(empty).count() == 0


def test_plan_is_tight():
    r = random.Random(1)
    counts = collections.Counter(min(1024, int(r.expovariate(1 / 300)) + 1) for _ in range(20000))
    table = pack.plan(counts)
    assert sum(int(x[2]) for x in table) == 20000
    bins = {int(b) + k for _, _, n, b, _ in table for k in range(int(n))}
    least = -(-sum(s * n for s, n in counts.items()) // 1024)
    assert len(bins) <= 1.01 * least


def test_fingerprints(spark, docs, rows, empty):
    got = fingerprint.fingerprints(docs).collect()
    order = sorted(rows, key=lambda x: (-x[0], x[1] or ""))
    want = collections.Counter()
    for i, (doc, t, *_) in enumerate(order):
        t, u = t or "", order[(i + 1) % len(order)][1] or ""
        want[doc, len(t), t[: len(t) - len(t) // 2] + u[: len(t) // 2]] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_text) for r in got) == want
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[1] == same[2] == same[3] != same[4]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprints(empty).count() == 0


def test_sketches_recover_differences():
    r = random.Random(2)
    line = lambda: " ".join(r.choice("abcdefgh") * 3 for _ in range(30))
    a = ["\n".join(line() for _ in range(12)) for _ in range(20)]
    b = [x.replace("aaa", "zzz") if i % 2 else x for i, x in enumerate(a)]
    p, q = fingerprint.Pieces([x.encode() for x in a]), fingerprint.Pieces([x.encode() for x in b])
    want = [len(set(p.key[p.lo[i] : p.lo[i + 1]]) ^ set(q.key[q.lo[i] : q.lo[i + 1]])) for i in range(20)]
    assert fingerprint.differing(p, q, cells=6).tolist() == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name and a slogan</p></header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies on this page to make it better for all of you.</div><article><h1>Ti&amp;tle &eacute;</h1><p>First <b>bold</b>
 text<br>goes on for quite a while here.<p>Short.</p><script>var a = "<p>no</p>";</script><aside>Related things</aside><form><p>Name</p></form></article>
<section id="comments"><p>Nice post, I liked it very much indeed, thanks a lot.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_html_extraction(spark):
    assert html_extract.extract(PAGE) == "Ti&tle é\nFirst bold text goes on for quite a while here.\nShort."
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "just text"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.text) for r in html_extract.extract_pages(df).collect())
    assert got[1, html_extract.extract(PAGE)] == 2 and got[2, ""] == got[3, ""] == got[4, "just text"] == 1


def test_toxicity(spark):
    r = random.Random(4)
    plain, bad = [f"word{i}" for i in range(300)], ["idiot", "scum", "moron"]
    texts, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(r.randint(1, 6)):
                w.insert(r.randrange(len(w)), r.choice(bad).upper() + ",")
        texts.append((i, " ".join(w), "kept"))
        if i < 400:
            labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*texts, (600, None, None), (601, "", "x")], "doc_id long, text string, toxic string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(400, 600))
    assert not got[600].toxic and not got[601].toxic and got[600].severity == 0
    few, many = (min, max)
    count = lambda i: sum(w.strip(",").lower() in bad for w in texts[i][1].split())
    sick = range(400, 600, 5)
    assert got[few(sick, key=count)].expected_severity < got[many(sick, key=count)].expected_severity
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).where("toxic").count() == 0


def test_warc_round_trip(spark):
    big = "é<p>x</p>WARC/1.1\r\n\r\n" * 3000
    rows = [(5, "u a", big), (2, "u", big), (3, None, None), (4, "z", "short"), (9, "z", "short"), (1, "k", "k" * 150), (7, "k", "k" * 150), (11, "k", "")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), segment=1000, chunk=333).collect()}
    assert len(got) == len(rows)
    assert {i: (r.kind, r.refers_to) for i, r in got.items() if r.kind == "revisit"} == {5: ("revisit", 2), 7: ("revisit", 1)}
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].digest == hashlib.sha256(body).hexdigest()
        assert got[i].kind == "revisit" or got[i].payload == body
    assert warc.dechunked(warc.chunked(b"abc" * 999, 10)) == b"abc" * 999
    with pytest.raises(ValueError):
        warc.joined([1, 3], [None, 4], [b"ab", b"cd"])
    with pytest.raises(ValueError):
        warc.joined([1, 2], [None, 5], [b"ab", b"cd"])


def test_embeddings_match_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((12, 16))
    x = np.concatenate([base[r.integers(0, 12, 160)] + 0.07 * r.standard_normal((160, 16)), r.standard_normal((60, 16)), np.repeat(base[:1], 20, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, x[0].tolist(), None), (904, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")
    got = {g.vec_id: g for g in nn_descent.near_duplicates(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    hit = (y @ y.T >= 0.98) & (np.arange(len(y))[:, None] % 2 == np.arange(len(y))[None, :] % 2)
    assert [got[i].n_links for i in range(len(y))] == (hit.sum(1) - 1).tolist()
    root = np.arange(len(y))
    for _ in range(len(y)):
        root = np.array([root[hit[i]].min() for i in range(len(y))])
    assert [got[i].component_id for i in range(len(y))] == root.tolist()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (900, 901, 902, 903, 904))


def brute_links(rows, n=5, threshold=0.8):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    links = [[] for _ in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i].append(j)
    return links


def test_ngram_join_matches_brute_force(spark, docs, rows, empty):
    r = random.Random(6)
    more = [r.choice(rows)[1] or "" for _ in range(40)]
    more = [" ".join(x if r.random() > 0.01 else "edit" for x in t.split()) for t in more]
    every = [*rows, *((1000 + i, t, "x", 1) for i, t in enumerate(more))]
    links = brute_links(every)
    root = list(range(len(every)))
    for _ in every:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(every))]
    got = collections.Counter((g.doc_id, g.class_id, g.n_links) for g in ngram_join.near_duplicates(spark.createDataFrame(every, DOCS), block=8).collect())
    low = {}
    for i, k in enumerate(root):
        low[k] = min(low.get(k, 1 << 60), every[i][0])
    assert got == collections.Counter((every[i][0], low[root[i]], len(links[i])) for i in range(len(every)))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_ngram_join_splits_large_buckets(spark):
    r = random.Random(7)
    base = [f"b{i}" for i in range(80)]
    rows = [(i, " ".join(x if r.random() > 0.01 else f"e{r.randrange(9999)}" for x in base), "s", 1) for i in range(60)]
    links = brute_links(rows)
    got = {g.doc_id: g.n_links for g in ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS), small=4, block=16).collect()}
    assert got == {i: len(x) for i, x in enumerate(links)}


def test_mixing(spark, docs, empty):
    sized = docs.withColumn("size", mixing.n_words()).drop("n_words")
    got = mixing.mix(cut(sized, "test")).collect()
    by = collections.defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        x = by[r.source]
        x[0], x[1], x[2], x[3] = x[0] + r.size, r.target, x[2] + r.taken, r.source_size
    total = sum(x[0] for x in by.values())
    for size, target, taken, source_size in by.values():
        assert size == source_size and abs(target - taken) <= 3 and target <= 3 * size + 1e-6
    assert sum(x[1] for x in by.values()) == pytest.approx(total)
    again = mixing.mix(cut(sized, "test")).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(empty.withColumn("size", F.lit(1).cast("long"))).count() == 0


def test_targets_reshare(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 500)], "source string, n long")
    got = {r.source: r.target for r in mixing.targets(df, "source", "n").collect()}
    assert got["c"] == 15 and got["a"] == 30 and sum(got.values()) == pytest.approx(1515)
    assert got["b"] == pytest.approx(1470 * 2 / 3) and got[None] == pytest.approx(1470 / 3)


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)]
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got.get(v, v) == k for v, k in root.items())
