"""Cases that the operators must bear: long two-letter words, many batches, clashing names, repeated ids, odd markup."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from strandwork.llm import _packed, backoff, html_extract, ngram_join, nn_descent, pack, substring, warc
from strandwork.llm._store import join_hot
from strandwork.llm._text import Words


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a[:n], a[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [31, 63, 64, 1024, 2048, 4096])
def test_long_words_of_two_letters_differ(n):
    a, b = thue_morse(n)
    h = Words([f"{a} {b} x {a}".encode()]).hash
    assert h[0] == h[3] != h[1]


def test_equal_looking_windows_stay(spark):
    a, b = thue_morse(1024)
    tail = " ".join(f"w{i}" for i in range(2))
    df = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"x {a} {tail}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, [tuple(s) for s in r.repeats]) for r in substring.remove_repeats(df, length=3, anchor=2).collect()}
    assert got == {1: (3, [(0, 3)]), 2: (0, []), 3: (3, [(1, 4)])}
    ids = {r.doc_id: r.ids for r in pack.pieces(df).collect() if r.piece == 0}
    assert ids[1] != ids[2]


def test_two_hops_count_like_one(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {x.doc_id: (x.n_removed, x.kept_text) for x in substring.remove_repeats(df, length=4, anchor=2, batch_bytes=600).collect()}
    scores = {x.doc_id: round(x.log10_score, 6) for x in backoff.score(df, batch_bytes=600).collect()}
    monkeypatch.setattr(_packed, "MOST_LANES", 3)
    assert {x.doc_id: (x.n_removed, x.kept_text) for x in substring.remove_repeats(df, length=4, anchor=2, batch_bytes=600).collect()} == one
    assert {x.doc_id: round(x.log10_score, 6) for x in backoff.score(df, batch_bytes=600).collect()} == scores
    assert sum(n for n, _ in one.values()) > 0


def test_many_batches_get_tasks_of_their_own(spark, monkeypatch):
    from strandwork.llm import _store

    rows = [(i, " ".join("abcdefgh"[(i * j) % 8] for j in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: ({x.doc_id: x.n_removed for x in substring.remove_repeats(df, length=4, anchor=2, batch_bytes=300).collect()}, {x.doc_id: round(x.log10_score, 6) for x in backoff.score(df, batch_bytes=300).collect()})
    want = run()
    monkeypatch.setattr(_store, "GROUPS", 1)
    assert _packed.dealt(df, "text", 9).rdd.getNumPartitions() == 9
    assert run() == want


def test_key_places_and_counts():
    r = np.random.default_rng(1)
    k = np.sort(r.integers(0, 1 << 64, 5000, dtype=np.uint64))
    for parts in (1, 7, 1000):
        p = _packed.ranges(k, parts)
        assert p.tolist() == [int(x) * parts >> 64 for x in k.tolist()]
        assert _packed._within(k, parts).tolist() == [((int(x) * parts) % (1 << 64)) >> 16 for x in k.tolist()]
    n = np.array([0, 1, 254, 255, 1 << 40, 3])
    assert _packed._large(_packed._small(n), len(n)).tolist() == n.tolist()


def test_columns_with_clashing_names_pass(spark):
    df = spark.createDataFrame([(1, "a b c d", 7, "x", 1), (2, "b c d a", 8, "y", 2)], "doc_id long, text string, b int, p string, n int")
    assert {r.doc_id: (r.b, r.p, r.n) for r in substring.remove_repeats(df).collect()} == {1: (7, "x", 1), 2: (8, "y", 2)}
    assert {r.doc_id: (r.b, r.p, r.n) for r in backoff.score(df).collect()} == {1: (7, "x", 1), 2: (8, "y", 2)}
    assert corpus_pipeline.remove_shared_passages(spark, df, "").columns == df.columns
    odd = df.withColumnRenamed("b", "a.b")
    assert corpus_pipeline.keep_one_of_near_copies(spark, odd, "").columns == odd.columns


def test_repeated_ids_with_other_texts(spark):
    words = [f"w{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(reversed(words))
    rows = [(1, base), (1, other), (2, near), (1, base), (3, "quite another text"), (3, None)]
    got = collections.Counter((g.doc_id, g.class_id, g.n_links, g.kept) for g in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter([(1, 1, 2, True), (1, 1, 0, True), (2, 1, 2, False), (1, 1, 2, True), (3, 3, 0, True), (3, 3, 0, True)])
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter([(1, base), (1, other), (3, "quite another text"), (3, None)])


def test_near_copies_without_ids_leave_one(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:-1], "x"])), (None, "alone here"), (None, None), (None, None)]
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(kept) == 3 and [r.text for r in kept].count(None) == 1


def test_repeated_vector_ids(spark):
    r = np.random.default_rng(2)
    x, y = r.standard_normal(8).tolist(), r.standard_normal(8).tolist()
    rows = [(1, x, 0), (1, y, 0), (2, x, 0), (3, y, 0), (None, x, 0), (5, x[:7], 0), (6, x, 1)]
    got = collections.Counter((g.vec_id, g.n_links, g.component_id, g.kept) for g in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == collections.Counter([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (None, 2, 1, None), (5, 0, 5, True), (6, 0, 6, True)])
    assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_low_recall_falls_back_to_all_pairs(spark):
    """One tree of one-vector leaves finds nothing; the audit sees it and all vectors are compared."""
    r = np.random.default_rng(6)
    base = r.standard_normal((40, 8))
    x = np.concatenate([base, base + 0.01 * r.standard_normal((40, 8))])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {g.vec_id: (g.n_links, g.component_id) for g in nn_descent.near_duplicates(df, trees=1, leaf=1, rounds=0).collect()}
    assert got == {i: (1, i % 40) for i in range(80)}


def test_recall_of_the_ngram_search_is_measured(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = []
    for i in range(40):
        w = [f"{i}w{j}" for j in range(80)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-2], "x", f"y{r.random()}"]))]
    classes = ngram_join._classes(ngram_join._sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5))
    nothing = spark.createDataFrame([], "node long, root long")
    assert ngram_join._audit(classes, nothing, 0.8, 256) == 0.0
    roots = classes.select(F.col("c").alias("node"), F.floor(F.col("first.row_id") / 2).alias("root"))
    assert ngram_join._audit(classes, roots, 0.8, 256) == 1.0


def test_hot_keys_join_like_others(spark, monkeypatch):
    from strandwork.llm import _store

    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(i, i) for i in range(1, 20)], "k long, v long")
    one = rows.where("k <> 7").groupBy("k").count()
    want = collections.Counter(map(tuple, rows.join(one, ["k"], "left").collect()))
    monkeypatch.setattr(_store, "HOT", 10)
    assert collections.Counter(map(tuple, join_hot(rows, one, ["k"], "count", 69, "left").collect())) == want


def test_segments_are_written(spark):
    """Pages above a segment's size are reassembled with the parameters of the query."""
    long = "<p>é</p>" * 4000
    df = spark.createDataFrame([(1, "u", long), (2, "u", "short")], "page_id long, url string, html string")
    path = warc.shared_path(spark, "segments")
    warc.write_archives(df, path)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    kinds = collections.Counter(f[b"warc-type"] for x in files for f, _ in warc.parse(warc.gunzipped(bytes(x.content))))
    assert kinds[b"response"] == 2 and kinds[b"continuation"] == -(-len(warc.chunked(long.encode())) // warc.SEGMENT) - 1 + (len(warc.chunked(long.encode())) % warc.SEGMENT > warc.SEGMENT - 120)
    assert {r.payload.decode() for r in warc.read_archives(spark, path).collect()} == {long, "short"}


LINKS = "".join(f'<li><a href="/{i}">Another story number {i}</a></li>' for i in range(8))


def test_threshold_rejects_lists_of_links():
    page = f"<body><article><h1>Title</h1><p>A paragraph of some length, which is the article's text.</p><p>See <a href='x'>this</a> too.</p><p><a href='y'>One linked line</a></p><p>And a last paragraph of text.</p><ul>{LINKS}</ul></article></body>"
    lines = ["Title", "A paragraph of some length, which is the article's text.", "See this too.", "One linked line", "And a last paragraph of text."]
    assert html_extract.extract(page).split("\n") == lines
    assert len(html_extract.extract(page, fraction=0.0).split("\n")) > len(lines)


def test_light_regions_are_rejected():
    teaser = "<article><h2>Teaser</h2><p>Read on</p></article>"
    prose = "".join(f"<p>Paragraph {i} of the text that the page is about, long enough to tell.</p>" for i in range(9))
    assert "Teaser" not in html_extract.extract(f"<body>{teaser}<div>{prose}</div></body>")
    assert "Teaser" in html_extract.extract(f"<body>{teaser}<div>{prose}</div></body>", share=0.0)
    assert html_extract.extract(f"<body><div>Loose</div><article>{prose}</article></body>").startswith("Paragraph 0")


def test_words_of_the_article_itself_stay():
    page = '<article><header><h1>Title</h1></header><p class="warning">Mind the gap.</p><p class="side-note share">Kept too.</p><div class="related"><p>Gone.</p></div></article>'
    assert html_extract.extract(page) == "Title\nMind the gap.\nKept too."


def test_extraction_matches_generated_pages():
    """Pages are made from known lines, with furniture around and between them."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    furniture = [
        lambda: f"<nav><ul>{LINKS}</ul></nav>",
        lambda: f'<div class="ad">{line(9)}</div>',
        lambda: f'<div id="cookieNotice"><p>{line(20)}</p></div>',
        lambda: f"<aside><p>{line(12)}</p></aside>",
        lambda: f"<script>var a = '<p>{line(3)}</p>';</script><style>p {{ margin: 0 }}</style>",
        lambda: f"<form><label>{line(2)}</label><input value='x'><button>{line(1)}</button></form>",
        lambda: f'<section class="comments"><p>{line(15)}</p></section>',
        lambda: f'<div role="complementary">{line(8)}</div>',
    ]
    for _ in range(200):
        lines = [line(r.randint(3, 60)) for _ in range(r.randint(1, 12))]
        parts = [f"<h1>{lines[0]}</h1>"]
        for x in lines[1:]:
            words = x.split(" ")
            at = r.randrange(len(words))
            words[at] = r.choice(["<b>{}</b>", "<a href='/'>{}</a>", "{}", "<em>{}", "\n {} \t"]).format(words[at])
            parts.append(f"<p>{' '.join(words)}" + r.choice(["", "</p>"]))
            if r.random() < 0.3:
                parts.append(r.choice(furniture)())
        head, foot = "".join(f() for f in r.sample(furniture, 3)), r.choice(furniture)()
        page = f"<!DOCTYPE html><html><head><title>{line(4)}</title></head><body>{head}<article>{''.join(parts)}</article>{foot}<footer>&copy; {line(5)}</footer>" + r.choice(["", "</body></html>"])
        assert html_extract.extract(page) == "\n".join(lines)


def test_odd_markup_does_not_stop_the_parser(spark):
    odd = ["<![foo]>x", "<!foo bar>x", "<![CDATA[x", "<?php x", "</", "<", "<!--", "&#xFFFFFFFF;x", "<p", "<script>", "\x00x"]
    assert all(isinstance(html_extract.extract(x), str) for x in odd)
    assert html_extract.extract("<p>a<![endif]>b</p>") == "ab"
    deep = html_extract.extract("<div>" * 20000 + "</x>" * 20000 + "text")
    assert deep == "text"
    df = spark.createDataFrame([(i, "u", x) for i, x in enumerate(odd)], "page_id long, url string, html string")
    assert html_extract.extract_pages(df).count() == len(odd)
