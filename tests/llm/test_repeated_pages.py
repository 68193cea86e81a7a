import collections

from strandwork.llm import warc


def test_long_rows_of_one_page_id(spark):
    long, other = "<p>long</p>" * 400, "<p>other</p>" * 400
    rows = [(1, "u", long), (1, "u", long), (1, "v", other), (None, "a", long + "x"), (None, "b", other + "y"), (2, "w", long), (None, "a", long + "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), segment=1000, chunk=333).collect()
    want = [(p, u, "revisit" if p == 2 else "response", len(h), 1 if p == 2 else None) for p, u, h in rows]
    assert collections.Counter((r.page_id, r.url, r.kind, r.payload_bytes, r.refers_to) for r in got) == collections.Counter(want)
    assert collections.Counter(r.payload.decode() for r in got if r.kind == "response") == collections.Counter(h for p, _, h in rows if p != 2)


def test_record_ids_are_unique_and_referred_to(spark):
    rows = [(1, "u", "k" * 150), (1, "u", "k" * 150), (3, "u", "k" * 150), (4, "u", "")]
    path = warc.shared_path(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_archives(spark, path).collect()
    ids = [r.id for r in got]
    assert len(set(ids)) == len(rows)
    assert [r.refers_to in ids for r in got if r.kind == "revisit"] == [True]
