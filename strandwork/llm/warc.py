"""WARC archives of pages: written with segmented records and chunked transfer framing, read back by reassembly.

Writing: each page is an HTTP response in chunked transfer framing. Of equal payloads of at least `least` bytes, the
one with the smallest page_id is a response, the others are revisit records without a body that name it. A record
block longer than `segment` bytes is split into a first record and continuation records with
WARC-Segment-Origin-ID, WARC-Segment-Number and, on the last, WARC-Segment-Total-Length. Spark's text sink writes
the files, record by record, so archives land wherever Spark can write, and lost tasks are written again. Every row has
a number of its own in its record id, fixed in a cut before ids are used, so rows of one page_id stay apart.

Reading: files are parsed by Content-Length. A record without segments is decoded where it is read; segments are
grouped by origin identifier, ordered by number, checked for gaps and against the total length, then joined; the HTTP
head is parsed and chunked framing is decoded. Only segmented records are shuffled.

Defined cases: null html is an empty payload; payloads under `least` bytes are always responses; among rows with the
same payload and the smallest page_id all are responses; null page_id counts as the largest; an empty table gives no
rows; a gap, a wrong length or broken chunk framing raises ValueError; extra columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm._store import cut, drop_cut, shared_path

SEGMENT = 1 << 13
CHUNK = 1 << 12
LEAST = 100
ROW_BYTES = 1 << 20
FILE_ROWS = 24
MOST_BROADCAST = 20_000
DATE = "2020-01-01T00:00:00Z"
CRLF = b"\r\n"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for i in range(0, len(body), size):
        part = body[i : i + size]
        parts += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes:
    out, i = [], 0
    while True:
        e = data.find(CRLF, i)
        if e < 0:
            raise ValueError("chunk size missing")
        n = int(data[i:e].split(b";")[0], 16)
        i = e + 2
        if n == 0:
            return b"".join(out)
        if data[i + n : i + n + 2] != CRLF:
            raise ValueError("a chunk does not end with CRLF")
        out.append(data[i : i + n])
        i += n + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response block, transfer framing removed."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("an HTTP response without a head")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(CRLF)[1:])}
    return dechunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the two line ends after its block, which the sink's line separator adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def _name(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:row:{row}>"


def page_records(page_id: int | None, row: int, url: str | None, html: bytes, digest: str, refers_to: tuple[int, int] | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a row; a revisit's refers_to is the page_id and row of the response that it repeats."""
    common = [("WARC-Record-ID", _name(page_id, row)), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record([("WARC-Type", "revisit"), *common, profile, ("WARC-Refers-To", _name(*refers_to)), ("X-Payload-Bytes", str(len(html))), kind], http + CRLF)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(html, chunk)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *common, kind], block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1"), kind], parts[0])
    for i, part in enumerate(parts[1:], 2):
        last = i == len(parts)
        own = ("WARC-Record-ID", f"{_name(page_id, row)[:-1]}:segment:{i}>")
        yield record([("WARC-Type", "continuation"), own, *common[1:3], ("WARC-Segment-Origin-ID", _name(page_id, row)), ("WARC-Segment-Number", str(i)), ("WARC-Segment-Total-Length", str(len(block)) if last else None)], part)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Writes the pages' WARC files under path, gzipped."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n", F.octet_length("html"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    # Only pages that repeat an earlier one are looked up; counts and smallest ids are made before the shuffle.
    smallest = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")))
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(smallest.alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = cut(first.select(F.col("digest").alias("again"), F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row")), "repeated")
    small = first.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    kept = rows.join(F.broadcast(first) if small else first, (F.col("digest") == F.col("again")) & (F.col("n") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kept = kept.select("page_id", "row", "url", "html", "digest", "first", "first_row", revisit.alias("revisit"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for pid, row, u, body, d, f, f_row, again in zip(*(batch.column(i).to_pylist() for i in range(8))):
                for r in page_records(pid, row, u, body.encode(), d, (f, f_row) if again else None, segment, chunk):
                    held.append(r)
                    size += len(r)
                    if size >= ROW_BYTES:  # a row of the sink holds several records, so files stay within FILE_ROWS of them
                        yield pa.RecordBatch.from_arrays([pa.array([(CRLF + CRLF).join(held)], pa.binary())], names=["r"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([(CRLF + CRLF).join(held)], pa.binary())], names=["r"])

    lines = kept.mapInArrow(run, "r binary").select(F.col("r").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)
    drop_cut(rows)


def parse(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Records of an uncompressed archive: fields by lower-case name, block."""
    i = 0
    while i < len(data):
        e = data.find(b"\r\n\r\n", i)
        lines = data[i:e].split(CRLF)
        if e < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        n = int(fields[b"content-length"])
        block = data[e + 4 : e + 4 + n]
        if len(block) != n:
            raise ValueError("a record is cut off")
        yield fields, block
        i = e + 4 + n + 4


def gunzipped(data: bytes) -> bytes:
    """All members of a gzip file; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


RECORDS = "id string, kind string, url string, digest string, refers_to string, payload binary, payload_bytes long, origin string, number int, total long, block binary"
_RECORDS = pa.schema([("id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _field(fields: dict[bytes, bytes], name: bytes) -> str | None:
    return fields[name].decode() if name in fields else None


def _row(f: dict[bytes, bytes], block: bytes, number: str | None) -> tuple:
    kind, total, name = _field(f, b"warc-type"), _field(f, b"warc-segment-total-length"), _field(f, b"warc-record-id")
    digest = (_field(f, b"warc-payload-digest") or "").rpartition(":")[2] or None
    body = None if number or kind != "response" else payload_of(block)
    size = len(body) if body is not None else int(_field(f, b"x-payload-bytes") or 0) if kind == "revisit" else None
    origin = (_field(f, b"warc-segment-origin-id") or name) if number else None
    return (name, kind, _field(f, b"warc-target-uri"), digest, _field(f, b"warc-refers-to"), body, size, origin, int(number) if number else None, int(total) if total else None, block if number else None)


def joined(numbers: list[int], totals: list[int | None], blocks: list[bytes]) -> bytes:
    """The block of a segmented record: by number, without gaps, of the length that its last segment states."""
    order = sorted(range(len(numbers)), key=numbers.__getitem__)
    if [numbers[i] for i in order] != list(range(1, len(order) + 1)):
        raise ValueError(f"segments {sorted(numbers)} are not 1 to {len(order)}")
    block = b"".join(blocks[i] for i in order)
    if (total := totals[order[-1]]) != len(block):
        raise ValueError(f"{len(block)} bytes, the last segment says {total}")
    return block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per archived page: id (WARC-Record-ID), kind (response or revisit), url, digest, refers_to, payload, payload_bytes."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(segmented):
        def read(batches):
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    rows: list[list] = [[] for _ in _RECORDS]
                    size = 0
                    for f, block in parse(gunzipped(content)):
                        number = _field(f, b"warc-segment-number")
                        if bool(number) != segmented:
                            continue
                        for column, v in zip(rows, _row(f, block, number)):
                            column.append(v)
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _RECORDS)], schema=_RECORDS)
                            rows, size = [[] for _ in _RECORDS], 0
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _RECORDS)], schema=_RECORDS)

        return read

    def whole(table):
        kind, number, total, block = (table.column(c).to_pylist() for c in ("kind", "number", "total", "block"))
        first = kind.index("response")
        body = payload_of(joined(number, total, block))
        row = table.slice(first, 1).select(["id", "kind", "url", "digest", "refers_to"])
        return row.append_column("payload", pa.array([body], pa.binary())).append_column("payload_bytes", pa.array([len(body)], pa.int64()))

    columns = ["id", "kind", "url", "digest", "refers_to", "payload", "payload_bytes"]
    parts = files.mapInArrow(run(True), RECORDS).groupBy("origin").applyInArrow(whole, RECORDS.split(", origin")[0])
    return files.mapInArrow(run(False), RECORDS).select(columns).unionByName(parts)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back: page_id, url, kind, payload, digest, payload_bytes, refers_to."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, key, url, html, segment, chunk, least)
    read = read_archives(spark, path)
    number = lambda c: F.regexp_extract(F.col(c), r"^<urn:page:(-?\d+):row:\d+>$", 1).try_cast("long")
    return read.select(number("id").alias("page_id"), "url", "kind", "payload", "digest", "payload_bytes", number("refers_to").alias("refers_to"))

