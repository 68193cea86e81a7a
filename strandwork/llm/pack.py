"""Best-fit packing of token pieces into sequences of a fixed capacity, by sums of squares.

Only the counts of pieces per length decide the packing, so the driver plans with a table of at most `capacity`
rows whatever the corpus's size: longest pieces first, each goes to the open bin for which the sum of the squared
counts of open bins per residual gap becomes smallest; a bin is opened only when no open one holds the piece. Equal
pieces are placed in lots of a 1/64 of their count, at least one, so the plan's length is bounded too. A plan entry
says: of length s, the pieces ranked r.. go to the bins b.. at offset o. Ranks come from counts per length and hash
bucket plus a window inside the bucket, so no length, however frequent, meets in one task.

Defined cases: null or empty text is the end-of-document id alone; repeated rows are packed once each; an empty
table gives no rows; extra columns of documents are left behind by pieces() and kept by pack().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandwork.llm._store import cut
from strandwork.llm._text import texts_of, trimmed

CAPACITY = 1024
END = 2
LOTS = 64
BUCKETS = 128
STEP_BYTES = 4 << 20
TOKENIZER = "byte_bpe_50k.json"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per piece: doc_id, piece, start, length and ids (little-endian unsigned 32-bit).

    A document's ids end with `end`. Only documents of more than `capacity` ids are cut, the first piece takes what
    the full ones leave.
    """
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches):
        from strandwork.llm.tokens import encoder

        def emit(keys, texts):
            rows: list[list] = [[] for _ in names]
            for k, ids in zip(keys, encoder(tokenizer).encode([t or b"" for t in texts])):
                whole = np.append(ids, end).astype("<u4")
                n = len(whole)
                first = (n - 1) % capacity + 1
                for i, e in enumerate(range(first, n + 1, capacity)):
                    s = e - (capacity if i else first)
                    for column, v in zip(rows, (k, i, s, e - s, whole[s:e].tobytes())):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

        keys, texts, size = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                keys.append(k)
                texts.append(t)
                size += len(t or b"")
                if size >= STEP_BYTES:
                    yield emit(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield emit(keys, texts)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY, lots: int = LOTS) -> np.ndarray:
    """Rows (length, first rank, pieces, first bin, offset), ordered by length and rank."""
    open_bins = np.zeros(capacity + 1, np.int64)
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    out, bins = [], 0
    far = np.float64(np.inf)
    for s in sorted(counts, reverse=True):
        left, rank, lot = counts[s], 0, max(1, counts[s] // lots)
        while left:
            fits = np.flatnonzero(open_bins[s:]) + s
            if not len(fits):
                out.append((s, rank, left, bins, 0))
                if s < capacity:
                    runs.setdefault(capacity - s, []).append((bins, left))
                    open_bins[capacity - s] += left
                bins += left
                break
            n = open_bins[fits].astype(float)
            q = np.minimum(min(lot, left), n)
            to = open_bins[fits - s].astype(float)
            # the change of the sum of squares, per piece: q bins leave gap g and, unless full, join gap g - s
            change = ((n - q) ** 2 - n**2 + np.where(fits > s, (to + q) ** 2 - to**2, 0.0)) / q
            g = int(fits[np.where(np.isnan(change), far, change).argmin()])
            take = int(min(lot, left, open_bins[g]))
            open_bins[g] -= take
            if g > s:
                open_bins[g - s] += take
            left -= take
            while take:
                first, many = runs[g].pop()
                k = min(take, many)
                if many > k:
                    runs[g].append((first + k, many - k))
                out.append((s, rank, k, first, capacity - g))
                if g > s:
                    runs.setdefault(g - s, []).append((first, k))
                rank, take = rank + k, take - k
    table = np.array(out, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(rows: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """rows (with a length from 1 to capacity each) with sequence_id and offset; lengths alone decide.

    `rows` is read twice, so it should be a table or a cut; null lengths stay unplaced (null sequence_id).
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("sequence_id", "offset")])
    keys = [F.col(c) for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct", "binary"))]
    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    counted = bucketed.groupBy(length, "__bucket").count().where(F.col(length).isNotNull()).collect()  # at most capacity * BUCKETS rows
    count = np.zeros((capacity + 1, BUCKETS), np.int64)
    for n, b, c in counted:
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} ids does not fit {capacity}")
        count[n, b] = c
    base = np.cumsum(count, 1) - count
    table = plan({int(n): int(count[n].sum()) for n in np.flatnonzero(count.sum(1))}, capacity)
    by_length = {int(n): table[table[:, 0] == n] for n in np.unique(table[:, 0])}
    ranked = bucketed.withColumn("__rank", F.row_number().over(Window.partitionBy(length, "__bucket").orderBy(*keys)))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast((base, by_length))
    names, kept = to_arrow_schema(schema).names, rows.columns

    def place(batches):
        base, by_length = shared.value
        for batch in batches:
            n = np.array([x or 0 for x in batch.column(length).to_pylist()], np.int64)
            rank = base[n, np.array(batch.column("__bucket"))] + np.array(batch.column("__rank")) - 1
            bins, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for size in np.unique(n[n > 0]):
                at, entries = np.flatnonzero(n == size), by_length[int(size)]
                e = entries[np.searchsorted(entries[:, 1], rank[at], "right") - 1]
                bins[at], offset[at] = e[:, 3] + rank[at] - e[:, 1], e[:, 4]
            gone = n == 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bins, pa.int64(), mask=gone), pa.array(offset, pa.int64(), mask=gone)], names=names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset. The ids themselves are those of pieces()."""
    rows = pieces(docs, key, text, capacity, end, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut(rows, "pieces"), capacity)
