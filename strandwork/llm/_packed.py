"""Counting hashed keys over all documents with packed exchanges.

Documents are dealt to batches of a few MB. A batch sends its distinct keys, sorted, as one binary row for each
hash range; a range adds up the counts of all batches and answers each batch with the totals in the same order,
so neither document ids nor positions travel. A key that stands in a third of all rows arrives once per batch.

The hash range is part of a key, so 48 further bits travel, and with a check 80. The ranges grow in number with the
corpus, so a range holds some million keys and its keys meet by chance at a rate that does not grow.

Batches and ranges grow together, so a batch would send ever smaller blobs. Beyond MOST_LANES batches keys therefore
take two hops: a batch sends to the square root of as many groups of ranges (lanes), and in each of these a team of
batches merges its keys before it sends them on; totals come back the same way. With n batches n * sqrt(n) blobs of
some kilobytes travel each time, and no task holds more keys than about a batch has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._store import cut, spread
from strandwork.llm._text import trimmed

BATCH = "__strandwork_batch"
MOST_LANES = 4096
BLOBS = "p int, b int, k binary, c binary, n binary"
REPLIES = "b int, p int, n binary"
_BLOBS = pa.schema([("p", pa.int32()), ("b", pa.int32()), ("k", pa.binary()), ("c", pa.binary()), ("n", pa.binary())])
_REPLIES = pa.schema([("b", pa.int32()), ("p", pa.int32()), ("n", pa.binary())])


def dealt(docs: DataFrame, text: str, batches: int) -> DataFrame:
    """docs with its batch in column BATCH; equal rows may share a batch, other rows spread by id and text."""
    keys = [F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("bigint", "int", "string")]
    return spread(docs.withColumn(BATCH, F.pmod(F.xxhash64(*(keys or [F.col(text)])), F.lit(batches)).cast("int")), BATCH, batches)


class Distinct:
    """The distinct keys of a batch in key order; of[i] is the place of key i among them, count its occurrences."""

    def __init__(self, k: np.ndarray, c: np.ndarray | None = None):
        order = np.argsort(k, kind="stable") if c is None else np.lexsort((c, k))
        ks = k[order]
        new = np.ones(len(ks), bool)
        new[1:] = ks[1:] != ks[:-1]
        if c is not None:
            cs = c[order]
            new[1:] |= cs[1:] != cs[:-1]
        at = np.flatnonzero(new)
        self.k, self.c = ks[at], None if c is None else cs[at]
        self.count = np.diff(np.append(at, len(ks)))
        self.of = np.empty(len(k), np.int64)
        self.of[order] = np.cumsum(new) - 1


def ranges(k: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each key, floor(k * parts / 2**64); keys in order have ranges in order."""
    n, low = np.uint64(parts), np.uint64(0xFFFFFFFF)
    return ((k >> np.uint64(32)) * n + ((k & low) * n >> np.uint64(32)) >> np.uint64(32)).astype(np.int32)


_GAP = np.uint64((1 << 40) - 1)


def _within(k: np.ndarray, parts: int) -> np.ndarray:
    """48 bits of each key's place within its hash range, in key order."""
    return k * np.uint64(parts) >> np.uint64(16)


def _gaps(place: np.ndarray) -> bytes:
    """Ascending places: their number, the gaps in five bytes each, then the gaps that need more."""
    gap = np.diff(place, prepend=np.uint64(0))
    short = np.ascontiguousarray(np.minimum(gap, _GAP).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
    return len(place).to_bytes(4, "little") + short.tobytes() + gap[gap >= _GAP].astype("<u8").tobytes()


def _size(data: bytes) -> int:
    return int.from_bytes(data[:4], "little")


def _places(data: bytes) -> np.ndarray:
    n = _size(data)
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 4).reshape(-1, 5)
    gap = out.view("<u8").ravel()
    gap[gap == _GAP] = np.frombuffer(data, "<u8", offset=4 + 5 * n)
    return np.cumsum(gap, dtype=np.uint64)


def _small(n: np.ndarray) -> bytes:
    """Counts as a byte each; those of 255 and more follow with eight bytes, in order."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u8").tobytes()


def _large(data: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=size)
    return out


def blobs(b: int, d: Distinct, parts: int, count: np.ndarray | None = None, first: int = 0) -> pa.Table:
    """One row for each hash range that the batch has keys in; ranges are numbered from `first`."""
    count = d.count if count is None else count
    p = ranges(d.k, parts)
    cuts = np.flatnonzero(np.diff(p, prepend=-1)) if len(p) else np.empty(0, int)
    ends = np.append(cuts[1:], len(p))
    place = _within(d.k, parts)
    rows = [(first + int(p[s]), b, _gaps(place[s:e]), None if d.c is None else d.c[s:e].astype("<u4").tobytes(), _small(count[s:e])) for s, e in zip(cuts, ends)]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _BLOBS)], schema=_BLOBS) if rows else _BLOBS.empty_table()


def totals(replies: pa.Table, k: np.ndarray, parts: int, first: int = 0) -> np.ndarray:
    """The totals of a batch's distinct keys k, in their order."""
    size = np.bincount(ranges(k, parts), minlength=parts) if len(k) else np.zeros(parts, np.int64)
    rows = sorted(zip(replies.column("p").to_pylist(), replies.column("n").to_pylist()))
    if [p - first for p, _ in rows] != np.flatnonzero(size).tolist():
        raise ValueError("the batch was not read back as it was sent")
    return np.concatenate([_large(x, int(size[p - first])) for p, x in rows]) if rows else np.empty(0, np.int64)


def _summed(table: pa.Table) -> tuple[Distinct, np.ndarray, list[int]]:
    """The distinct keys of all blobs of one range or lane (places shifted to 64 bits), their counts, and the keys per blob."""
    k, c, n = (table.column(x).to_pylist() for x in ("k", "c", "n"))
    key = np.concatenate([_places(x) for x in k]) << np.uint64(16)
    d = Distinct(key, None if c[0] is None else np.frombuffer(b"".join(c), "<u4"))
    size = [_size(x) for x in k]
    count = np.zeros(len(d.k), np.int64)
    np.add.at(count, d.of, np.concatenate([_large(x, m) for x, m in zip(n, size)]))
    return d, count, size


def _answers(table: pa.Table, each: np.ndarray, size: list[int]) -> pa.Table:
    at = np.cumsum([0, *size])
    back = (table.column(x).combine_chunks().cast(pa.int32()) for x in ("b", "p"))
    return pa.Table.from_arrays([*back, pa.array([_small(each[s:e]) for s, e in zip(at, at[1:])], pa.binary())], schema=_REPLIES)


def _tally(table):
    d, count, size = _summed(table)
    return _answers(table, count[d.of], size)


def lanes(batches: int) -> int:
    """How many ranges, or groups of ranges, a batch sends to."""
    return batches if batches <= MOST_LANES else int(np.ceil(np.sqrt(batches)))


def tally(sent: DataFrame, batches: int) -> DataFrame:
    """Replies (b, p, n) to the blobs of all batches, made for lanes(batches) ranges."""
    n = lanes(batches)
    if n == batches:
        return spread(spread(sent, "p", n).groupBy("p").applyInArrow(trimmed(_tally), REPLIES), "b", batches)
    fan = -(-batches // n)  # ranges of a lane
    teams = cut(sent, "sent").withColumn("s", F.col("b") % n)  # lane p, team s

    def merge(key, table):
        p, s = (x.as_py() for x in key)
        d, count, _ = _summed(table)
        return blobs(p * n + s, d, fan, count, p * fan)

    def split(key, table, replies):
        d, _, size = _summed(table)
        return _answers(table, totals(replies, d.k, fan, key[0].as_py() * fan)[d.of], size)

    merged = teams.groupBy("p", "s").applyInArrow(trimmed(merge), BLOBS)
    replies = merged.groupBy("p").applyInArrow(trimmed(_tally), REPLIES)
    replies = replies.select(F.floor(F.col("b") / n).cast("int").alias("lane"), (F.col("b") % n).alias("s"), "p", "n")
    return spread(teams.groupBy("p", "s").cogroup(replies.groupBy("lane", "s")).applyInArrow(trimmed(split), REPLIES), "b", batches)
