"""Vectorised word and window hashing over whole batches of texts.

A batch is one byte buffer in which every document ends with a newline. Words are runs of bytes other than
space and 0x09-0x0D; these separators are ASCII, so splitting UTF-8 bytes and splitting code points agree.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

U64 = np.uint64
TOP = U64(0xFFFFFFFFFFFFFFFF)
_MULT = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20
LONG = 64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_TAB = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and its inverse modulo 2**64, for i < n."""
    with np.errstate(over="ignore"):
        up, down = np.full(n, _MULT, U64), np.full(n, pow(_MULT, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


@lru_cache(1)
def _trimmer():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def trim() -> None:
    """Gives freed memory back to the system: a reused worker would keep the peak of each stage it has served."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def trimmed(f):
    """f, followed by trim(); for functions on a group (their number of arguments is kept) or on a stream of batches."""
    import inspect

    if inspect.isgeneratorfunction(f):

        def stream(batches):
            yield from f(batches)
            trim()

        return stream

    def done(*a):
        try:
            return f(*a)
        finally:
            trim()

    n = len(inspect.signature(f).parameters)
    return {1: lambda a: done(a), 2: lambda a, b: done(a, b), 3: lambda a, b, c: done(a, b, c)}[n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ U64(salt)
        h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return h ^ (h >> U64(32))


def span_hashes(raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the ordered spans raw[start:end]: by prefix sums, or xxhash from LONG bytes on.

    A polynomial modulo 2**64 gives equal hashes to certain long words of two letters (Thue-Morse words of 2**10
    letters and more), so only short spans are hashed by it.
    """
    n, out = len(starts), np.empty(len(starts), U64)
    long = np.flatnonzero(ends - starts >= LONG)
    out[long] = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    short = np.flatnonzero(ends - starts < LONG)
    starts, ends, i, n = starts[short], ends[short], 0, len(short)
    up, down = _powers(_CHUNK + 1)
    with np.errstate(over="ignore"):
        while i < n:
            s = int(starts[i])
            j = int(np.searchsorted(ends, s + _CHUNK, "right"))
            e = int(ends[j - 1])
            sums = np.zeros(e - s + 1, U64)
            np.cumsum(_TAB[data[s:e]] * up[: e - s], out=sums[1:])
            a, b = starts[i:j] - s, ends[i:j] - s
            out[short[i:j]] = mix((sums[b] - sums[a]) * down[a])
            i = j
    return out


def texts_words(texts: list[bytes | None], separator: np.ndarray = SEPARATOR) -> tuple:
    """One buffer with a newline after each text; where texts start; where words start and end; each text's first and end word."""
    parts = [t or b"" for t in texts]
    raw = b"\n".join([*parts, b""])
    data = np.frombuffer(raw, np.uint8)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)])
    sep = separator[data]
    before = np.concatenate([[True], sep[:-1]]) if len(sep) else sep
    starts, ends = np.flatnonzero(before & ~sep), np.flatnonzero(sep & ~before)
    bounds = np.searchsorted(starts, at)
    return raw, data, at, starts, ends, bounds[:-1], bounds[1:]


class Words:
    """The words of a batch: starts, ends (byte positions), hash; lo[d]:hi[d] are document d's words."""

    def __init__(self, texts: list[bytes | None]):
        self.raw, self.data, self.at, self.starts, self.ends, self.lo, self.hi = texts_words(texts)
        self.hash = span_hashes(self.raw, self.data, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return self.hi - self.lo

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lo)), self.counts)

    def last(self) -> np.ndarray:
        """For each word the end of its document, in words."""
        return np.repeat(self.hi, self.counts)

    def fits(self, n: int) -> np.ndarray:
        """Whether n words from here on lie in the same document."""
        return np.arange(len(self.hash)) + n <= self.last()


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of h[i:i+n] at every i; the last n-1 values are meaningless. Doubles the width instead of n passes."""
    with np.errstate(over="ignore"):
        block, width, done, out = mix(h, salt), 1, 0, None
        while True:
            if n & width:
                if out is None:
                    out = block
                else:
                    moved = np.zeros_like(block)
                    moved[: len(block) - done] = block[done:]
                    out = out * U64(pow(_MULT, width, 1 << 64)) + moved
                done |= width
            if done == n:
                return mix(out)
            moved = np.zeros_like(block)
            moved[: max(0, len(block) - width)] = block[width:]
            block = block * U64(pow(_MULT, width, 1 << 64)) + moved
            width *= 2


def sliding(x: np.ndarray, n: int, f, fill) -> np.ndarray:
    """f over x[i:i+n] at every i, with fill beyond the end."""
    out, width = x.copy(), 1
    while width < n:
        step = min(width, n - width)
        moved = np.full_like(out, fill)
        moved[: max(0, len(out) - step)] = out[step:]
        out = f(out, moved)
        width += step
    return out


def texts_of(column) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def count_words(docs, text: str) -> int:
    """The words of all texts."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def count(batches):
        for batch in batches:
            n = 0
            for t in batch.column(0).cast(pa.large_binary()).to_pylist():
                sep = SEPARATOR[np.frombuffer(t or b"", np.uint8)]
                n += int((~sep & np.concatenate([[True], sep[:-1]])).sum()) if len(sep) else 0
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return docs.select(F.col(text)).mapInArrow(count, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0


def small_batches(batches, column: int, step: int = 1 << 20):
    """The same rows in batches of about step bytes of text, so that work on a batch needs bounded memory."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.nan_to_num(np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + step, "right")))
            yield batch.slice(start, end - start)
            start = end
