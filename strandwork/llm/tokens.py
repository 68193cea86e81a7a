"""Token ids of whole texts, by a memo of the units that texts repeat.

A byte-level BPE with the usual split pattern never joins a word with the white space after it, so a text's ids are
those of its units, each a word with the white space before it, one after another. A batch is split into units and
hashed as a whole; only units that the worker has not met are encoded. Texts where that may not hold (white space
beyond ASCII, separators 0x1C-0x1F, code points over U+FFFF, the tokenizer's special tokens) go to `tokenizers` whole,
and so does everything if a tokenizer file has no matching rank file.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

from strandwork.llm._packed import Distinct
from strandwork.llm._text import SEPARATOR, span_hashes, texts_words

MEMO_UNITS = 300_000
_ODD = rb"[\x1c-\x1f\xf0-\xf7]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"


class Encoder:
    def __init__(self, name: str = "byte_bpe_50k.json"):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.load = lambda: Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
        self.whole = self.load()
        special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([_ODD, *map(re.escape, special)]))
        self.fast = self._ranked(name, public_tokenizers)
        if self.fast is not None:
            self.whole = None  # loaded again where a text needs it
        self._forget()

    def _ranked(self, name: str, public):
        """The same vocabulary as ranks, if there is one that gives the same ids for a probe text."""
        import tiktoken

        if "/" in name or not os.path.exists(path := public.path(name.replace(".json", ".tiktoken"))):
            return None
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = " It's  1024 tokens,\n\n\tn'est-ce pas? Übergrößenträger ... 3.14 ¡año! \r\n Привет 世界 " * 3
        if fast.encode_ordinary(probe) != self.whole.encode(probe, add_special_tokens=False).ids:
            return None
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(x) for x in ranks]
        return fast

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, hashes: list[int], units: list[bytes]) -> None:
        space = b" \t\n\v\f\r"
        lead = [u[0] in space and u[-1] not in space for u in units]
        run = [u for u, x in zip(units, lead) if x]
        ids = np.array(self.fast.encode_ordinary(b"".join(run).decode()), np.int32)  # each starts with white space and ends without: none joins the one before
        ends = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, run), np.int64, len(run))), "left") + 1
        rest = [np.array(self.fast.encode_ordinary(u.decode()), np.int32) for u, x in zip(units, lead) if not x]
        size = np.concatenate([np.diff(cut, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])
        order = [k for k, x in zip(hashes, lead) if x] + [k for k, x in zip(hashes, lead) if not x]
        self.known.update(zip(order, range(len(self.at), len(self.at) + len(order))))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids, *rest])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as int32 arrays."""
        if self.fast is None:
            return [np.array(e.ids, np.int32) for e in self.whole.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        out: list = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if self.odd.search(t)] if self.odd.search(b"\n".join(texts)) else []
        if odd and self.whole is None:
            self.whole = self.load()
        for i in odd:
            out[i] = np.array(self.whole.encode(texts[i].decode(), add_special_tokens=False).ids, np.int32)
        skip = set(odd)
        plain = [i for i in range(len(texts)) if i not in skip]
        for i, ids in zip(plain, self._encode([texts[i] for i in plain])):
            out[i] = ids
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        raw, data, at, _, word_ends, lo, hi = texts_words(texts)
        # A unit ends where a word does; white space at a text's end is a unit too.
        last = at[1:] - 1
        tail = last[(np.diff(at) > 1) & SEPARATOR[data[last - 1]]]
        ends = np.sort(np.concatenate([word_ends, tail]), kind="stable")
        first = np.searchsorted(ends, at[:-1], "right")
        starts = np.concatenate([[0], ends[:-1]])
        count = np.diff(np.append(first, len(ends)))
        starts[first[count > 0]] = at[:-1][count > 0]
        if not len(ends):
            return [np.zeros(0, np.int32) for _ in texts]
        h = span_hashes(raw, data, starts, ends)
        d = Distinct(h)
        keys, of, where = d.k, d.of, np.empty(len(d.k), np.int64)
        where[of] = np.arange(len(of))
        if len(self.known) + len(keys) > max(MEMO_UNITS, 2 * len(keys)):
            self._forget()
        listed = keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in self.known]
        if new:
            self._learn([listed[i] for i in new], [raw[starts[j] : ends[j]] for j in where[new]])
        place = np.fromiter(map(self.known.__getitem__, listed), np.int64, len(listed))[of]
        size = self.size[place]
        sums = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(sums[-1]) + np.repeat(self.at[place] - sums[:-1], size)]
        bounds = sums[np.append(first, len(ends))]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(2)
def encoder(name: str) -> Encoder:
    return Encoder(name)
