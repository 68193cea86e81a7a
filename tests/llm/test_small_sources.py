import collections

import pytest

from strandwork.llm import mixing
from strandwork.llm._store import cut


def test_sources_below_a_block_meet_their_targets(spark):
    """A block of 20,000 words, as in a corpus of 5e9 words, against sources of 3,000 to 20,500."""
    sizes = {"large": 400_000, "b": 3000, "c": 7000, "d": 20_500, "e": 1}
    rows = []
    for source, n in sizes.items():
        while n > 0:
            rows.append((len(rows), source, min(n, 1000 + 37 * (len(rows) % 7))))
            n -= rows[-1][2]
    df = cut(spark.createDataFrame(rows, "doc_id long, source string, size long"), "test")
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(df, blocks=22).collect():
        assert 0 <= r.taken <= 3 * r.size
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert set(by) == set(sizes)
    assert {s: by[s][1] for s in "bcde"} == {s: pytest.approx(3 * sizes[s]) for s in "bcde"}
    assert all(abs(taken - target) <= 0.5 for taken, target in by.values())
