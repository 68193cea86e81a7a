import numpy as np

from strandwork.llm import nn_descent


def test_links_between_dense_groups(spark):
    """Two groups of 30, near 1 inside and 0.985 across: every vector's 12 nearest stand in its own group."""
    r = np.random.default_rng(3)
    u, w = np.eye(16)[0], 0.985 * np.eye(16)[0] + np.sqrt(1 - 0.985**2) * np.eye(16)[1]
    x = np.repeat([u, w], 30, 0) + 1e-4 * r.standard_normal((60, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(100, np.eye(16)[5].tolist(), 0), (101, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (1024, 16):
        got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in nn_descent.near_duplicates(df, block=block).collect()}
        assert got == {**{i: (59, 0, i == 0) for i in range(60)}, 100: (0, 100, True), 101: (0, 101, True)}
