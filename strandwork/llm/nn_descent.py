"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label form one class first. Every class starts with the neighbours it meets in the leaves of
seeded random-hyperplane trees; rounds of NN-descent then refine the neighbour lists: each vector joins the vectors
that stand in its list or hold it in theirs, and those of them that are nearer to each other than their lists' last
entries enter. Rounds stop when few links are new. Recall is audited against brute force on a sample of vectors that
grows until it holds LINKS true links; while recall is below the target, further trees and rounds follow, and if it
stays there, all vectors are compared with all of their label in blocks. Edges at the threshold are kept.

A list of K entries that are all links is saturated: it may hide more, also links to another component. Saturated lists
are therefore enlarged to all of a vector's links: it is compared with all vectors of its label, in blocks of pairs,
before components are made. Links are then counted over all pairs of each component, which is exact.

Classes are numbered by themselves and named by label and two hashes of the vector; the rows of a hot class find it by
broadcast. Groups of tasks grow in number with the data.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and vectors with a null label link
with nothing (n_links 0, component_id their own id, kept); vectors of different lengths never link; equal vectors
link with each other; rows that share a vec_id but not a vector are rows like others; rows with a null vec_id link and
count like others, but name no component; extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.llm._graph import bins, block_tasks, components, forest
from strandwork.llm._store import cut, cuts, drop_cut, drop_since, join_hot

K = 12
TREES = 4
LEAF = 96
ROUNDS = 8
CHANGED = 0.002
ATTEMPTS = 4
AUDIT = 256
MOST_AUDIT = 4096
LINKS = 64
RECALL = 0.95
BLOCK = 1024
EACH = 8192


def _matrix(column) -> np.ndarray:
    """Unit vectors in double precision from float64 bytes of equal length."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _doubles(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: x.cast("double"))


def _names(label: str, vector: Column) -> list[Column]:
    """What names a class: its label and two hashes of its vector."""
    return [F.col(label).cast("string").alias("label"), F.xxhash64(vector).alias("h1"), F.xxhash64(F.lit(41), vector).alias("h2")]


def _classes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Per class of equal vectors of a label: c (a number of its own), id (its smallest), label, h1, h2, dim, n (rows), vec (float64 bytes)."""
    v = _doubles(vector)
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    fine = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).where((norm > 0) & (norm < F.lit(float("inf"))))
    rows = rows.select(F.col(key).cast("long").alias("id"), *_names(label, v), v.alias("v"))
    grouped = rows.groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).select("label", "id", "n", "v", "h1", "h2")

    def pack(batches):
        for batch in batches:
            vec = [np.array(x, "<f8").tobytes() for x in batch.column(3).to_pylist()]
            columns = [batch.column(i) for i in (0, 1, 2, 4, 5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) // 8 for x in vec], pa.int32()), pa.array(vec, pa.binary())], names=["label", "id", "n", "h1", "h2", "dim", "vec"])

    return cut(grouped.mapInArrow(pack, "label string, id long, n long, h1 long, h2 long, dim int, vec binary").withColumn("c", F.monotonically_increasing_id()), "classes")


def _top(c: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row of a square similarity matrix, without itself."""
    n = len(c)
    k = min(k, n - 1)
    np.fill_diagonal(sims, -2.0)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-sims, axis=1)[:, :k]
    return np.repeat(c, k), c[at].ravel(), np.take_along_axis(sims, at, 1).ravel()


EDGES = "a long, b long, sim double"


def _edges(parts: list) -> pa.Table:
    a, b, s = (np.concatenate(x) if x else np.empty(0) for x in (list(zip(*parts)) or [(), (), ()]))
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "sim"])


def _trees(classes: DataFrame, total: int, first: int, trees: int, k: int, leaf: int) -> DataFrame:
    """Neighbours in the leaves of random-hyperplane trees; leaves that stay large are dealt to chunks by hash."""

    def code(batches):
        for batch in batches:
            label, c, dim, vec = (batch.column(x).to_pylist() for x in ("label", "c", "dim", "vec"))
            rows = []
            for d in set(dim):
                at = [i for i, x in enumerate(dim) if x == d]
                x = _matrix(pa.array([vec[i] for i in at], pa.binary()))
                for t in range(first, first + trees):
                    planes = np.random.default_rng([t, d]).standard_normal((d, 32))
                    bits = x @ planes > 0
                    value = (bits * (1 << np.arange(32, dtype=np.int64))).sum(1)
                    rows += [(label[i], d, t, int(v), c[i], vec[i]) for i, v in zip(at, value)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds], names=["label", "dim", "t", "code", "c", "vec"])

    coded = classes.mapInArrow(code, "label string, dim int, t int, code long, c long, vec binary")
    # Bits enough for leaves of the wanted size if codes were even; a leaf that is too large is cut by hash.
    per = classes.groupBy("label", "dim").count().withColumnRenamed("count", "members")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("members") / leaf))).cast("int")
    coded = coded.join(per, ["label", "dim"]).withColumn("code", F.pmod("code", F.pow(F.lit(2), F.least(bits, F.lit(30))).cast("long")))
    keys = ["label", "dim", "t", "code"]
    sizes = coded.groupBy(*keys).count()
    chunk = F.pmod(F.xxhash64("c", "t"), F.ceil(F.col("count") / (2 * leaf)).cast("int"))
    dealt = coded.join(sizes, keys).withColumn("chunk", chunk).withColumn("task", F.pmod(F.xxhash64(*keys, "chunk"), F.lit(bins(total * trees, EACH))))

    def meet(table):
        g = table.to_pandas()
        parts = []
        for _, one in g.groupby([*keys, "chunk"], sort=False):
            if len(one) > 1:
                x = _matrix(pa.array(one["vec"], pa.binary()))
                parts.append(_top(one["c"].to_numpy(np.int64), x @ x.T, k))
        return _edges(parts)

    return dealt.select(*keys, "chunk", "task", "c", "vec").groupBy("task").applyInArrow(meet, EDGES)


def _best(edges: DataFrame, k: int) -> DataFrame:
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))).where(F.col("r") <= k).drop("r")


def _local_join(lists: DataFrame, classes: DataFrame, total: int, k: int) -> DataFrame:
    """Pairs of vectors in a common neighbourhood that are nearer than the last entry of one of their lists."""
    last = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("have")).select(F.col("a").alias("m"), F.when(F.col("have") >= k, F.col("low")).otherwise(F.lit(-2.0)).alias("low"))
    rank = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k)
    near = lists.select("a", F.col("b").alias("m")).unionByName(back.select("a", F.col("b").alias("m"))).unionByName(lists.select("a", F.col("a").alias("m"))).distinct()
    vectors = classes.select(F.col("c").alias("m"), "vec").join(last, "m", "left").withColumn("low", F.coalesce("low", F.lit(-2.0)))
    rows = near.join(vectors, "m").withColumn("task", F.pmod(F.xxhash64("a"), F.lit(bins(total * (2 * k + 1), 4 * EACH))))

    def meet(table):
        a = np.array(table.column("a"))
        order = np.argsort(a, kind="stable")
        a, m, low = a[order], np.array(table.column("m"))[order], np.array(table.column("low"))[order]
        x = _matrix(table.column("vec"))[order]
        starts = np.flatnonzero(np.diff(a, prepend=a[0] - 1))
        parts = []
        for s, e in zip(starts, np.append(starts[1:], len(a))):
            sims = x[s:e] @ x[s:e].T
            i, j = np.nonzero(np.triu(sims > np.minimum(low[s:e, None], low[None, s:e]), 1))
            if len(i):
                v = sims[i, j]
                parts += [(m[s + i], m[s + j], v), (m[s + j], m[s + i], v)]
        if parts:
            u, w, v = (np.concatenate(p) for p in zip(*parts))
            _, once = np.unique(np.stack([u, w]), axis=1, return_index=True)
            parts = [(u[once], w[once], v[once])]
        return _edges(parts)

    return rows.select("task", "a", "m", "low", "vec").groupBy("task").applyInArrow(meet, EDGES)


def _saturated(lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """(c) of the vectors whose lists are full of links."""
    return lists.where(F.col("sim") >= threshold).groupBy(F.col("a").alias("c")).count().where(F.col("count") >= k).select("c")


def _all_links(asked: DataFrame, classes: DataFrame, total: int, threshold: float, block: int) -> DataFrame:
    """(a, b) spanning edges of all links of the asked vectors, each compared with every vector of its label, in blocks."""
    keys = ["label", "dim"]
    per = classes.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).join(asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked")), keys)
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    per = per.select(*keys, blocks("asked").alias("nx"), blocks("members").alias("ny"))
    own = lambda n: F.pmod(F.xxhash64("c", F.lit(11)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = asked.join(per, keys).select(*keys, "c", "vec", "nx", "ny", F.lit(True).alias("ask"), own("nx").alias("x"), every("ny").alias("y"))
    rows = rows.unionByName(classes.join(per, keys).select(*keys, "c", "vec", "nx", "ny", F.lit(False).alias("ask"), every("nx").alias("x"), own("ny").alias("y")))
    task = F.when((F.col("nx") == 1) & (F.col("ny") == 1), F.pmod(F.xxhash64(*keys), F.lit(bins(total, EACH)))).otherwise(F.xxhash64(*keys, "x", "y"))

    def compare(table):
        g = table.to_pandas()
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, one in g.groupby([*keys, "x", "y"], sort=False):
            ask, c = one["ask"].to_numpy(bool), one["c"].to_numpy(np.int64)
            v = _matrix(pa.array(one["vec"], pa.binary()))
            p, q = np.flatnonzero(ask), np.flatnonzero(~ask)
            i, j = np.nonzero((v[p] @ v[q].T >= threshold) & (c[p][:, None] != c[q][None, :]))
            if len(i):
                node, root = forest(c[p][i], c[q][j])
                out_a.append(node[node != root])
                out_b.append(root[node != root])
        return pa.Table.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return rows.select(task.alias("task"), *keys, "x", "y", "ask", "c", "vec").groupBy("task").applyInArrow(compare, "a long, b long")


def _audit(lists: DataFrame, classes: DataFrame, k: int, threshold: float, sample: int) -> tuple[int, int]:
    """Links of a sample, by brute force, and how many of them the lists of one of their ends hold or, being saturated, leave to the search of all vectors.

    The sample is of vectors whose lists are not saturated: the others are compared with all vectors anyhow.
    """
    full = _saturated(lists, threshold, k)
    asked = classes.join(full, "c", "left_anti").orderBy(F.xxhash64(F.lit(23), "c"), "c").limit(sample)
    rows = [(r["c"], r["label"], r["dim"], r["vec"]) for r in asked.collect()]  # at most `sample` vectors
    if not rows:
        return 0, 0
    shared = classes.sparkSession.sparkContext.broadcast(rows)

    def find(batches):
        groups: dict = {}
        for c, label, dim, vec in shared.value:
            groups.setdefault((label, dim), []).append((c, vec))
        groups = {g: (np.array([c for c, _ in v]), _matrix(pa.array([x for _, x in v], pa.binary()))) for g, v in groups.items()}
        for batch in batches:
            label, dim, c, vec = (batch.column(x).to_pylist() for x in ("label", "dim", "c", "vec"))
            parts = []
            for g in set(zip(label, dim)) & set(groups):
                at = [i for i, x in enumerate(zip(label, dim)) if x == g]
                x, ids = _matrix(pa.array([vec[i] for i in at], pa.binary())), np.array([c[i] for i in at])
                sims = groups[g][1] @ x.T
                i, j = np.nonzero(sims >= threshold)
                other = groups[g][0][i] != ids[j]
                parts.append((groups[g][0][i][other], ids[j][other], sims[i, j][other]))
            t = _edges(parts)
            yield from t.to_batches() or [pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.columns], names=t.column_names)]

    truth = classes.mapInArrow(find, EDGES)
    held = lists.where(F.col("sim") >= threshold)
    held = held.select("a", "b").unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("hit", F.lit(1))
    found = truth.join(held, ["a", "b"], "left").join(full.select(F.col("c").alias("b"), F.lit(1).alias("full")), "b", "left")
    got = found.agg(F.count(F.lit(1)).alias("n"), F.count(F.coalesce("hit", "full")).alias("hit")).first()
    return got["n"], got["hit"]


def _recall(lists: DataFrame, classes: DataFrame, total: int, k: int, threshold: float, sample: int) -> float:
    """Audited recall, of a sample that is enlarged until it tests LINKS links, holds MOST_AUDIT vectors or all."""
    while True:
        n, hit = _audit(lists, classes, k, threshold, sample)
        if n >= LINKS or sample >= min(total, MOST_AUDIT):
            return hit / n if n else 1.0
        sample *= 4


def neighbour_lists(classes: DataFrame, threshold: float, k: int = K, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, changed: float = CHANGED, audit: int = AUDIT, recall: float = RECALL) -> tuple[DataFrame, float]:
    """(a, b, sim) lists of at most k neighbours, and their audited recall of links."""
    lists, first, reached, total = None, 0, 0.0, classes.count()
    for _ in range(ATTEMPTS):
        grown, old = _trees(classes, total, first, trees, k, leaf), lists
        lists = cut(_best(grown if lists is None else grown.unionByName(lists), k), "lists")
        if old is not None:
            drop_cut(old)
        first += trees
        for _ in range(rounds):
            new = cut(_best(_local_join(lists, classes, total, k).unionByName(lists), k), "lists")
            # Links are what counts, and saturated lists are searched whole later: rounds stop when the other lists gain few links.
            open_ = new.where(F.col("sim") >= threshold).join(_saturated(new, threshold, k).withColumnRenamed("c", "a"), "a", "left_anti")
            got = open_.join(lists.select("a", "b", F.lit(1).alias("held")), ["a", "b"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("held").alias("held")).first()
            drop_cut(lists)
            lists = new
            if got["n"] - got["held"] <= changed * got["n"]:
                break
        reached = _recall(lists, classes, total, k, threshold, audit)
        if reached >= recall:
            break
    return lists, reached


def _count_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(c, links): rows of other classes at the threshold, over all pairs of each component."""

    def compare(table):
        g = table.to_pandas()
        out_c, out_n = [], []
        for _, one in g.groupby(["root", "x", "y", "dim"], sort=False):
            x, y = int(one["x"].iloc[0]), int(one["y"].iloc[0])
            own = one["own"].to_numpy()
            v, c, n = _matrix(pa.array(one["vec"], pa.binary())), one["c"].to_numpy(), one["n"].to_numpy()
            p, q = np.flatnonzero(own == x), np.flatnonzero(own == y)
            hit = v[p] @ v[q].T >= threshold
            if x == y:
                np.fill_diagonal(hit, False)
                out_c.append(c[p])
                out_n.append(hit @ n[q])
            else:
                out_c += [c[p], c[q]]
                out_n += [hit @ n[q], hit.T @ n[p]]
        c, n = np.concatenate(out_c), np.concatenate(out_n)
        return pa.Table.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["c", "links"])

    tasks = block_tasks(members, "root", "c", F.ceil(F.col("size") / F.lit(block)), bins(members.count(), EACH))
    return tasks.select("task", "root", "x", "y", "own", "dim", "c", "n", "vec").groupBy("task").applyInArrow(compare, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, k: int = K, block: int = BLOCK, recall: float = RECALL, **search) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept."""
    classes = _classes(vectors, key, vector, label)
    total = classes.count()
    lists, reached = neighbour_lists(classes, threshold, k, recall=recall, **search)
    linked = lists.where(F.col("sim") >= threshold).select("a", "b")
    asked = classes.join(_saturated(lists, threshold, k), "c", "left_semi") if reached >= recall else classes
    mark = cuts()
    roots = cut(components(linked.unionByName(_all_links(asked, classes, total, threshold, block))), "roots")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = join_hot(roots, sizes, ["root"], "size", roots.count()).join(classes, F.col("node") == F.col("c"))
    members = cut(members.select("root", "size", "c", "n", "dim", "vec"), "members")
    links = _count_links(members, threshold, block).join(roots.select(F.col("node").alias("c"), "root"), "c")
    each = classes.drop("vec", "dim").join(links, "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = each.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("classes"))
    each = join_hot(each, named, ["root"], "classes", total)
    each = cut(each.select("label", "h1", "h2", "n", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    drop_since(mark, each)
    # Rows find their class by label and vector, as classes were made.
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), *_names(label, _doubles(vector)))
    out = join_hot(rows, each, ["label", "h1", "h2"], "n", rows.count(), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
