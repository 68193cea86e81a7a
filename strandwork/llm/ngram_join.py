"""N-gram Jaccard join by chosen paths.

A document is the set of its distinct word n-grams. Equal sets form one class first. As chosen-path joins do, each set
is embedded by min-hashing into SKETCH coordinates, tokens (coordinate, value) that two sets share with probability
equal to their similarity. A run picks a few coordinates and splits the classes by their tokens there; a bucket that
is larger than `small` is split again on coordinates picked for its path, and so on. Small buckets are compared by
brute force, in blocks of pairs; so is a bucket that its parent hardly split, as its sets are alike. Pairs whose
sketches agree often enough become edges. A pair at the threshold t is missed by a run of c coordinates with
probability (1 - t)^c at most, so runs repeat until that product meets the target recall; later runs look only at
buckets that hold more than one component of the edges so far. Recall is also measured: a sample of sets is compared
with all sketches, and runs go on while more pairs that agree like the threshold lie in different components than the
target allows, until every coordinate has been used.

An exact check follows: in every component all pairs of sets are compared exactly, in blocks. Nothing is capped: a
group of any size is cut into more tasks, and only sums and spanning edges leave a task. Classes are numbered by
themselves and hot classes or buckets are joined by broadcast, so neither repeated ids nor copies meet in one task.

Defined cases: null and empty texts have no set and link with nothing, their class is their own id; texts of fewer
than n words have one n-gram, all their words; repeated rows are copies and link with each other; rows that share an
id but not a text are rows like others; rows with a null id link like others, a class without any id is null; extra
columns are left behind.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm._graph import ONE_TASK, bins, block_tasks, components, forest
from strandwork.llm._store import cut, cuts, drop_cut, drop_since, join_hot
from strandwork.llm._text import U64, Words, grams, mix, texts_of, trimmed

N = 5
THRESHOLD = 0.8
RECALL = 0.99999
SKETCH = 64
PICKS = 4
SMALL = 4096
SKETCH_BLOCK = 1024
SET_BLOCK = 256
GRAM_BLOCK = 1 << 20
AUDIT = 256
AUDITED = 0.999
DEPTH = 8
STEP_BYTES = 2 << 20
MOST_BROADCAST = 200_000
_MUL = np.random.default_rng(3).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * U64(2) + U64(1)


def shingles(texts: list[bytes | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text: offsets and sorted hashes."""
    w = Words(texts)
    g, at = grams(w.hash, n, 77), np.flatnonzero(w.fits(n))
    doc, key = w.doc_of_word()[at], g[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(few):
        own = np.array([grams(w.hash[w.lo[d] : w.hi[d]], int(w.counts[d]), 78)[0] for d in few], U64)
        doc, key = np.concatenate([doc, few]), np.concatenate([key, own])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    return np.searchsorted(doc, np.arange(len(texts) + 1)), key


def sketch(at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """SKETCH min-hashes (32 bits) of each nonempty set."""
    out = np.empty((len(at) - 1, SKETCH), "<u4")
    if len(key):
        with np.errstate(over="ignore"):
            for j in range(SKETCH):
                out[:, j] = np.minimum.reduceat(mix_fast(key, j), at[:-1])
    return out


def mix_fast(key: np.ndarray, j: int) -> np.ndarray:
    h = key * _MUL[j]
    return ((h ^ (h >> U64(29))) * _MUL[(j + 1) % SKETCH] >> U64(32)).astype(np.uint32)


SETS = "doc_id long, text_key long, k1 long, k2 long, size int, sketch binary"
_SET_NAMES = [x.split()[0] for x in SETS.split(", ")]


def _steps(batches, step: int = STEP_BYTES):
    """(ids, text keys, texts) lists of about step bytes from batches of (id, text key, text)."""
    ids, keys, texts, size = [], [], [], 0
    for batch in batches:
        for i, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
            ids.append(i)
            keys.append(k)
            texts.append(t)
            size += len(t or b"")
            if size >= step:
                yield ids, keys, texts
                ids, keys, texts, size = [], [], [], 0
    if ids:
        yield ids, keys, texts


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text key and text of every row."""
    t = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(t).alias("text_key"), t.alias("t"))


def _sets(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    def run(batches):
        for ids, keys, texts in _steps(batches):
            at, h = shingles(texts, n)
            size = np.diff(at)
            full = size > 0
            k1, k2 = np.zeros(len(ids), U64), np.zeros(len(ids), U64)
            vals: list = [None] * len(ids)
            if len(h):
                starts = at[:-1][full]
                with np.errstate(over="ignore"):
                    k1[full], k2[full] = np.add.reduceat(mix(h, 101), starts), np.add.reduceat(mix(h, 102), starts)
                s = sketch(np.append(starts, len(h)), h)
                for i, row in zip(np.flatnonzero(full), s):
                    vals[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size, pa.int32()), pa.array(vals, pa.binary())], names=_SET_NAMES)

    return _rows(docs, key, text).mapInArrow(trimmed(run), SETS)


def _classes(sets: DataFrame) -> DataFrame:
    """Classes of equal sets: c (a number of their own), their first row (by id, then text; nulls last) and n (rows)."""
    found = sets.where("size > 0").groupBy("k1", "k2", "size")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("row_id"), "text_key")).alias("first")
    found = found.agg(first, F.count(F.lit(1)).alias("n"), F.min("sketch").alias("sketch"))
    return cut(found.select(F.monotonically_increasing_id().alias("c"), "k1", "k2", "size", "first", "n", "sketch"), "classes")


def _placed(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """c, root and sketch of each class: root is its component so far, at first itself."""
    if roots is None:
        return classes.select("c", F.col("c").alias("root"), "sketch")
    return classes.select("c", "sketch").join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("c", F.coalesce("root", "c").alias("root"), "sketch")


def _paths(rows: DataFrame, run: int, depth: int, picks: int) -> DataFrame:
    """(key, parent, c, root): each class under the tokens at the coordinates picked for its path (at depth 0, for the run)."""

    def split(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.array(batch.column(0)).astype(np.int64).view(U64)
            c = np.array(batch.column(1))
            s = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").reshape(-1, SKETCH)
            keys = []
            for p in range(picks):
                if depth == 0:  # other coordinates in each run, as long as there are
                    at = np.full(len(c), (run * picks + p) % SKETCH)
                else:
                    at = (mix(path, 1000 + p) % U64(SKETCH)).astype(np.int64)
                token = s[np.arange(len(c)), at].astype(U64) | at.astype(U64) << U64(32)
                keys.append(mix(mix(token, 5) ^ path, 7 + depth))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(np.array(batch.column(0)), picks), pa.int64()), pa.array(np.tile(c, picks), pa.int64()), pa.array(np.tile(np.array(batch.column(2)), picks), pa.int64())], names=["key", "parent", "c", "root"])

    return rows.select("path", "c", "root", "sketch").mapInArrow(split, "key long, parent long, c long, root long")


def _agreeing(threshold: float) -> int:
    """Coordinates that must agree: five standard deviations below the threshold's mean, a chance of about 1e-6."""
    return math.floor(SKETCH * threshold - 5 * math.sqrt(SKETCH * threshold * (1 - threshold)))


def _compare_sketches(tasks: DataFrame, least: int) -> DataFrame:
    """Spanning edges of the pairs of each task whose sketches agree in at least `least` coordinates."""

    def compare(table):
        g = table.to_pandas()
        out_a, out_b = [], []
        for _, one in g.groupby(["key", "x", "y"], sort=False):
            x, y, own, c = int(one["x"].iloc[0]), int(one["y"].iloc[0]), one["own"].to_numpy(), one["c"].to_numpy()
            s = np.frombuffer(b"".join(one["sketch"]), "<u4").reshape(-1, SKETCH)
            p, q = np.flatnonzero(own == x), np.flatnonzero(own == y)
            if not len(p) or not len(q):
                continue
            same = np.zeros((len(p), len(q)), np.uint8)
            for j in range(SKETCH):
                same += s[p, j][:, None] == s[q, j][None, :]
            i, j = np.nonzero(same >= least)
            if len(i):
                node, root = forest(c[p][i], c[q][j])
                out_a.append(node[node != root])
                out_b.append(root[node != root])
        a, b = (np.concatenate(o) if o else np.empty(0, np.int64) for o in (out_a, out_b))
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tasks.select("task", "key", "x", "y", "own", "c", "sketch").groupBy("task").applyInArrow(trimmed(compare), "a long, b long")


def _run(placed: DataFrame, run: int, picks: int, small: int, least: int) -> list[DataFrame]:
    """Edges found by one run over classes (c, root, sketch) in buckets of more than one component.

    A class meets its component once, before it takes its paths: as many rows as classes are joined, not as paths.
    """
    out, level, depth = [], placed.select(F.lit(run).cast("long").alias("path"), "c", "root", "sketch"), 0
    while True:
        keys = _paths(level, run, depth, picks)
        sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("parent").alias("parent")).where("size > 1 and lo <> hi")
        if depth:
            sizes = sizes.join(parents, "parent")
        else:
            sizes = sizes.withColumn("above", F.lit(None).cast("long"))
        sizes = cut(sizes.select("key", "size", "above"), "buckets")
        total = sizes.agg(F.sum("size")).first()[0] or 0
        # A bucket that kept half of a parent holds sets that are alike: splitting goes no further.
        done = (F.col("size") <= small) | (F.col("size") * 2 > F.col("above")) if depth else F.col("size") <= small
        done = done if depth < DEPTH else F.lit(True)
        members = cut(join_hot(keys.select("key", "c"), sizes.where(done).select("key", "size"), ["key"], "size", total), "members")
        blocks = F.ceil(F.col("size") / F.lit(SKETCH_BLOCK))
        tasks = block_tasks(members, "key", "c", blocks, bins(members.count(), 4096)).join(placed.select("c", "sketch"), "c")
        out.append(_compare_sketches(tasks, least))
        large = sizes.where(~done) if depth < DEPTH else None
        if large is None or large.isEmpty():
            return out
        parents = large.select(F.col("key").alias("parent"), F.col("size").alias("above"))
        level = join_hot(keys.select("key", "c"), large.select("key", "size"), ["key"], "size", total).join(placed, "c").select(F.col("key").alias("path"), "c", "root", "sketch")
        level, depth = cut(level, "level"), depth + 1


def _audit(classes: DataFrame, roots: DataFrame, threshold: float, sample: int) -> float:
    """Measured recall: of the pairs of a sample with all sketches that agree like the threshold, the share in one component."""
    return _recall(_placed(classes, roots), threshold, sample)


def _recall(rows: DataFrame, threshold: float, sample: int) -> float:
    """_audit() over classes (c, root, sketch)."""
    asked = rows.orderBy(F.xxhash64(F.lit(31), "c"), "c").limit(sample).collect()  # at most `sample` sketches
    if not asked:
        return 1.0
    each = np.frombuffer(b"".join(bytes(r["sketch"]) for r in asked), "<u4").reshape(-1, SKETCH)
    ids, root = np.array([r["c"] for r in asked]), np.array([r["root"] for r in asked])
    least = math.ceil(SKETCH * threshold)

    def count(batches):
        n = hit = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                s = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u4").reshape(-1, SKETCH)
                same = np.zeros((len(each), len(s)), np.uint8)
                for j in range(SKETCH):
                    same += each[:, j][:, None] == s[:, j][None, :]
                pair = (same >= least) & (ids[:, None] != np.array(part.column(0))[None, :])
                n += int(pair.sum())
                hit += int((pair & (root[:, None] == np.array(part.column(1))[None, :])).sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "hit": pa.array([hit], pa.int64())})

    got = rows.mapInArrow(count, "n long, hit long").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).first()
    return got["hit"] / got["n"] if got["n"] else 1.0


def _exact(members: DataFrame, docs: DataFrame, key: str, text: str, n: int, threshold: float, block: int) -> DataFrame:
    """(c, links, root): rows linked in other classes and a spanning edge, from all pairs of each component's sets."""
    wanted = members.select("c", "row_id", "text_key")
    total = wanted.count()
    rows = _rows(docs, key, text).withColumn("row_id", F.coalesce("id", F.lit(0)))
    rows = rows.join(F.broadcast(wanted) if total <= MOST_BROADCAST else wanted, ["row_id", "text_key"])
    rows = rows.groupBy("c").agg(F.min("t").alias("t"))  # rows that repeat have one text

    def compare(table):
        g = table.to_pandas()
        out: list[list] = [[], [], []]
        for _, one in g.groupby(["root", "x", "y"], sort=False):
            x, y, own, c, m = int(one["x"].iloc[0]), int(one["y"].iloc[0]), one["own"].to_numpy(), one["c"].to_numpy(), one["n"].to_numpy()
            at, h = shingles([t.encode() for t in one["t"]], n)
            size = np.diff(at)
            p, q = np.flatnonzero(own == x), np.flatnonzero(own == y)
            if not len(p) or not len(q):
                continue
            both = _shared(at, h, p, q)
            hit = both >= threshold * (size[p][:, None] + size[q][None, :] - both) - 1e-9
            if x == y:
                np.fill_diagonal(hit, False)
                sums = [(c[p], hit @ m[q])]
            else:
                sums = [(c[p], hit @ m[q]), (c[q], hit.T @ m[p])]
            i, j = np.nonzero(hit)
            node, root = forest(c[p][i], c[q][j])
            low = dict(zip(node.tolist(), root.tolist()))
            for cs, ns in sums:
                out[0].append(cs)
                out[1].append(ns)
                out[2] += [low.get(v, v) for v in cs.tolist()]
        c, k = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out[:2])
        return pa.Table.from_arrays([pa.array(c, pa.int64()), pa.array(k, pa.int64()), pa.array(out[2], pa.int64())], names=["c", "links", "root"])

    # Blocks of at most `block` sets, and of about GRAM_BLOCK n-grams.
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(block), F.col("grams") / F.lit(GRAM_BLOCK)))
    tasks = block_tasks(members, "root", "c", blocks, bins(total, 512)).join(rows, "c")
    return tasks.select("task", "root", "x", "y", "own", "c", "n", "t").groupBy("task").applyInArrow(trimmed(compare), "c long, links long, root long")


def _shared(at: np.ndarray, h: np.ndarray, p: np.ndarray, q: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets p with sets q."""
    if len(p) == 1 or len(q) == 1:
        return np.array([[len(np.intersect1d(h[at[i] : at[i + 1]], h[at[j] : at[j + 1]], True)) if i != j else at[i + 1] - at[i] for j in q] for i in p], np.int64).reshape(len(p), len(q))
    every = np.sort(h)
    twice = every[1:][every[1:] == every[:-1]]
    vocabulary = twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice
    doc, col = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.searchsorted(vocabulary, h)
    known = col < len(vocabulary)
    known[known] = vocabulary[col[known]] == h[known]
    doc, col = doc[known], col[known]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    out = np.zeros((len(p), len(q)))
    place = np.full((2, len(at) - 1), -1)
    place[0, p], place[1, q] = np.arange(len(p)), np.arange(len(q))
    for lo in range(0, len(vocabulary), width):
        s, e = np.searchsorted(col, [lo, lo + width])
        a, b = np.zeros((len(p), width), np.float32), np.zeros((len(q), width), np.float32)
        for m, row in ((a, place[0, doc[s:e]]), (b, place[1, doc[s:e]])):
            some = row >= 0
            m[row[some], col[s:e][some] - lo] = 1
        out += a @ b.T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, picks: int = PICKS, small: int = SMALL, block: int = SET_BLOCK) -> DataFrame:
    """Per document: doc_id, class_id (the smallest id among the documents that links connect), n_links (documents linked directly).

    text_key (xxhash64 of the text) and kept tell the rows that stand for their class: one id and text, or its repeated rows.
    """
    sets = cut(_sets(docs, key, text, n), "sets")
    classes = _classes(sets)
    runs = max(1, math.ceil(math.log(1 - recall) / math.log((1 - threshold) ** picks)))
    edges, placed = None, _placed(classes, None)
    for run in range(max(runs, SKETCH // picks)):
        mark, before = cuts(), placed
        for found in _run(placed, run, picks, small, _agreeing(threshold)):
            edges = found if edges is None else edges.unionByName(found)
        roots = cut(components(edges, ONE_TASK), "roots")
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        placed = cut(_placed(classes, roots), "placed")
        drop_since(mark, roots, placed)
        drop_cut(before)
        if run + 1 >= runs and _recall(placed, threshold, AUDIT) >= AUDITED:
            break
    drop_cut(placed)
    sizes = roots.join(classes.select(F.col("c").alias("node"), "size"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("grams"))
    named = classes.select("c", "n", "first.row_id", "first.text_key")
    members = join_hot(roots.withColumnRenamed("node", "c"), sizes, ["root"], "members", roots.count()).join(named, "c")
    mark = cuts()
    exact = cut(_exact(cut(members, "members"), docs, key, text, n, threshold, block), "exact")
    links = exact.groupBy("c").agg(F.sum("links").alias("links"))
    linked = components(exact.select(F.col("c").alias("a"), F.col("root").alias("b")), ONE_TASK).select(F.col("node").alias("c"), F.col("root").alias("class"))
    links = links.join(linked, "c", "left")  # what has an edge has links
    each = cut(classes.select("k1", "k2", "size", "n", "c", "first").join(links, "c", "left").withColumn("class", F.coalesce("class", "c")), "each")
    firsts = each.groupBy("class").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("classes"))
    each = join_hot(each.drop("first"), firsts, ["class"], "classes", classes.count())
    each = cut(each.select("k1", "k2", "size", "n", "head", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    drop_since(mark, each)
    rows = sets.drop("sketch")
    out = join_hot(rows, each, ["k1", "k2", "size"], "n", rows.count(), "left")
    alone, class_id = F.col("size") == 0, F.when(~F.col("head.no_id"), F.col("head.row_id"))
    kept = alone | (F.col("doc_id").eqNullSafe(class_id) & (F.col("text_key") == F.col("head.text_key")))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(class_id).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", kept.alias("kept"))
