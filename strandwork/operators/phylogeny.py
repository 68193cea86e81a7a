"""Trees from distance tables: one tree per group, as node tables (node, parent, name, length)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

NODES = "node int, parent int, name string, length double"


def _matrix(g: pd.DataFrame) -> tuple[list, np.ndarray]:
    taxa = sorted(set(g["a"]) | set(g["b"]))
    at = {t: i for i, t in enumerate(taxa)}
    d = np.zeros((len(taxa), len(taxa)))
    for a, b, x in g[["a", "b", "d"]].itertuples(index=False):
        d[at[a], at[b]] = d[at[b], at[a]] = x
    return taxa, d


def upgma(taxa: list, d: np.ndarray) -> list[tuple]:
    """Average linkage; the first smallest pair joins, a new cluster comes last."""
    nodes = [[i, None, str(t), 0.0] for i, t in enumerate(taxa)]
    clusters = [(i, [i], 0.0) for i in range(len(taxa))]  # node, leaves, height
    while len(clusters) > 1:
        pairs = [(d[np.ix_(x[1], y[1])].mean(), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j]
        far, i, j = min(pairs)
        new, height = len(nodes), far / 2
        nodes.append([new, None, None, 0.0])
        for c in (clusters[i], clusters[j]):
            nodes[c[0]][1], nodes[c[0]][3] = new, float(height - c[2])
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [(new, clusters[i][1] + clusters[j][1], height)]
    return [tuple(n) for n in nodes]


def neighbour_joining(taxa: list, d: np.ndarray) -> list[tuple]:
    nodes = [[i, None, str(t), 0.0] for i, t in enumerate(taxa)]
    live, d = list(range(len(taxa))), d.astype(float).copy()
    while len(live) > 2:
        n, r = len(live), d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(int(q.argmin()), q.shape))
        to_i = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        new = len(nodes)
        nodes.append([new, None, None, 0.0])
        for k, length in ((i, to_i), (j, d[i, j] - to_i)):
            nodes[live[k]][1], nodes[live[k]][3] = new, float(length)
        rest = [k for k in range(n) if k not in (i, j)]
        row = (d[i, rest] + d[j, rest] - d[i, j]) / 2
        d = np.block([[d[np.ix_(rest, rest)], row[:, None]], [row[None, :], np.zeros((1, 1))]])
        live = [live[k] for k in rest] + [new]
    if len(live) == 2:
        root = len(nodes)
        nodes.append([root, None, None, 0.0])
        nodes[live[0]][1], nodes[live[0]][3] = root, float(d[0, 1])
        nodes[live[1]][1], nodes[live[1]][3] = root, 0.0
    return [tuple(n) for n in nodes]


def trees(distances: DataFrame, group: str, method=upgma) -> DataFrame:
    """A node table per group of (group, a, b, d) rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(method(*_matrix(g)), columns=["node", "parent", "name", "length"])
        out["parent"] = out["parent"].astype("Int32")
        out.insert(0, group, g[group].iloc[0])
        return out

    kind = dict(distances.dtypes)[group]
    return distances.groupBy(group).applyInPandas(run, f"{group} {kind}, {NODES}")


def to_newick(nodes: list[tuple]) -> str:
    children: dict = {}
    for node, parent, *_ in nodes:
        children.setdefault(None if parent is None or pd.isna(parent) else int(parent), []).append(node)
    by = {n[0]: n for n in nodes}

    def text(i: int) -> str:
        inner = f"({','.join(text(c) for c in children[i])})" if i in children else ""
        return f"{inner}{by[i][2] or ''}:{by[i][3]:.6f}"

    return text(children[None][0]) + ";"


def from_newick(text: str) -> list[tuple]:
    nodes: list[list] = []
    stack: list[int] = []
    last = None
    for token in re.findall(r"[(),;]|:[^(),;]+|[^(),:;]+", text.strip()):
        if token == "(":
            nodes.append([len(nodes), stack[-1] if stack else None, None, 0.0])
            stack.append(len(nodes) - 1)
            last = None
        elif token == ")":
            last = stack.pop()
        elif token == ",":
            last = None
        elif token.startswith(":"):
            nodes[last][3] = float(token[1:])
        elif token != ";" and token.strip():
            if last is None:
                nodes.append([len(nodes), stack[-1] if stack else None, token.strip(), 0.0])
                last = len(nodes) - 1
            else:
                nodes[last][2] = token.strip()
    return [tuple(n) for n in nodes]


def leaves_and_depths(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(node, name, depth, is_leaf) by a recursive query over the node table."""
    nodes.createOrReplaceTempView("strandwork_nodes")
    return spark.sql("""
        WITH RECURSIVE t(node, name, depth) AS (
            SELECT node, name, 0 FROM strandwork_nodes WHERE parent IS NULL
            UNION ALL SELECT n.node, n.name, t.depth + 1 FROM strandwork_nodes n JOIN t ON n.parent = t.node
        ) SELECT t.node, t.name, t.depth, p.parent IS NULL AS is_leaf FROM t LEFT JOIN (SELECT DISTINCT parent FROM strandwork_nodes) p ON p.parent = t.node
    """)
