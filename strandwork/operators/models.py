"""Classifier inference. Models are small parameter tables that become column expressions; scoring needs no Python."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Gaussian naive Bayes models as prior, means and variances per class, over the named features.
BUILT_IN = {
    "coding": (["gc_content", "at_skew", "linguistic_complexity", "codon_bias", "hexamer_score", "repeat_fraction", "orf_density"], {
        "coding": (0.55, [0.62, 0.52, 1.82, 0.72, 0.31, 0.42, 0.88], [0.04, 0.03, 0.18, 0.06, 0.04, 0.05, 0.08]),
        "non-coding": (0.45, [0.48, 0.38, 1.12, 0.51, 0.52, 0.61, 0.41], [0.05, 0.04, 0.22, 0.07, 0.05, 0.06, 0.09]),
    }),
    "promoter": (["gc_content", "cpg_density", "tata_box_score", "gc_box_score", "caat_box_score"], {
        "promoter": (0.15, [0.58, 0.72, 0.18, 0.65, 0.44], [0.04, 0.05, 0.02, 0.06, 0.04]),
        "non-promoter": (0.85, [0.49, 0.41, 0.08, 0.38, 0.22], [0.03, 0.04, 0.01, 0.05, 0.03]),
    }),
    "splice": (["gc_local", "gt_ag_score", "py_tract_score", "branch_point_score", "conservation_score"], {
        "donor": (0.12, [0.82, 0.91, 0.28, 0.73, 0.65], [0.03, 0.02, 0.04, 0.05, 0.04]),
        "acceptor": (0.12, [0.71, 0.38, 0.84, 0.29, 0.71], [0.04, 0.03, 0.03, 0.04, 0.03]),
        "non-splice": (0.76, [0.49, 0.44, 0.45, 0.42, 0.38], [0.06, 0.05, 0.06, 0.06, 0.05]),
    }),
    "enzyme": (["gravy", "hydrophobic_ratio", "aliphatic_index", "pi", "aromatic_fraction", "charge_ph7", "molecular_weight", "instability_idx_norm"], {
        "enzyme": (0.42, [-0.12, 0.38, 94.2, 5.8, 0.44, 7.12, 1480.0, 0.22], [0.18, 0.06, 82.0, 0.9, 0.05, 1.2, 280000.0, 0.04]),
        "non-enzyme": (0.58, [0.08, 0.29, 78.1, 6.4, 0.51, 6.82, 1820.0, 0.31], [0.22, 0.07, 91.0, 1.1, 0.06, 1.4, 310000.0, 0.05]),
    }),
    "membrane": (["gravy", "hydrophobic_ratio", "charged_fraction", "aliphatic_index", "aromatic_fraction", "pi"], {
        "membrane": (0.27, [1.12, 0.62, 0.14, 102.1, 0.08, 3.9], [0.22, 0.05, 0.03, 68.0, 0.02, 1.8]),
        "soluble": (0.73, [-0.32, 0.38, 0.38, 79.4, 0.31, 7.1], [0.28, 0.06, 0.05, 72.0, 0.04, 2.1]),
    }),
    "activity": (["molecular_weight", "logP", "hbd", "hba", "tpsa", "rot_bonds", "rings", "fsp3"], {
        "active": (0.35, [320.0, 2.8, 2.0, 5.5, 62.0, 4.0, 1.8, 0.52], [8100.0, 1.8, 1.2, 4.1, 680.0, 2.4, 0.9, 0.04]),
        "inactive": (0.65, [420.0, 3.9, 3.1, 7.2, 88.0, 5.8, 2.9, 0.38], [9200.0, 2.1, 1.4, 5.2, 820.0, 3.1, 1.2, 0.05]),
    }),
    "toxicity": (["molecular_weight", "logP", "hbd", "hba", "tpsa", "rot_bonds", "aromatic_rings"], {
        "class_I_low": (0.48, [180.0, 0.8, 1.1, 3.2, 42.0, 2.1, 0.8], [3200.0, 0.6, 0.8, 2.1, 320.0, 1.4, 0.4]),
        "class_II_moderate": (0.32, [310.0, 2.4, 2.3, 5.1, 72.0, 4.2, 1.6], [6800.0, 1.2, 1.1, 3.4, 580.0, 2.2, 0.8]),
        "class_III_high": (0.20, [450.0, 4.1, 3.8, 7.8, 98.0, 6.1, 2.4], [9400.0, 2.2, 1.8, 4.8, 920.0, 3.6, 1.4]),
    }),
    "herg": (["logP", "molecular_weight", "hbd", "hba", "aromatic_rings", "tpsa"], {
        "inhibitor": (0.23, [3.8, 350.0, 1.2, 3.8, 2.1, 42.0], [1.4, 7200.0, 0.9, 2.8, 1.6, 420.0]),
        "non-inhibitor": (0.77, [1.4, 280.0, 1.9, 5.8, 0.8, 78.0], [1.8, 6100.0, 1.2, 3.4, 0.8, 580.0]),
    }),
}


def answer(scores: dict[str, Column]) -> Column:
    """Struct of label, confidence and probabilities from log scores; the first label wins ties."""
    labels = list(scores)
    top = F.greatest(*scores.values()) if len(labels) > 1 else scores[labels[0]]
    weight = {k: F.exp(v - top) for k, v in scores.items()}
    total = sum(weight.values(), F.lit(0.0))
    best = F.lit(labels[-1])
    for k in reversed(labels[:-1]):
        best = F.when(scores[k] == top, k).otherwise(best)
    return F.struct(best.alias("label"), (1.0 / total).alias("confidence"), F.create_map(*(x for k in labels for x in (F.lit(k), weight[k] / total))).alias("probabilities"))


def bayes_scores(features: list[Column], classes: dict) -> dict[str, Column]:
    """The log score of each class; classes: label -> (prior, means, variances)."""
    scores = {}
    for label, (prior, means, variances) in classes.items():
        score = F.lit(math.log(prior + 1e-10))
        for x, m, v in zip(features, means, variances):
            v = max(v, 1e-9)
            score = score - 0.5 * math.log(2 * math.pi * v) - (x - m) * (x - m) / (2 * v)
        scores[label] = score
    return scores


def naive_bayes(features: list[Column], classes: dict) -> Column:
    """classes: label -> (prior, means, variances)."""
    return answer(bayes_scores(features, classes))


def linear(features: list[Column], classes: dict) -> Column:
    """classes: label -> (bias, weights); softmax."""
    return answer({k: sum((x * w for x, w in zip(features, weights)), F.lit(float(bias))) for k, (bias, weights) in classes.items()})


def decision_tree(features: dict[str, Column], node: dict) -> Column:
    """node: {"feature", "threshold", "left", "right"} or {"probabilities"}: a nested condition giving a map."""
    if "probabilities" in node:
        return F.create_map(*(x for k, v in sorted(node["probabilities"].items()) for x in (F.lit(k), F.lit(float(v)))))
    return F.when(features[node["feature"]] <= node["threshold"], decision_tree(features, node["left"])).otherwise(decision_tree(features, node["right"]))


def random_forest(features: dict[str, Column], trees: list[dict], labels: list[str]) -> Column:
    """Mean probabilities over the trees."""
    each = [decision_tree(features, t) for t in trees]
    mean = {k: sum((F.coalesce(F.try_element_at(e, F.lit(k)), F.lit(0.0)) for e in each), F.lit(0.0)) / len(each) for k in labels}
    top = F.greatest(*mean.values())
    best = F.lit(labels[-1])
    for k in reversed(labels[:-1]):
        best = F.when(mean[k] == top, k).otherwise(best)
    return F.struct(best.alias("label"), top.alias("confidence"), F.create_map(*(x for k in labels for x in (F.lit(k), mean[k]))).alias("probabilities"))


def k_nearest(queries: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """(id, label, confidence): points (label, v) are a model, so their number is checked before they are broadcast.

    Each row finds its neighbours in an array expression; neither side is shuffled.
    """
    if points.limit(100_001).count() > 100_000:
        raise ValueError("a model of more than 100000 points")
    model = F.broadcast(points.agg(F.sort_array(F.collect_list(F.struct("pid", "label", "v"))).alias("model")))
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = F.slice(F.array_sort(F.transform("model", lambda p: F.struct(far(F.col("v"), p["v"]).alias("d"), p["pid"].alias("pid"), p["label"].alias("label")))), 1, k)
    rows = queries.join(model).select("id", F.explode(near).alias("n")).select("id", F.col("n.label").alias("label"), (1.0 / (F.col("n.d") + 1e-6)).alias("w"))
    votes = rows.groupBy("id", "label").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("id")
    votes = votes.withColumn("confidence", F.col("w") / F.sum("w").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.col("w").desc(), "label")))
    return votes.where("r = 1").select("id", "label", "confidence")


def nearest(features: list[Column], points: list[tuple[list[float], str]], k: int = 5) -> Column:
    """Struct of label and confidence from the k nearest of a model's points, weighted by 1 / (distance + 1e-6)."""
    v = F.array(*(x.cast("double") for x in features))
    model = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.array(*map(F.lit, p)).alias("v")) for i, (p, label) in enumerate(points)))
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = F.slice(F.array_sort(F.transform(model, lambda p: F.struct(far(v, p["v"]).alias("d"), p["i"].alias("i"), p["label"].alias("label")))), 1, k)
    labels = sorted({label for _, label in points})
    weight = {x: F.aggregate(F.filter(near, lambda p: p["label"] == x), F.lit(0.0), lambda s, p: s + 1.0 / (p["d"] + 1e-6)) for x in labels}  # noqa: B023
    total, top = sum(weight.values(), F.lit(0.0)), F.greatest(*weight.values()) if len(labels) > 1 else weight[labels[0]]
    best = F.lit(labels[-1])
    for x in reversed(labels[:-1]):
        best = F.when(weight[x] == top, x).otherwise(best)
    return F.struct(best.alias("label"), (top / total).alias("confidence"))


def vote(predictions: DataFrame, key: str = "id") -> DataFrame:
    """Majority label of (id, label, confidence) rows and its mean confidence; the first label on ties."""
    n = predictions.groupBy(key, "label").agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("confidence"))
    w = Window.partitionBy(key).orderBy(F.col("votes").desc(), "label")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def weighted_vote(predictions: DataFrame, key: str = "id") -> DataFrame:
    """The label of the largest weighted mean probability of (id, probabilities, weight) rows; the first label on ties."""
    total = predictions.groupBy(key).agg(F.sum("weight").alias("total"))
    each = predictions.select(key, "weight", F.explode("probabilities").alias("label", "p")).groupBy(key, "label").agg(F.sum(F.col("p") * F.col("weight")).alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("confidence").desc(), "label")
    each = each.join(total, key).withColumn("confidence", F.col("score") / F.col("total"))
    return each.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "label", "confidence")


def save(algorithm: str, features: list[str], **parameters) -> str:
    """A model's JSON, as load() reads it; naive Bayes classes may be given as label -> (prior, means, variances)."""
    if algorithm in ("naive_bayes", "nb"):
        parameters["classes"] = {k: dict(zip(("prior", "means", "variances"), c)) if isinstance(c, tuple) else c for k, c in parameters["classes"].items()}
    return json.dumps({"algorithm": algorithm, "features": features, **parameters})


def load(text: str):
    """A scoring function of a feature-name -> Column mapping, from a model's JSON."""
    m = json.loads(text)
    kind, names = m["algorithm"], m.get("features", [])
    if kind in ("naive_bayes", "nb"):
        return lambda f: naive_bayes([f[n] for n in names], {k: (c["prior"], c["means"], c["variances"]) for k, c in m["classes"].items()})
    if kind in ("linear", "lr"):
        return lambda f: linear([f[n] for n in names], {k: (c["bias"], c["weights"]) for k, c in m["classes"].items()})
    if kind in ("decision_tree", "dt"):
        return lambda f: decision_tree(f, m["tree"])
    if kind in ("random_forest", "rf"):
        return lambda f: random_forest(f, m["trees"], m["labels"])
    if kind == "knn":
        points = [([float(x) for x in p["v"]], p["label"]) for p in m["points"]]
        return lambda f: nearest([f[n] for n in names], points, m.get("k", 5))
    raise ValueError(f"unknown algorithm {kind}")
