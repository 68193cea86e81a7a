"""Feature extractors and the built-in classifiers: one call per task, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.functions import protein as P
from strandwork.functions import sequence as S
from strandwork.operators.models import BUILT_IN, answer, bayes_scores


def _share(s: Column, letters: str) -> Column:
    return F.coalesce(F.try_divide(S.count_of(s, letters).cast("double"), F.length(s)), F.lit(0.0))


def coding_features(s: Column) -> list[Column]:
    """gc, AT skew, linguistic complexity, share of codons that are no stop, GC of third places, repeats, reading frames of 30 and more bases per 100."""
    codons = S.codons(s)
    n = F.floor(F.length(s) / 3)
    a, t = S.count_of(s, "A"), S.count_of(s, "T")
    stops = F.size(F.filter(codons, lambda c: c.isin("TAA", "TAG", "TGA")))
    third = F.size(F.filter(codons, lambda c: F.substring(c, 3, 1).isin("G", "C")))
    complexity = S.linguistic_complexity(s)
    skew = F.coalesce(F.try_divide((a - t).cast("double"), a + t), F.lit(0.0))
    frames = F.size(S.orfs(s, 30)) / F.greatest(F.length(s) / 100.0, F.lit(1.0))
    return [S.gc_content(s) / 100.0, skew, complexity, 1.0 - stops / F.greatest(n, F.lit(1)), F.coalesce(F.try_divide(third.cast("double"), n), F.lit(0.5)), 1.0 - complexity, frames]


def promoter_features(s: Column) -> list[Column]:
    """gc, CG pairs per place, TATA, GC and CAAT box scores."""
    gc = S.gc_content(s) / 100.0
    cpg = F.regexp_count(s, F.lit("CG")).cast("double") / F.greatest(F.length(s) - 1, F.lit(1))
    tata = F.when(s.rlike("TATAAAA|TATAAAT|TATAAAG|TATAATG"), 1.0).when(s.contains("TATAA"), 0.5).when(s.contains("TATA"), 0.2).otherwise(0.0)
    box = F.when(s.contains("GGGCGG"), 1.0).when(s.contains("GGCGG"), 0.6).when(S.count_of(s, "GC") > 0.65 * F.length(s), 0.3).otherwise(0.0)
    return [gc, cpg, tata, box, F.when(s.contains("CAAT"), 0.8).otherwise(0.0)]


def splice_features(s: Column, position: int | Column = 0, half: int = 10) -> list[Column]:
    """Of the bases around a place: gc, GT or AG at it, pyrimidines, branch point, and their weighted sum."""
    at = F.lit(position) if isinstance(position, int) else position
    start = F.greatest(at - half, F.lit(0))
    local = F.substring(s, start + 1, F.greatest(F.least(F.length(s), at + half) - start, F.lit(0)))
    local = F.when(F.length(local) > 0, local).otherwise(s)
    rule = F.substring(s, at + 1, F.lit(2)).isin("GT", "AG").cast("double")
    gc, py = _share(local, "GC"), _share(local, "CT")
    branch = F.when(local.contains("TACTAAC") | local.contains("TACTAAG"), 0.9).when(_share(local, "A") > 0.35, 0.4).otherwise(0.1)
    return [gc, rule, py, branch, rule * 0.5 + gc * 0.3 + py * 0.2]


def enzyme_features(s: Column) -> list[Column]:
    x = P.batch_figures(s)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["instability"] / 100.0))
    return [x["gravy"], x["hydrophobic"], x["aliphatic"], x["pi"], x["aromaticity"], x["charge7"], x["weight"], unit]


def membrane_features(s: Column) -> list[Column]:
    x = P.batch_figures(s)
    return [x["gravy"], x["hydrophobic"], x["charged"], x["aliphatic"], x["aromaticity"], x["pi"]]


def _of(d: Column, *names: str) -> list[Column]:
    return [d[n].cast("double") for n in names]


def activity_features(d: Column) -> list[Column]:
    """Of a molecule's descriptor struct."""
    return _of(d, "weight", "logp", "hbd", "hba", "tpsa", "rotatable", "rings", "fsp3")


def toxicity_features(d: Column) -> list[Column]:
    return _of(d, "weight", "logp", "hbd", "hba", "tpsa", "rotatable", "aromatic_rings")


def herg_features(d: Column) -> list[Column]:
    return _of(d, "logp", "weight", "hbd", "hba", "aromatic_rings", "tpsa")


EXTRACTORS = {
    "coding": coding_features, "promoter": promoter_features, "splice": splice_features, "enzyme": enzyme_features, "membrane": membrane_features, "activity": activity_features, "toxicity": toxicity_features, "herg": herg_features,
}


def predict(model: str, x: Column) -> Column:
    """Struct of label, confidence and probabilities of a built-in model, for a sequence, a protein or a descriptor struct.

    The features and the scores are computed once per row.
    """
    names, classes = BUILT_IN[model]

    def of(f: Column) -> Column:
        scores = bayes_scores([f[n] for n in names], classes)
        return S.let(F.struct(*(c.alias(k) for k, c in scores.items())), lambda z: answer({k: z[k] for k in scores}))

    return S.let(F.struct(*(c.cast("double").alias(n) for c, n in zip(EXTRACTORS[model](x), names))), of)


def full_analysis(kind: str, x: Column) -> Column:
    """Struct of all predictions for dna, protein or molecule."""
    models = {"dna": ("coding", "promoter", "splice"), "protein": ("enzyme", "membrane"), "molecule": ("activity", "toxicity", "herg")}[kind]
    return F.struct(*(predict(m, x).alias(m) for m in models))


def confidence_band(confidence: Column) -> Column:
    """high from 0.75, medium from 0.5, low below."""
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")
