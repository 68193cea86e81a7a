"""Protein descriptors that look at pairs of residues at a lag, features of pairs of proteins and secondary structure.

Sums over pairs at up to 30 lags are array work on a sequence's values, so they run in Arrow batches; the rest are
column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.functions import protein as P
from strandwork.functions import tables as T
from strandwork.functions.sequence import kmers, let

FEATURES = "map<string,double>"


def _lookup(values: dict[str, float], missing: float = np.nan) -> np.ndarray:
    out = np.full(256, missing)
    out[[ord(k) for k in values]] = list(values.values())
    return out


def _bytes(s: str | None) -> np.ndarray:
    return np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)


def _column(one, s: Column) -> Column:
    return F.pandas_udf(lambda x: x.map(one), FEATURES, F.PandasUDFType.SCALAR)(s)


def _at_lags(x: np.ndarray, most: int):
    for lag in range(1, min(most, len(x) - 1) + 1):
        yield lag, x[:-lag], x[lag:]


def moran(s: Column, most: int = 30, name: str = "hydro", values: dict[str, float] | None = None) -> Column:
    """Moran autocorrelation of a property at lags 1 to most, of residues that have it; 0 without variance."""
    table = _lookup(values or T.HYDROPHOBICITY)

    def one(text: str | None) -> dict:
        x = table[_bytes(text)]
        x = x[~np.isnan(x)]
        y = x - x.mean() if len(x) else x
        var = (y * y).mean() if len(y) else 0.0
        return {f"Moran_{name}_lag{k}": float((a * b).sum() / len(a) / var) if var else 0.0 for k, a, b in _at_lags(y, most)}

    return _column(one, s)


def geary(s: Column, most: int = 30, properties: dict[str, dict[str, float]] | None = None) -> Column:
    """Geary autocorrelation of properties at lags 1 to most: n * sum of squared differences / (2 (n - lag) (n - 1) variance)."""
    tables = {k: _lookup(x) for k, x in (properties or {"MW": T.RESIDUE_MASS, "pK1": T.PK1}).items()}

    def one(text: str | None) -> dict:
        out: dict = {}
        for name, table in tables.items():
            x = table[_bytes(text)]
            x = x[~np.isnan(x)]
            n, var = len(x), float(((x - x.mean()) ** 2).mean()) if len(x) else 0.0
            out |= {f"Geary_{name}_lag{k}": float(n * ((a - b) ** 2).sum() / (2.0 * (n - k) * (n - 1) * var)) if var else 0.0 for k, a, b in _at_lags(x, most)}
        return out

    return _column(one, s)


def _with_lags(text: str | None, head: str, lag_name: str, weight: float, lags: list[float], size: int) -> dict:
    code = _bytes(text)
    total = size + weight * sum(lags)
    counts = np.bincount(code, minlength=256)
    out = {f"{head}_{a}": float(counts[ord(a)] / total) if total else 0.0 for a in T.RESIDUES}
    return out | {f"{head}_{lag_name}{i}": weight * x / total for i, x in enumerate(lags, 1)}


def quasi_sequence_order(s: Column, most: int = 30, weight: float = 0.1, place: dict[str, float] | None = None) -> Column:
    """Residue counts and mean squared distances at lags, over their weighted sum; residues are as far apart as their places on a scale."""
    table = _lookup(place or T.ORDER_PLACE)

    def one(text: str | None) -> dict:
        x = table[_bytes(text)]
        known = int((~np.isnan(x)).sum())
        lags = [float(np.nanmean((a - b) ** 2)) if (~np.isnan(a - b)).any() else 0.0 for _, a, b in _at_lags(x, most)]
        return _with_lags(text, "QSO", "lag", weight, lags, known)

    return _column(one, s)


def pseudo_composition(s: Column, most: int = 30, weight: float = 0.05) -> Column:
    """Residue counts and mean squared differences of three scaled properties at lags, over their weighted sum."""

    def scaled(values: dict[str, float]) -> np.ndarray:
        x = np.array(list(values.values()))
        return _lookup({k: (y - x.mean()) / x.std() for k, y in values.items()}, 0.0)

    tables = [scaled(x) for x in (T.HYDROPHOBICITY, T.HYDROPHILICITY, T.SIDE_MASS)]

    def one(text: str | None) -> dict:
        code = _bytes(text)
        x = np.stack([t[code] for t in tables])
        lags = [float(((x[:, :-k] - x[:, k:]) ** 2).sum() / 3 / (len(code) - k)) for k in range(1, min(most, len(code) - 1) + 1)]
        return _with_lags(text, "PAAC", "lambda", weight, lags, len(code))

    return _column(one, s)


def composition(s: Column, k: int) -> Column:
    """Map of each k-mer (k up to 8) that occurs to its number."""

    def one(text: str | None) -> dict:
        code = _bytes(text).astype(np.int64)
        n = len(code) - k + 1
        if n < 1:
            return {}
        number = sum(code[i : i + n] << 8 * (k - 1 - i) for i in range(k))
        kinds, counts = np.unique(number, return_counts=True)
        return {int(x).to_bytes(k, "big").decode(): int(c) for x, c in zip(kinds, counts)}

    return F.pandas_udf(lambda x: x.map(one), "map<string,bigint>", F.PandasUDFType.SCALAR)(s)


def _prefixed(head: str, m: Column) -> Column:
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(head), k))


def all_features(s: Column, names: list[str] | None = None) -> Column:
    """All descriptors as one flat map: composition, the first hundred dipeptides, classes, order, pseudo composition, autocorrelations and figures.

    With names, only the groups that hold one of them are computed.
    """
    n = F.greatest(F.length(s), F.lit(1)).cast("double")

    def aac() -> Column:
        return F.map_from_arrays(F.array(*map(F.lit, T.RESIDUES)), F.array(*(P.count_of(s, a) / n for a in T.RESIDUES)))

    def dipeptides() -> Column:
        pairs = [a + b for a in T.RESIDUES for b in T.RESIDUES][:100]
        return let(composition(s, 2), lambda m: F.map_from_arrays(F.array(*map(F.lit, pairs)), F.transform(F.array(*map(F.lit, pairs)), lambda p: F.coalesce(F.try_element_at(m, p), F.lit(0)) / F.greatest(n - 1, F.lit(1.0)))))

    def some(head: str) -> list[str] | None:
        return None if names is None else [x.removeprefix(head) for x in names if x.startswith(head)]

    classes = None if names is None else [p for p in T.CTD if any(x.startswith(f"{p}_") for x in some("CTD_"))]
    groups = {
        "AAC_": lambda: _prefixed("AAC_", aac()), "DPC_": lambda: _prefixed("DPC_", dipeptides()), "CTD_": lambda: _prefixed("CTD_", P.ctd(s, classes)), "QSO_": lambda: quasi_sequence_order(s),
        "PAAC_": lambda: pseudo_composition(s), "Geary_": lambda: geary(s), "Moran_": lambda: moran(s), "PC_": lambda: _prefixed("PC_", P.profile(s, some("PC_"))),
    }
    return F.map_concat(*(make() for head, make in groups.items() if names is None or some(head)))


def conjunction(a: Column, b: Column) -> Column:
    """Map of 47 features of a pair of proteins: products and differences of their compositions, ratios, sums and products of their figures."""

    def of(z: Column) -> Column:
        x, y, nx, ny = z["x"], z["y"], z["nx"], z["ny"]
        share = lambda n, aa: F.coalesce(F.try_divide(n[aa].cast("double"), n["len"]), F.lit(0.0))
        ratio = lambda p, q: F.coalesce(F.try_divide(p.cast("double"), q), F.lit(0.0))
        parts = {f"AAC_prod_{aa}": share(nx, aa) * share(ny, aa) for aa in T.RESIDUES} | {f"AAC_diff_{aa}": F.abs(share(nx, aa) - share(ny, aa)) for aa in T.RESIDUES}
        parts |= {
            "MW_ratio": ratio(x["weight"], y["weight"]), "pI_diff": F.abs(z["px"] - z["py"]), "GRAVY_sum": x["gravy"] + y["gravy"], "GRAVY_product": x["gravy"] * y["gravy"], "charge_product": x["charge7"] * y["charge7"],
            "length_ratio": ratio(x["len"], y["len"]), "hydro_ratio": ratio(x["hydrophobic"], y["hydrophobic"]),
        }
        return F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts.values()))

    return let(F.struct(P.figures(a).alias("x"), P.figures(b).alias("y"), P.residue_counts(a).alias("nx"), P.residue_counts(b).alias("ny"), P.isoelectric_point(a).alias("px"), P.isoelectric_point(b).alias("py")), of)


def _interface_share(s: Column, half: int = 3) -> Column:
    """Share of residues whose mean interface propensity, of the window around them, is at least 1.05."""
    table = _lookup(T.INTERFACE, 1.0)

    def one(text: str | None) -> float:
        x = table[_bytes(text)]
        sums, at = np.concatenate([[0.0], np.cumsum(x)]), np.arange(len(x))
        lo, hi = np.maximum(at - half, 0), np.minimum(at + half + 1, len(x))
        return float(((sums[hi] - sums[lo]) / (hi - lo) >= 1.05 - 1e-9).mean()) if len(x) else 0.0

    return F.pandas_udf(lambda x: x.map(one), "double", F.PandasUDFType.SCALAR)(s)


def _dipeptide_shares(s: Column) -> Column:
    n = F.greatest(F.length(s) - 1, F.lit(1)).cast("double")
    return F.transform_values(composition(s, 2), lambda _, c: c / n)


def interaction(a: Column, b: Column) -> Column:
    """Struct of score, confidence, likely, evidence and the six terms for a pair of proteins."""

    def of(z: Column) -> Column:
        x, y = z["x"], z["y"]
        charge = F.when(x["charge7"] * y["charge7"] < 0, 1.0).otherwise(0.3)
        water = 1.0 - F.abs(x["hydrophobic"] - y["hydrophobic"])
        gravy = F.when(x["gravy"] * y["gravy"] < 0, 0.8).otherwise(0.4)
        face = (z["fx"] + z["fy"]) / 2.0
        size = F.exp(-F.abs(F.log2(F.greatest(x["len"], F.lit(1)).cast("double") / F.greatest(y["len"], F.lit(1)))) / 3.0)
        both = F.map_zip_with(z["dx"], z["dy"], lambda _, p, q: F.coalesce(F.least(p, q) * (p.isNotNull() & q.isNotNull()).cast("int"), F.lit(0.0)))
        alike = F.aggregate(F.map_values(both), F.lit(0.0), lambda t, v: t + v)
        raw = charge * 0.25 + water * 0.20 + gravy * 0.15 + face * 0.25 + size * 0.10 + alike * 0.05
        signs = [(charge > 0.7, "Charge complementarity"), (water > 0.7, "Hydrophobic patch match"), (gravy > 0.7, "Surface complementarity (GRAVY)"), (face > 0.15, "High interface propensity"), (alike > 0.3, "Dipeptide composition similarity")]
        evidence = F.filter(F.array(*(F.when(test, name) for test, name in signs)), lambda e: e.isNotNull())
        confidence = F.least(F.lit(1.0), raw * 1.2)
        terms = {"charge_complementarity": charge, "hydrophobic_complementarity": water, "gravy_compatibility": gravy, "interface_density": face, "size_compatibility": size, "dipeptide_similarity": alike}
        return F.struct(raw.alias("score"), confidence.alias("confidence"), (confidence >= 0.5).alias("likely"), evidence.alias("evidence"), *(c.alias(k) for k, c in terms.items()))

    return let(F.struct(P.figures(a).alias("x"), P.figures(b).alias("y"), _interface_share(a).alias("fx"), _interface_share(b).alias("fy"), _dipeptide_shares(a).alias("dx"), _dipeptide_shares(b).alias("dy")), of)


def _structure(s: str | None) -> str:
    code = _bytes(s)
    n = len(code)
    out = np.full(n, ord("C"), np.uint8)
    if n >= 6:
        sums = np.concatenate([[0.0], np.cumsum(_lookup(T.HELIX, 0.9)[code])])
        for i in np.flatnonzero((sums[6:] - sums[:-6]) / 6 >= 1.1 - 1e-9):
            out[i : i + 6] = ord("H")
    if n >= 4:
        water = np.concatenate([[0], np.cumsum(np.isin(code, _bytes(T.SHEET_RESIDUES)))])
        for i in np.flatnonzero((water[4:] - water[:-4] >= 2) & (out[: n - 3] != ord("H"))):
            part = out[i : i + 4]
            part[part != ord("H")] = ord("E")
    for i in range(1, n - 1):  # a place between helix and sheet is a turn
        if {out[i - 1], out[i + 1]} == {ord("H"), ord("E")}:
            out[i] = ord("T")
    return out.tobytes().decode()


def secondary_structure(s: Column) -> Column:
    """A letter per residue: H helix, E sheet, T turn, C coil."""
    return F.pandas_udf(lambda x: x.map(_structure), "string", F.PandasUDFType.SCALAR)(s)


def report(s: Column) -> Column:
    """Struct of the verdicts of a protein report: stability, acidity, binding, solubility, thermostability and net charge."""

    def of(z: Column) -> Column:
        x = z["x"]
        return F.struct(
            F.when(z["inst"] < 40, "stable").otherwise("unstable").alias("stability"), F.when(z["pi"] < 6.0, "acidic").when(z["pi"] > 8.5, "basic").otherwise("neutral").alias("acidity"),
            F.when(x["boman"] > 2.48, "high").when(x["boman"] < 1.0, "low").otherwise("moderate").alias("boman_band"), F.when(x["gravy"] > 0, "hydrophobic").otherwise("hydrophilic").alias("nature"),
            F.when(x["aliphatic"] > 80, "high").otherwise("moderate").alias("thermostability"), F.when(x["charge7"] > 0, "positive").when(x["charge7"] < 0, "negative").otherwise("near zero").alias("net"),
        )

    return let(F.struct(P.figures(s).alias("x"), P.instability_index(s).alias("inst"), P.isoelectric_point(s).alias("pi")), of)


def top_interface(s: Column, most: int = 10) -> Column:
    """The residues of the highest interface propensity, the first on ties."""
    ranked = F.array_sort(F.transform(P.interface_residues(s), lambda e: F.struct((-e["score"]).alias("minus"), e["pos"].alias("pos"))))
    return F.transform(F.slice(ranked, 1, most), lambda e: F.struct(e["pos"].alias("pos"), F.substring(s, e["pos"].cast("int") + 1, F.lit(1)).alias("aa"), (-e["minus"]).alias("score")))
