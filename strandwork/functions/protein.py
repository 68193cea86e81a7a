"""Protein functions as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.functions import tables as T
from strandwork.functions.sequence import count_of, kmers, let, literal_map


def total(s: Column, values: dict[str, float]) -> Column:
    """Sum of a residue property, from residue counts."""
    return sum((count_of(s, aa) * v for aa, v in sorted(values.items()) if v), F.lit(0.0))


def mean(s: Column, values: dict[str, float]) -> Column:
    """Mean of a property over the residues that have one; null without any."""
    return F.try_divide(total(s, values), count_of(s, "".join(sorted(values))))


def residue_counts(s: Column) -> Column:
    """Struct of the counts of the 20 residues and len: each figure below needs no further pass over the text."""
    return F.struct(*(count_of(s, aa).alias(aa) for aa in T.RESIDUES), F.length(s).cast("long").alias("len"))


def count_in(n: Column, letters: str) -> Column:
    return sum((n[aa] for aa in letters if aa in T.RESIDUES), F.lit(0).cast("long"))


def total_in(n: Column, values: dict[str, float]) -> Column:
    return sum((n[aa] * v for aa, v in sorted(values.items()) if v), F.lit(0.0))


def figures(s: Column) -> Column:
    """Struct of the figures that residue counts give: len, weight, gravy, boman, aromaticity, hydrophobic, aliphatic, extinction, charge7."""

    def of(n: Column) -> Column:
        share = lambda letters: F.try_divide(count_in(n, letters).cast("double"), n["len"])
        mean_in = lambda values: F.try_divide(total_in(n, values), count_in(n, "".join(sorted(values))))
        aliphatic = F.coalesce(F.try_divide(100.0 * (n["A"] + 2.9 * n["V"] + 3.9 * (n["I"] + n["L"])), n["len"]), F.lit(0.0))
        return F.struct(
            n["len"].alias("len"), (total_in(n, T.MASS) - (n["len"] - 1) * T.WATER).alias("weight"), mean_in(T.HYDROPATHY).alias("gravy"), mean_in(T.BOMAN).alias("boman"), share(T.AROMATIC).alias("aromaticity"),
            share(T.HYDROPHOBIC).alias("hydrophobic"), aliphatic.alias("aliphatic"), (n["W"] * 5500.0 + n["Y"] * 1490.0 + n["C"] * 125.0).alias("extinction"), _charge(lambda aa: n[aa], F.lit(7.0)).alias("charge7"),
        )

    return let(residue_counts(s), of)


def molecular_weight(s: Column) -> Column:
    return total(s, T.MASS) - (F.length(s) - 1) * T.WATER


def _charge(count, ph: Column) -> Column:
    part = lambda x: 1.0 / (1.0 + F.pow(F.lit(10.0), x))
    out = part(ph - T.PKA_N_TERM) - part(T.PKA_C_TERM - ph)
    for aa, pk in T.PKA.items():
        out = out + (-part(pk - ph) if aa in "DECY" else part(ph - pk)) * count(aa)
    return out


def charge_at(s: Column, ph: Column | float) -> Column:
    return _charge(lambda aa: count_of(s, aa), F.lit(ph) if isinstance(ph, float) else ph)


def _batch_charge(n: dict[str, np.ndarray], ph: np.ndarray | float) -> np.ndarray:
    """The charge of all texts of a batch, from their residue counts."""
    charge = 1.0 / (1.0 + 10.0 ** (ph - T.PKA_N_TERM)) - 1.0 / (1.0 + 10.0 ** (T.PKA_C_TERM - ph))
    for aa, pk in T.PKA.items():
        sign = -1.0 if aa in "DECY" else 1.0
        charge = charge + sign / (1.0 + 10.0 ** (sign * (ph - pk))) * n[aa]
    return charge


def _bisect(n: dict[str, np.ndarray], size: int, rounds: int) -> np.ndarray:
    lo, hi = np.zeros(size), np.full(size, 14.0)
    for _ in range(rounds):
        mid = (lo + hi) / 2.0
        up = _batch_charge(n, mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2.0


def isoelectric_point(s: Column, rounds: int = 100) -> Column:
    """Bisection of the charge over [0, 14], for all texts of an Arrow batch at once; a null text has no charge and ends at 0."""

    def run(texts):
        n = {aa: np.array([np.nan if t is None else t.count(aa) for t in texts]) for aa in T.PKA}
        return pd.Series(_bisect(n, len(texts), rounds))

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(s)


def gravy(s: Column) -> Column:
    return mean(s, T.HYDROPATHY)


def boman(s: Column) -> Column:
    return mean(s, T.BOMAN)


def aromaticity(s: Column) -> Column:
    return F.try_divide(count_of(s, T.AROMATIC).cast("double"), F.length(s))


def hydrophobic_ratio(s: Column) -> Column:
    return F.try_divide(count_of(s, T.HYDROPHOBIC).cast("double"), F.length(s))


def aliphatic_index(s: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * (count_of(s, "A") + 2.9 * count_of(s, "V") + 3.9 * count_of(s, "IL")), F.length(s)), F.lit(0.0))


def extinction_coefficient(s: Column) -> Column:
    return count_of(s, "W") * 5500.0 + count_of(s, "Y") * 1490.0 + count_of(s, "C") * 125.0


def _pair_weights() -> np.ndarray:
    """Of all pairs of bytes, in whole hundredths: sums of doubles depend on their order and can miss a tie of the rounding."""
    out = np.full((256, 256), 100, np.int64)
    for k, x in T.INSTABILITY.items():
        out[ord(k[0]), ord(k[1])] = round(100 * x)
    return out


def _instability(code: np.ndarray, weights: np.ndarray) -> float:
    return float(weights[code[:-1], code[1:]].sum() / 10.0 / len(code)) if len(code) else np.nan


def instability_index(s: Column) -> Column:
    """Ten times the sum of the neighbours' weights over the length: one lookup per pair, in Arrow batches, as a map of 400 pairs is searched in turn."""
    weights = _pair_weights()

    def one(text: str | None) -> float | None:
        return _instability(np.frombuffer(text.encode("ascii", "replace"), np.uint8), weights) if text else None

    return F.pandas_udf(lambda x: x.map(one), "double", F.PandasUDFType.SCALAR)(s)


def batch_figures(s: Column) -> Column:
    """Struct of gravy, hydrophobic, charged, aliphatic, aromaticity, charge7, weight, pi and instability, as the functions above give them.

    Each text is read once per batch, for the counts of its bytes and its pairs; the figures are sums over the batch's counts.
    """
    weights, names = _pair_weights(), ("gravy", "hydrophobic", "charged", "aliphatic", "aromaticity", "charge7", "weight", "pi", "instability")

    def run(texts):
        counts, unstable = np.full((len(texts), 256), np.nan), np.full(len(texts), np.nan)
        for i, t in enumerate(texts):
            if t is not None:
                code = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
                counts[i], unstable[i] = np.bincount(code, minlength=256), _instability(code, weights)
        n, size = {aa: counts[:, ord(aa)] for aa in T.RESIDUES}, counts.sum(axis=1)
        total = lambda values: sum((n[aa] * v for aa, v in sorted(values.items()) if v), 0.0)
        share = lambda letters: sum(n[aa] for aa in letters) / size
        with np.errstate(invalid="ignore", divide="ignore"):  # a text without residues has null shares, as NaN is sent
            aliphatic = np.where(size > 0, 100.0 * (n["A"] + 2.9 * n["V"] + 3.9 * (n["I"] + n["L"])) / size, 0.0)
            out = (
                total(T.HYDROPATHY) / sum(n[aa] for aa in T.HYDROPATHY), share(T.HYDROPHOBIC), np.where(size > 0, share("RKHDE"), 0.0), aliphatic, share(T.AROMATIC),
                _batch_charge(n, 7.0), total(T.MASS) - (size - 1) * T.WATER, _bisect(n, len(texts), 100), unstable,
            )
        return pd.DataFrame(dict(zip(names, out)))

    return F.pandas_udf(run, ", ".join(f"{x} double" for x in names), F.PandasUDFType.SCALAR)(s)


def residue_values(s: Column, values: dict[str, float], default: float | None = None) -> Column:
    """The property along the sequence; unknown residues have the default or are left out."""
    table = literal_map(values)
    each = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.try_element_at(table, c))
    return F.filter(each, lambda v: v.isNotNull()) if default is None else F.transform(each, lambda v: F.coalesce(v, F.lit(default)))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.greatest(F.size(a), F.lit(1))


def interface_residues(s: Column, half: int = 3) -> Column:
    """Structs of pos and score: the mean interface propensity of the window around each residue, cut at the ends."""

    def around(v: Column) -> Column:
        lo = lambda i: F.greatest(i - half, F.lit(0))
        return F.transform(v, lambda _, i: F.struct(i.cast("long").alias("pos"), _mean(F.slice(v, lo(i) + 1, F.least(i + half, F.size(v) - 1) - lo(i) + 1)).alias("score")))

    return let(residue_values(s, T.INTERFACE, 1.0), around)


def autocorrelation(s: Column, values: dict[str, float], lag: int, geary: bool) -> Column:
    """Geary or Moran autocorrelation of a property at a lag; null where the sequence is too short."""

    def of(x: Column) -> Column:
        v, m = x["v"], x["m"]
        n = F.size(v)
        var = _mean(F.transform(v, lambda y: F.pow(y - m, F.lit(2.0))))
        pairs = F.zip_with(F.slice(v, F.lit(1), F.greatest(n - lag, F.lit(0))), F.slice(v, F.lit(lag + 1), F.greatest(n - lag, F.lit(0))), lambda a, b: F.pow(a - b, F.lit(2.0)) if geary else (a - m) * (b - m))
        num = F.aggregate(pairs, F.lit(0.0), lambda a, y: a + y)
        raw = F.try_divide(n * num, 2.0 * (n - lag) * (n - 1) * var) if geary else F.try_divide(F.try_divide(num, n - lag), var)
        return F.when(n > lag, F.coalesce(raw, F.lit(0.0)))

    return let(let(residue_values(s, values), lambda v: F.struct(v.alias("v"), _mean(v).alias("m"))), of)


def ctd(s: Column, properties: list[str] | None = None) -> Column:
    """Composition, transition and distribution descriptors as a map of 95 features, or of those of some properties, in Arrow batches."""
    tables = {}
    for prop, classes in T.CTD.items():
        if properties is None or prop in properties:
            tables[prop] = np.zeros(256, np.uint8)
            for k, letters in enumerate(classes, 1):
                tables[prop][[ord(c) for c in letters]] = k

    def one(text: str | None) -> dict[str, float]:
        code, out = np.frombuffer((text or "").encode("ascii", "replace"), np.uint8), {}
        for prop, table in tables.items():
            c = table[code]
            c = c[c > 0]
            n, where = len(c), {k: np.flatnonzero(c == k) for k in (1, 2, 3)}
            out |= {f"{prop}_C{k}": len(w) / n if n else 0.0 for k, w in where.items()}
            out[f"{prop}_T"] = float((c[1:] != c[:-1]).sum() / (n - 1)) if n > 1 else 0.0
            for k, w in where.items():
                m = len(w)
                out |= {f"{prop}_{k}_{name}": float(w[i] / n) if m else 0.0 for name, i in (("D1", 0), ("D25", m // 4), ("D50", m // 2), ("D75", 3 * m // 4), ("D100", m - 1))}
        return out

    return F.pandas_udf(lambda x: x.map(one), "map<string,double>", F.PandasUDFType.SCALAR)(s)


def profile(s: Column, names: list[str] | None = None) -> Column:
    """The eleven physicochemical figures as a map, or the named ones of them."""
    parts = {
        "length": F.length(s).cast("double"), "molecularWeight": molecular_weight(s), "isoelectricPoint": isoelectric_point(s), "aromaticity": aromaticity(s), "instabilityIndex": instability_index(s), "gravy": gravy(s),
        "aliphaticIndex": aliphatic_index(s), "bomanIndex": boman(s), "chargeAtPH7": charge_at(s, 7.0), "hydrophobicRatio": hydrophobic_ratio(s), "extinctionCoeff": extinction_coefficient(s),
    }
    return F.create_map(*(x for k, v in parts.items() if names is None or k in names for x in (F.lit(k), v)))


def rgene_evidence(s: Column) -> Column:
    """Names of the resistance-gene signs that the protein shows."""
    signs = [F.when(s.rlike(p), n) for n, p in T.RGENE_PATTERNS.items()]
    signs.append(F.when(F.regexp_count(s, F.lit(T.RGENE_LRR)) >= 2, "lrr"))
    signs.append(F.when(F.substring(s, 1, 300).rlike(T.RGENE_TIR), "tir"))
    signs.append(F.when((F.length(s) > 25) & (count_of(F.substring(s, 1, 25), T.HYDROPHOBIC) / 25.0 > 0.5), "signal"))
    return F.filter(F.array(*signs), lambda x: x.isNotNull())


def is_rgene(evidence: Column) -> Column:
    nbs = F.array_contains(evidence, "p_loop") | F.array_contains(evidence, "rnbs") | F.array_contains(evidence, "mhd")
    return nbs | (F.array_contains(evidence, "lrr") & F.array_contains(evidence, "kinase"))


def metal_binding(s: Column) -> Column:
    """0-based places of H, C, D, E and M."""
    indexed = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.transform(F.filter(indexed, lambda e: e["c"].isin(*"HCDEM")), lambda e: e["i"])
