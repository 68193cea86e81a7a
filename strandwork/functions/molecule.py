"""Molecules from SMILES: one parser, whose result (atoms, bonds, rings) all descriptors read."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Average masses, valences and atomic numbers.
MASSES = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.065, "Cl": 35.453, "Br": 79.904, "I": 126.905, "B": 10.811, "Si": 28.086, "Se": 78.971, "Fe": 55.845, "Zn": 65.38}
VALENCES = {"H": (1,), "C": (4,), "N": (3, 5), "O": (2,), "F": (1,), "P": (3, 5), "S": (2, 4, 6), "Cl": (1,), "Br": (1,), "I": (1,), "B": (3,), "Si": (4,), "Se": (2,)}
NUMBERS = {"H": 1, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Si": 14, "P": 15, "S": 16, "Cl": 17, "Fe": 26, "Zn": 30, "Se": 34, "Br": 35, "I": 53}
# Partition-coefficient contributions of atom kinds.
LOGP = {"C_ar": 0.1441, "C_sp3": 0.1234, "C_sp2": 0.0, "N_ar": -0.7736, "N_am": -1.0190, "N_sp3": -0.9275, "O_ar": -0.2405, "O_sp3": -0.2677, "O_co2": -0.0200, "F": 0.4202, "Cl": 0.7338, "Br": 0.8456, "I": 0.8857, "S": 0.6895, "P": 0.8612, "H": 0.1234}
METALS = frozenset(("Fe", "Zn", "Cu", "Mg", "Ca", "Mn", "Co", "Ni", "Mo", "Se"))
ORDERS = {"-": 1.0, "=": 2.0, "#": 3.0, ":": 1.5, "/": 1.0, "\\": 1.0}


class Molecule:
    """atoms: (symbol, aromatic, charge, hydrogens); bonds: (i, j, order); rings: atom lists."""

    def __init__(self, smiles: str):
        self.symbol: list[str] = []
        self.aromatic: list[bool] = []
        self.charge: list[int] = []
        self.given: list[int | None] = []
        self.bonds: list[tuple[int, int, float]] = []
        self._parse(smiles)
        self.near: list[list[int]] = [[] for _ in self.symbol]
        for i, j, _ in self.bonds:
            self.near[i].append(j)
            self.near[j].append(i)
        self.rings = self._rings()
        self.hydrogens = [self._hydrogens(i) for i in range(len(self.symbol))]

    def _atom(self, symbol: str, charge: int = 0, given: int | None = None) -> int:
        low = symbol[0].islower()
        self.symbol.append(symbol.capitalize() if low else symbol)
        self.aromatic.append(low)
        self.charge.append(charge)
        self.given.append(given)
        return len(self.symbol) - 1

    def _parse(self, s: str) -> None:
        import re

        stack, last, order, open_rings = [], None, None, {}

        def join(j: int, kind: float | None) -> None:
            self.bonds.append((last, j, kind or (1.5 if self.aromatic[last] and self.aromatic[j] else 1.0)))

        for t in re.findall(r"\[[^\]]*\]|Cl|Br|[BCNOPSFIbcnops]|%\d\d|\d|[-=#:/\\().]", s):
            if t == "(":
                stack.append(last)
            elif t == ")":
                last = stack.pop()
            elif t == ".":
                last = None
            elif t in ORDERS:
                order = ORDERS[t]
            elif t[0] == "%" or t.isdigit():
                n = int(t.lstrip("%"))
                if n in open_rings:
                    other, kind = open_rings.pop(n)
                    join(other, order or kind)
                else:
                    open_rings[n] = (last, order)
                order = None
            else:
                if t[0] == "[":
                    m = re.match(r"\[\d*([A-Z][a-z]?|[a-z]{1,2})(@*)(H\d*)?([+-]+\d*|[+-]\d+)?", t)
                    h = m[3] or ""
                    c = m[4] or ""
                    size = int(c.strip("+-")) if c.strip("+-") else len(c)
                    new = self._atom(m[1], -size if "-" in c else size, (int(h[1:]) if h[1:] else 1) if h else 0)
                else:
                    new = self._atom(t)
                if last is not None:
                    join(new, order)
                last, order = new, None

    def _hydrogens(self, i: int) -> int:
        if self.given[i] is not None:
            return self.given[i]
        orders = [o for a, b, o in self.bonds if i in (a, b)]
        used = sum(orders)
        used = int(used) + 1 if self.aromatic[i] and used % 1 == 0 and self.symbol[i] == "C" and len(orders) == 2 and 1.5 not in orders else int(used)
        if self.aromatic[i] and self.symbol[i] in ("N", "O", "S"):
            return 0
        for v in VALENCES.get(self.symbol[i], (0,)):
            if v >= used:
                return v - used
        return 0

    def _rings(self) -> list[list[int]]:
        """A cycle basis: for each bond outside a spanning tree the shortest way round."""
        parent = list(range(len(self.symbol)))

        def find(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        out, kept = [], [[] for _ in self.symbol]
        for i, j, _ in sorted(self.bonds, key=lambda b: (b[0], b[1])):
            if find(i) != find(j):
                parent[find(i)] = find(j)
                kept[i].append(j)
                kept[j].append(i)
                continue
            todo, came = [i], {i: None}
            while todo and j not in came:
                x = todo.pop(0)
                for y in self.near[x]:
                    if y not in came and not (x == i and y == j):
                        came[y] = x
                        todo.append(y)
            ring, x = [], j
            while x is not None:
                ring.append(x)
                x = came[x]
            if sorted(ring) not in [sorted(r) for r in out]:
                out.append(ring)
        return out

    def order(self, i: int) -> list[float]:
        return [o for a, b, o in self.bonds if i in (a, b)]

    def ring_bond(self, i: int, j: int) -> bool:
        return any(i in r and j in r for r in self.rings)


def formula(m: Molecule) -> str:
    n = {s: m.symbol.count(s) for s in set(m.symbol)}
    n["H"] = n.get("H", 0) + sum(m.hydrogens)
    keys = [k for k in ("C", "H") if n.get(k)] + sorted(k for k in n if k not in ("C", "H") and n[k])
    return "".join(f"{k}{n[k] if n[k] > 1 else ''}" for k in keys)


def _logp(m: Molecule) -> float:
    total = sum(m.hydrogens) * LOGP["H"]
    for i, s in enumerate(m.symbol):
        around = [m.symbol[j] for j in m.near[i]]
        if s == "C":
            total += LOGP["C_ar" if m.aromatic[i] else "C_sp2" if 2.0 in m.order(i) else "C_sp3"]
        elif s == "N":
            total += LOGP["N_ar" if m.aromatic[i] else "N_am" if "O" in around else "N_sp3"]
        elif s == "O":
            total += LOGP["O_ar" if m.aromatic[i] else "O_co2" if any(2.0 in m.order(j) for j in m.near[i]) else "O_sp3"]
        else:
            total += LOGP.get(s, 0.0) if s != "H" else 0.0
    return total


def _tpsa(m: Molecule) -> float:
    table = {("N", True, 0): 12.89, ("N", True, 1): 13.59, ("N", False, 0): 3.24, ("N", False, 1): 23.85, ("N", False, 2): 26.02}
    total = 0.0
    for s, a, h in zip(m.symbol, m.aromatic, m.hydrogens):
        if s == "N":
            total += table.get((s, a, h), 0.0)
        elif s == "O":
            total += 13.14 if a else 20.23 if h == 1 else 17.07
        elif s == "S":
            total += 34.14 if h == 1 else 28.24
        elif s == "P":
            total += 9.81 if h == 0 else 23.47
    return total


DESCRIPTORS = "formula string, weight double, logp double, hbd int, hba int, tpsa double, rotatable int, rings int, aromatic_rings int, heavy int, atoms int, bonds int, fsp3 double, refractivity double, stereocenters int, nitrogens int, amines int, oxygens int, sulfurs int, halogens int, charge int, charged int, positive int, michael boolean, electrophiles int, metals int, coordination double"


def describe(smiles: str) -> tuple:
    m = Molecule(smiles)
    n = m.symbol.count
    weight = sum(MASSES.get(s, 12.0) for s in m.symbol) + 1.008 * sum(m.hydrogens)
    carbons = [i for i, s in enumerate(m.symbol) if s == "C"]
    sp3 = sum(not m.aromatic[i] and max(m.order(i), default=1.0) < 1.5 for i in carbons)
    rotatable = sum(o == 1.0 and not m.ring_bond(i, j) and len(m.near[i]) > 1 and len(m.near[j]) > 1 for i, j, o in m.bonds)
    stereo = sum(m.symbol[i] == "C" and len(m.near[i]) == 4 and len({m.symbol[j] for j in m.near[i]}) == 4 for i in range(len(m.symbol)))
    donors = sum(s in "NO" and h > 0 for s, h in zip(m.symbol, m.hydrogens))
    aromatic_rings = sum(all(m.aromatic[i] for i in r) for r in m.rings)
    heavy = sum(s != "H" for s in m.symbol)
    doubles = [(a, b) for a, b, o in m.bonds if o == 2.0]
    is_c = lambda a: m.symbol[a] == "C"
    carbonyl = any({m.symbol[a], m.symbol[b]} == {"C", "O"} for a, b in doubles)
    michael = carbonyl and any(is_c(a) and is_c(b) for a, b in doubles)
    doubled = {x for pair in doubles for x in pair}
    electrophiles = sum(is_c(i) and any(m.symbol[j] in ("O", "N", "S") and j in doubled for j in m.near[i]) for i in range(len(m.symbol)))
    metals = [i for i, s in enumerate(m.symbol) if s in METALS]
    coordination = 1.5 * sum(m.symbol[j] in ("N", "O", "S") for i in metals for j in m.near[i])
    amines = sum(s == "N" and not a for s, a in zip(m.symbol, m.aromatic))
    more = (n("N"), amines, n("O"), n("S"), sum(n(x) for x in ("F", "Cl", "Br", "I")), sum(m.charge), sum(c != 0 for c in m.charge), sum(c > 0 for c in m.charge), michael, electrophiles, len(metals), coordination)
    return (*(formula(m), weight, _logp(m), donors, n("N") + n("O"), _tpsa(m), rotatable, len(m.rings), aromatic_rings, heavy, heavy + sum(m.hydrogens), len(m.bonds), sp3 / len(carbons) if carbons else 0.0, 0.029 * weight + 1.512 * (n("C") + n("N")) + 0.686 * (n("O") + n("S")), stereo), *more)


KNOWN = 1 << 14  # molecules whose descriptors or bits a worker remembers


def descriptors(smiles: Column) -> Column:
    """The descriptor struct; select it once, then use its fields."""

    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_described(s) for s in x], columns=[c.split()[0] for c in DESCRIPTORS.split(", ")])

    return F.pandas_udf(run, DESCRIPTORS, F.PandasUDFType.SCALAR)(smiles)


@lru_cache(KNOWN)
def _described(smiles: str) -> tuple:
    return describe(smiles)


def _wrap(h: int) -> int:
    h &= 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def morgan(smiles: str, radius: int = 2, size: int = 1024) -> list[int]:
    """Set bits of a circular fingerprint: environments grow by one bond per round."""
    m = Molecule(smiles)
    code = [_wrap(NUMBERS.get(s, 6) * 31 + h * 7 + a * 3 + c) for s, h, a, c in zip(m.symbol, m.hydrogens, m.aromatic, m.charge)]
    bits = {abs(c) % size for c in code}
    for _ in range(radius):
        grown = []
        for i, c in enumerate(code):
            h = c
            for k in sorted(code[j] for j in m.near[i]):
                h = _wrap(h * 31 + k)
            grown.append(h)
        code = grown
        bits |= {abs(c) % size for c in code}
    return sorted(bits)


def paths(smiles: str, size: int = 2048, most: int = 7) -> list[int]:
    """Set bits of a path fingerprint: atomic numbers along all simple paths of 2 to `most` atoms."""
    m, bits = Molecule(smiles), set()

    def walk(path: list[int], h: int) -> None:
        if len(path) > 1:
            bits.add(abs(h) % size)
        if len(path) < most:
            for j in m.near[path[-1]]:
                if j not in path:
                    walk([*path, j], _wrap(h * 31 + NUMBERS.get(m.symbol[j], 6)))

    for i in range(len(m.symbol)):
        walk([i], _wrap(31 + NUMBERS.get(m.symbol[i], 6)))
    return sorted(bits)


def keys(smiles: str) -> list[int]:
    """Structural keys that hold."""
    m = Molecule(smiles)
    n, ar = m.symbol.count, sum(all(m.aromatic[i] for i in r) for r in m.rings)
    rules = {1: n("Cl") + n("Br") > 0, 4: any(s == "N" and a for s, a in zip(m.symbol, m.aromatic)), 6: any(s == "O" and not a for s, a in zip(m.symbol, m.aromatic)), 7: any(s == "N" and not a for s, a in zip(m.symbol, m.aromatic)), 14: bool(m.rings), 16: ar > 0, 18: n("S") > 0, 24: n("F") > 0, 27: ar >= 2, 32: any(o == 3.0 for *_, o in m.bonds), 44: n("I") > 0, 65: ar >= 3, 91: n("O") >= 2, 120: n("N") >= 2, 160: n("P") > 0, 162: any(o == 2.0 for *_, o in m.bonds)}
    return [k for k, v in rules.items() if v]


@lru_cache(KNOWN)
def _bits(kind: str, smiles: str) -> list[int]:
    return {"morgan": morgan, "paths": paths, "keys": keys}[kind](smiles)


def fingerprint(smiles: Column, kind: str = "morgan") -> Column:
    return F.pandas_udf(lambda x: x.map(lambda s: _bits(kind, s)), "array<int>", F.PandasUDFType.SCALAR)(smiles)


def pharmacophore(smiles: Column) -> Column:
    """Atom indices by feature."""

    def one(s: str) -> dict:
        m = Molecule(s)
        at = lambda test: [i for i in range(len(m.symbol)) if test(i)]
        return {
            "HBD": at(lambda i: m.symbol[i] in ("N", "O") and m.hydrogens[i] > 0), "HBA": at(lambda i: m.symbol[i] in ("N", "O")), "Aromatic": at(lambda i: m.aromatic[i]),
            "Hydrophobic": at(lambda i: m.symbol[i] == "C" and not m.aromatic[i] and not {m.symbol[j] for j in m.near[i]} & {"N"} and all(m.symbol[j] == "C" or m.symbol[i] == "C" and 2.0 in m.order(i) for j in m.near[i])),
            "Positive": at(lambda i: m.charge[i] > 0), "Negative": at(lambda i: m.charge[i] < 0),
        }

    return F.pandas_udf(lambda x: x.map(one), "map<string,array<int>>", F.PandasUDFType.SCALAR)(smiles)


def lipinski(d: Column) -> Column:
    return (d["weight"] <= 500) & (d["logp"] <= 5) & (d["hbd"] <= 5) & (d["hba"] <= 10)


def veber(d: Column) -> Column:
    return (d["tpsa"] <= 140) & (d["rotatable"] <= 10)


def ghose(d: Column) -> Column:
    return d["weight"].between(160, 480) & d["logp"].between(-0.4, 5.6) & d["refractivity"].between(40, 130) & d["atoms"].between(20, 70)


def egan(d: Column) -> Column:
    return (d["tpsa"] <= 131.6) & d["logp"].between(-1.0, 5.88)


def muegge(d: Column) -> Column:
    """How many of nine ranges hold."""
    rules = [d["weight"].between(200, 600), d["logp"].between(-2, 5), d["tpsa"] <= 150, d["rings"] <= 7, d["heavy"] > 4, d["atoms"] > d["heavy"], d["rotatable"] <= 15, d["hbd"] <= 5, d["hba"] <= 10]
    return sum((r.cast("int") for r in rules), F.lit(0))


def admet(d: Column) -> Column:
    """Estimates of uptake, distribution, metabolism and toxicity as a struct of 18 rules."""
    w, p, t, ar = d["weight"], d["logp"], d["tpsa"], d["aromatic_rings"]
    return F.struct(
        F.when((t < 60) & p.between(0.0, 3.0), "High").when((t > 140) | (p > 5.0) | (p < -2.0), "Low").otherwise("Moderate").alias("oral"),
        F.when((t < 60) & (w < 500) & (p > 0), "High").otherwise("Low").alias("caco2"),
        ((p > 3.0) & (w > 400) & (d["rings"] >= 2)).alias("pgp"),
        F.when((t < 75) & p.between(-1.0, 4.0), "High (>80%)").when(t > 120, "Low (<20%)").otherwise("Moderate (20-80%)").alias("hia"),
        (p.between(1.0, 3.5) & (w < 450) & (t < 90) & (d["hbd"] <= 3) & (d["hba"] <= 7)).alias("bbb"),
        F.when(p > 3.0, 2.5 + (p - 3.0) * 0.5).when(p < 0.0, F.lit(0.2)).otherwise(0.7 + p * 0.6).alias("vdss"),
        F.when(p > 3.0, "High >90%").when(p > 1.0, "Moderate 50-90%").otherwise("Low <50%").alias("binding"),
        ((w > 400) & (ar >= 1)).alias("cyp3a4"), ((d["amines"] > 0) & (w < 500)).alias("cyp2d6"), ((d["oxygens"] > 0) & p.between(1.0, 5.0)).alias("cyp2c9"),
        ((ar >= 2) & (w > 350)).alias("cyp3a4_inhibitor"), ((d["nitrogens"] > 0) & (ar >= 1)).alias("cyp2d6_inhibitor"),
        F.when(w < 200, "Short <2h").when(w > 500, "Long >8h").otherwise("Moderate 2-8h").alias("half_life"), F.when((p < 1.0) & (w < 300), "High").otherwise("Low/Moderate").alias("renal"),
        ((p > 2.0) & (d["amines"] > 0)).alias("herg"), F.when((d["nitrogens"] > d["amines"]) & (ar >= 2), "Potentially mutagenic").otherwise("Non-mutagenic").alias("ames"),
        F.when((w < 200) & (p < 1.0), "Class I (Low risk)").when(ar >= 3, "Class III (High risk)").otherwise("Class II (Moderate risk)").alias("oral_toxicity"), ((d["sulfurs"] > 0) & (p > 2.0)).alias("skin"),
    )


# Structural alerts and their severity.
ALERTS = {"Michael Acceptor": "High", "Polyhalogenated": "Moderate", "High Complexity": "Low", "Potential Nitro Group": "High"}


def alerts(d: Column) -> Column:
    """Names of the structural alerts that hold."""
    tests = (d["michael"], d["halogens"] >= 4, d["heavy"] > 50, (d["nitrogens"] >= 1) & (d["oxygens"] >= 2) & (d["aromatic_rings"] >= 1))
    return F.filter(F.array(*(F.when(test, name) for name, test in zip(ALERTS, tests))), lambda x: x.isNotNull())


def high_alerts(d: Column) -> Column:
    return F.size(F.filter(alerts(d), lambda x: x.isin([k for k, v in ALERTS.items() if v == "High"])))


def filters_passed(d: Column) -> Column:
    """How many of five drug-likeness filters hold; the last is at least seven of the nine ranges."""
    return sum((c.cast("int") for c in (lipinski(d), veber(d), ghose(d), egan(d), muegge(d) >= 7)), F.lit(0))


def verdict(d: Column) -> Column:
    passed, n = filters_passed(d), F.size(alerts(d))
    return F.when((passed >= 4) & (n == 0), "Excellent").when((passed >= 3) & (n <= 1), "Acceptable").otherwise("Concerns")


def host(s: Column) -> Column:
    """Struct of what binding reads of a protein: residue counts and charge."""
    from strandwork.functions import protein as P

    return F.struct(P.residue_counts(s).alias("n"), P.charge_at(s, 7.0).alias("c"))


def protein_binding(d: Column, s: Column) -> Column:
    """Struct of the terms, free energy, dissociation constant (micromolar), confidence and verdict of a molecule with a protein."""
    return host_binding(d, host(s))


def host_binding(d: Column, protein: Column) -> Column:
    """protein_binding with a protein of which host() is known."""
    from strandwork.functions import protein as P
    from strandwork.functions.sequence import let

    def of(z: Column) -> Column:
        m, n = z["d"], z["h"]["n"]
        count = lambda letters: P.count_in(n, letters)
        bonds = -(F.least(m["hbd"], count("DESTYNQH")) + F.least(m["hba"], count("STYKRHNQW"))) * 0.9
        water = F.when(m["logp"] > 0, -m["logp"] * F.coalesce(F.try_divide(count("AVILMFWPY").cast("double"), n["len"]), F.lit(0.0)) * 0.8).otherwise(0.0)
        ionic = F.when(m["charge"] * z["h"]["c"] < 0, m["charged"] * -0.5).otherwise(m["charged"] * 0.2)
        stacking = -F.least(m["aromatic_rings"] * count("FYWH") * 0.3, F.lit(3.0))
        desolvation, turns = m["tpsa"] * 0.02, m["rotatable"] * 0.3
        dg = bonds + water + ionic + stacking + desolvation + turns
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (-dg - 2.0) / 8.0))
        return F.struct(bonds.alias("hydrogen_bonds"), water.alias("hydrophobic"), ionic.alias("electrostatic"), stacking.alias("aromatic"), desolvation.alias("desolvation"), turns.alias("rotation"), dg.alias("dg"), (F.exp(dg / (0.001987 * 310.15)) * 1e6).alias("kd"), sure.alias("confidence"), ((dg < -5.0) & (sure > 0.4)).alias("binder"))

    return let(F.struct(d.alias("d"), protein.alias("h")), of)


def binding_site(s: Column, most: int = 10) -> Column:
    """0-based places of the first hydrophobic residues."""
    indexed = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.slice(F.transform(F.filter(indexed, lambda e: e["c"].isin(*"AVILMFWP")), lambda e: e["i"]), 1, most)


def dna_binding(d: Column, gc: Column) -> Column:
    """Struct of intercalation, minor groove, covalent risk, mode and free energy of a molecule with DNA of that GC content in percent."""
    from strandwork.functions.sequence import let

    def of(z: Column) -> Column:
        m = z["d"]
        planar = F.when(m["aromatic_rings"] >= 3, 1.0).when(m["aromatic_rings"] == 2, 0.7).when(m["aromatic_rings"] == 1, 0.3).otherwise(0.0)
        inter = planar * 3.0 + F.when(m["charge"] > 0, m["charge"] * 0.5).otherwise(0.0) - F.when(m["weight"] > 600, (m["weight"] - 600) * 0.01).otherwise(0.0) + z["gc"] / 100.0 * 0.5
        groove = F.greatest(F.lit(0.0), 1.0 - m["rotatable"] * 0.1) * 2.0 + (100.0 - z["gc"]) / 100.0 * 1.5 + m["hbd"] * 0.5 + F.when(m["weight"].between(300.0, 600.0), 1.0).otherwise(0.0)
        high = high_alerts(m)
        risk = F.when(high >= 2, "High").when((high > 0) | (m["electrophiles"] >= 2), "Moderate").otherwise("Low")
        mode = F.when(inter > 4.0, "Intercalation").when(groove > 3.0, "Minor groove binding").when(risk == "High", "Covalent alkylation").otherwise("Electrostatic / non-specific")
        return F.struct(inter.alias("intercalation"), groove.alias("groove"), risk.alias("risk"), mode.alias("mode"), (-F.greatest(inter, groove) * 0.8).alias("dg"))

    return let(F.struct(d.alias("d"), gc.alias("gc")), of)


def rna_binding(d: Column, pairs: Column, length: Column) -> Column:
    """Score of a molecule with an RNA of that many base pairs and bases."""
    return F.coalesce(F.try_divide(pairs.cast("double"), length), F.lit(0.0)) * 2.0 + d["positive"] * 0.5 + d["aromatic_rings"] * 0.4 + d["amines"] * 0.3 - d["logp"] * 0.2


def pharmacophore_match(query: Column, candidate: Column) -> Column:
    """Share of the query's feature kinds, as maps of kind to atoms, that the candidate has; kinds without atoms count as absent."""
    kinds = lambda m: F.map_keys(F.map_filter(m, lambda _, x: F.size(x) > 0))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(kinds(query), kinds(candidate))).cast("double"), F.size(kinds(query))), F.lit(0.0))


QSAR = {"mw": "weight", "logP": "logp", "hbd": "hbd", "hba": "hba", "tpsa": "tpsa", "rotB": "rotatable", "rings": "rings", "mr": "refractivity", "fsp3": "fsp3"}


def train_qsar(df, d: str = "d", activity: str = "activity"):
    """One row: intercept (mean activity), a coefficient per descriptor (its correlation with the activity, 0 without variance) and the descriptors' means and deviations."""
    y = F.col(activity).cast("double")
    x = {k: F.col(f"{d}.{f}").cast("double") for k, f in QSAR.items()}
    r = lambda c: F.when((F.stddev_pop(c) > 0) & (F.stddev_pop(y) > 0), F.corr(c, y)).otherwise(0.0)
    return df.agg(F.avg(y).alias("intercept"), *(r(c).alias(k) for k, c in x.items()), *(F.avg(c).alias(f"{k}_mean") for k, c in x.items()), *(F.stddev_pop(c).alias(f"{k}_sd") for k, c in x.items()))


def predict_qsar(df, model, d: str = "d"):
    """df with prediction: intercept plus coefficients times raw descriptors. model: the row of train_qsar."""
    total = sum((F.col(f"__m.{k}") * F.col(f"{d}.{f}") for k, f in QSAR.items()), F.col("__m.intercept"))
    return df.join(F.broadcast(model.select(F.struct("*").alias("__m")))).withColumn("prediction", total).drop("__m")


def qsar_r2(df, model, d: str = "d", activity: str = "activity"):
    """One row: share of the activity's variance that standardised descriptors times their coefficients explain."""
    part = lambda k, f: F.when(F.col(f"__m.{k}_sd") > 0, F.col(f"__m.{k}") * (F.col(f"{d}.{f}") - F.col(f"__m.{k}_mean")) / F.col(f"__m.{k}_sd")).otherwise(0.0)
    fit = sum((part(k, f) for k, f in QSAR.items()), F.col("__m.intercept"))
    y, mean = F.col(activity).cast("double"), F.col("__m.intercept")
    rows = df.join(F.broadcast(model.select(F.struct("*").alias("__m"))))
    return rows.agg(F.coalesce(1 - F.try_divide(F.sum((y - fit) * (y - fit)), F.sum((y - mean) * (y - mean))), F.lit(0.0)).alias("r2"))
