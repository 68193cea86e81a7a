"""Nucleotide sequence functions as Column expressions: no Python on the executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.functions import tables as T


def literal_map(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(s: Column, letters: str) -> Column:
    """How many of the letters the sequence has."""
    return (F.length(s) - F.length(F.translate(s, letters, ""))).cast("long")


def is_valid(s: Column, alphabet: str) -> Column:
    return F.upper(s).rlike("^[" + T.ALPHABETS[alphabet] + "]*$")


def infer_kind(s: Column) -> Column:
    """rna, protein or dna from the letters present."""
    u = F.upper(s)
    protein = u.rlike("^[" + T.ALPHABETS["PROTEIN"] + "]*$") & u.rlike("[EFIJLOPQXZ]")
    return F.when(u.contains("U"), "rna").when(protein, "protein").when(u.rlike("^[" + T.ALPHABETS["AMBIGUOUS_DNA"] + "]*$"), "dna").otherwise("protein")


def gc_content(s: Column) -> Column:
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(count_of(s, "GC") * 100.0 / F.length(s))


def entropy(s: Column, letters: str = "ACGT") -> Column:
    """Shannon entropy, in bits, of the letters' shares among themselves; null without any."""
    counts = F.array(*(count_of(s, b).cast("double") for b in letters))

    def of(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, -F.aggregate(F.filter(n, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x / total * F.log2(x / total)))

    return let(counts, of)


def melting_temperature(s: Column) -> Column:
    short = 2.0 * count_of(s, "AT") + 4.0 * count_of(s, "GC")
    return F.when(F.length(s) < 14, short).otherwise(64.9 + 41.0 * (count_of(s, "GC") - 16.4) / F.length(s))


def complement(s: Column, rna: bool = False) -> Column:
    return F.translate(s, *(T.RNA_COMPLEMENT if rna else T.DNA_COMPLEMENT))


def reverse_complement(s: Column, rna: bool = False) -> Column:
    return F.reverse(complement(s, rna))


def transcribe(s: Column) -> Column:
    return F.replace(s, F.lit("T"), F.lit("U"))


def back_transcribe(s: Column) -> Column:
    return F.replace(s, F.lit("U"), F.lit("T"))


def starts(s: Column, width: int, step: int = 1) -> Column:
    """0-based starts of all full windows."""
    last = F.length(s) - width
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def at(s: Column, start: Column, width: int | Column) -> Column:
    return F.substring(s, start + 1, F.lit(width) if isinstance(width, int) else width)


def windows(s: Column, width: int, step: int = 1) -> Column:
    """All full windows, step <= width: one pass of the pattern matcher, where substrings would walk from the start each time."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{width}}})).{{{step}}}"), F.lit(1))


def find_motif(s: Column, motif: str) -> Column:
    """0-based starts of all hits, overlapping ones too: the text is split before each hit."""
    m = motif.upper()
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits"))
    add = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when((acc["at"] > 0) | s.startswith(m), F.concat(acc["hits"], F.array(acc["at"]))).otherwise(acc["hits"]).alias("hits"))
    return F.aggregate(F.split(s, f"(?={m})"), none, add, lambda acc: acc["hits"])


def orfs(s: Column, least: int = 100) -> Column:
    """Structs of frame (1 to 3), start, end (after the stop) and protein: every ATG up to the first stop in its frame, nested ones too."""

    def in_frame(f: int) -> Column:
        def of(c: Column) -> Column:
            places = F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)))
            stops = F.filter(places, lambda i: F.coalesce(F.get(c, i).isin("TAA", "TAG", "TGA"), F.lit(False)))

            def found(ends: Column) -> Column:
                first = lambda i: F.get(F.filter(ends, lambda e: e > i), F.lit(0))
                begins = F.filter(places, lambda i: F.coalesce(F.get(c, i) == "ATG", F.lit(False)))
                spans = F.filter(F.transform(begins, lambda i: F.struct(i.alias("i"), first(i).alias("e"))), lambda x: x["e"].isNotNull() & ((x["e"] + 1 - x["i"]) * 3 >= least))
                return F.transform(spans, lambda x: F.struct(F.lit(f + 1).alias("frame"), (x["i"] * 3 + f).cast("long").alias("start"), (x["e"] * 3 + 3 + f).cast("long").alias("end"), translate(F.array_join(F.slice(c, x["i"] + 1, x["e"] - x["i"]), "")).alias("protein")))

            return let(stops, found)

        return let(codons(s, f), of)

    return F.concat(*(in_frame(f) for f in range(3)))


def is_start(codon: Column) -> Column:
    return codon == "ATG"


def is_stop(codon: Column, code: int = 1) -> Column:
    return codon.isin([k for k, x in T.codon_table(code).items() if x == "*"])


def translate_rna(s: Column, code: int = 1) -> Column:
    return translate(back_transcribe(s), code)


def checked_translation(s: Column, code: int = 1) -> Column:
    """translate(), but an error for a codon that the code does not have."""
    known = F.forall(codons(s), lambda c: c.isin(list(T.codon_table(code))))
    return F.when(s.isNull(), F.lit(None)).when(known, translate(s, code)).otherwise(F.raise_error(F.concat(F.lit("unknown codon in "), F.substring(s, 1, 60))))


def codons(s: Column, frame: int = 0) -> Column:
    return F.regexp_extract_all(F.substring(s, frame + 1, 1 << 30) if frame else s, F.lit("(.{3})"), F.lit(1))


def translate(s: Column, code: int = 1, frame: int = 0) -> Column:
    """Amino acids up to the first stop; an unknown codon is X."""
    table = literal_map(T.codon_table(code))
    acids = F.transform(codons(s, frame), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X")))
    return F.split_part(F.array_join(acids, ""), F.lit("*"), F.lit(1))


def translate_from_start(s: Column, code: int = 1) -> Column:
    """From the first ATG; null without one."""
    i = F.instr(s, "ATG")
    return F.when(i > 0, translate(F.substring(s, F.greatest(i, F.lit(1)), F.lit(1 << 30)), code))


FRAMES = ("+1", "+2", "+3", "-1", "-2", "-3")


def _six(seqs: pd.Series, acids: np.ndarray, pairs: bytes) -> pd.Series:
    """Per sequence the proteins of FRAMES, by looking codons up as numbers; a codon with another letter is X."""
    digit = np.full(256, 1 << 12, np.int64)
    digit[[ord(x) for x in T.BASES]] = np.arange(4)
    table = np.concatenate([acids, np.full(1, ord("X"), np.uint8)])
    out = []
    for x in seqs:
        if x is None:
            out.append(None)
            continue
        plus = (x.encode() if x.isascii() else "".join(c if c.isascii() else "?" for c in x).encode())
        each = []
        for strand in (plus, plus.translate(pairs)[::-1]):
            d = digit[np.frombuffer(strand, np.uint8)]
            for f in range(3):
                n = max(0, (len(d) - f) // 3)
                codon = d[f : f + 3 * n].reshape(-1, 3) @ np.array([16, 4, 1])
                each.append(table[np.minimum(codon, 64)].tobytes().partition(b"*")[0].decode())
        out.append([{"frame": f, "protein": p} for f, p in zip(FRAMES, each)])
    return pd.Series(out)


def six_frames(s: Column, code: int = 1) -> Column:
    """Structs of frame (+1 to -3) and protein, in batches of arrays: six passes of expressions over each text cost ten times as much."""
    acids = np.frombuffer(T.CODES[code].encode(), np.uint8)
    pairs = bytes.maketrans(*(x.encode() for x in T.DNA_COMPLEMENT))
    return F.pandas_udf(lambda x: _six(x, acids, pairs), "array<struct<frame:string,protein:string>>", F.PandasUDFType.SCALAR)(s)


def kmers(s: Column, k: int) -> Column:
    return windows(s, k)


def gc_skew(s: Column, window: int = 100, step: int = 10) -> Column:
    """Structs of pos and skew for all full windows."""

    def one(w: Column, i: Column) -> Column:
        g, c = count_of(w, "G"), count_of(w, "C")
        return F.struct((i * step).cast("long").alias("pos"), F.when(g + c == 0, F.lit(0.0)).otherwise((g - c) / F.greatest(g + c, F.lit(1))).alias("skew"))

    return F.transform(windows(s, window, step), one)


def bubble_stability(s: Column, window: int = 10) -> Column:
    """AT fraction of all windows, with their starts."""
    return F.transform(windows(s, window), lambda w, i: F.struct(i.cast("long").alias("pos"), (count_of(w, "AT") / float(window)).alias("at")))


def _complexity(seqs: pd.Series, most: int) -> pd.Series:
    out = []
    for x in seqs:
        code = np.frombuffer((x or "").encode(), np.uint8).astype(np.int64)
        n, seen, could, window = len(code), 0, 0, np.zeros(len(code), np.int64)
        for k in range(1, most + 1):
            if n >= k:  # a k-mer is a number of k bytes; 8 of them fill 64 bits
                window = window[: n - k + 1] * 256 + code[k - 1 :]
                seen += len(np.unique(window))
                could += min(4**k, n - k + 1)
        out.append(seen / could if could else 0.0)
    return pd.Series(out)


def linguistic_complexity(s: Column, most: int = 8) -> Column:
    """Distinct k-mers over possible ones, k = 1 to most (8 at most). Counting distinct windows is what arrays of strings are slow at."""
    return F.pandas_udf(lambda x: _complexity(x, most), "double", F.PandasUDFType.SCALAR)(s)


def _cuts(s: Column, enzyme: str) -> Column:
    site, cut = T.ENZYMES[enzyme]
    return F.transform(find_motif(s, site), lambda i: F.struct(F.lit(enzyme).alias("enzyme"), i.cast("long").alias("pos"), (i + cut).cast("long").alias("cut")))


def digest(s: Column) -> Column:
    """Structs of enzyme, pos and cut for all enzymes' sites."""
    return F.concat(*(F.when(s.contains(T.ENZYMES[e][0]), _cuts(s, e)).otherwise(F.array().cast("array<struct<enzyme:string,pos:bigint,cut:bigint>>")) for e in T.ENZYMES))


def virtual_digest(s: Column, enzymes: list[str]) -> Column:
    """Fragments between the sorted cuts of the named enzymes."""
    cuts = F.concat(*(F.transform(_cuts(s, e), lambda x: x["cut"].cast("int")) for e in enzymes))
    ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(F.length(s)))))
    return let(ends, lambda e: F.transform(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), lambda a, i: at(s, a, F.element_at(e, i + 2) - a)))


def expand_ambiguous(s: Column) -> Column:
    """All plain sequences that an ambiguous one stands for."""
    table = F.create_map(*(x for k, v in T.IUPAC.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    letters = F.filter(F.split(F.upper(s), ""), lambda c: c != "")
    return F.aggregate(letters, F.array(F.lit("")), lambda acc, c: F.flatten(F.transform(acc, lambda p: F.transform(F.coalesce(F.try_element_at(table, c), F.array(c)), lambda b: F.concat(p, b)))))


def ambiguity_code(bases: Column) -> Column:
    """The code of a set of bases; one base is itself, unknown sets are N."""
    code = literal_map({"".join(sorted(v)): k for k, v in T.IUPAC.items()})
    key = F.array_join(F.array_sort(F.array_distinct(F.transform(bases, F.upper))), "")
    return F.when(F.length(key) == 1, key).otherwise(F.coalesce(F.try_element_at(code, key), F.lit("N")))


def hamming(a: Column, b: Column) -> Column:
    """Places where two sequences differ, up to the shorter one's end."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))).otherwise(F.lit(0))


def hybridize(a: Column, b: Column, salt: float = 0.05, strand: float = 250e-9) -> Column:
    """Struct of enthalpy dh, entropy ds, free energy dg37, tm and mismatches of two strands."""
    h, st = literal_map(T.STACK_H), literal_map(T.STACK_S)
    rc = reverse_complement(b)
    n = F.least(F.length(a), F.length(rc))
    steps = F.when(n > 1, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(steps, lambda i: at(a, i, 2))
    strong = F.substring(a, 1, 1).isin("G", "C")
    dh = F.aggregate(pairs, F.lit(0.0), lambda x, p: x + F.coalesce(F.try_element_at(h, p), F.lit(-8.0))) + 2 * F.when(strong, 0.1).otherwise(2.3)
    ds = F.aggregate(pairs, F.lit(0.0), lambda x, p: x + F.coalesce(F.try_element_at(st, p), F.lit(-21.0))) + 2 * F.when(strong, -2.8).otherwise(4.1) + 0.368 * (n - 1) * F.log(F.lit(salt))
    wrong = F.size(F.filter(steps, lambda i: at(a, i, 1) != at(rc, i, 1)))
    ct = F.when(wrong == 0, F.lit(strand)).otherwise(F.lit(strand / 4))
    return F.struct(dh.alias("dh"), ds.alias("ds"), (dh - 310.15 * ds / 1000).alias("dg37"), (dh * 1000 / (ds + 1.987 * F.log(ct)) - 273.15).alias("tm"), wrong.cast("long").alias("mismatches"))


def binding_affinity(a: Column, b: Column, circular: bool = False) -> Column:
    """Free energy of two strands; a circular topology is worth -3.5 kcal/mol."""
    return hybridize(a, b)["dg37"] + (-3.5 if circular else 0.0)


def fret_efficiency(distance: Column, radius: Column) -> Column:
    return 1.0 / (1.0 + F.pow(distance / radius, F.lit(6.0)))


def mirna_sites(mirna: Column, mrna: Column, least: int = 6) -> Column:
    """Structs of pos, matches and site where the complement of the seed (bases 2 to 8) matches at least `least` bases."""
    seed = F.translate(F.translate(F.substring(mirna, 2, 7), "T", "U"), *T.RNA_COMPLEMENT)
    target = transcribe(mrna)

    def one(w: Column, i: Column) -> Column:
        hits = F.size(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda j: at(seed, j, 1) == at(w, j, 1)))
        kind = F.when((hits == 7) & w.startswith("A"), "7mer-A1").when(hits == 7, "7mer-m8").otherwise("6mer")
        return F.struct(i.cast("long").alias("pos"), hits.cast("long").alias("matches"), kind.alias("site"))

    return F.when(F.length(seed) == 7, F.filter(F.transform(windows(target, 8), one), lambda x: x["matches"] >= least))


def in_centromere(chrom: Column, pos: Column) -> Column:
    lo, hi = literal_map({k: v[1] for k, v in T.CHROMOSOMES.items()}), literal_map({k: v[2] for k, v in T.CHROMOSOMES.items()})
    return F.coalesce(pos.between(F.try_element_at(lo, chrom), F.try_element_at(hi, chrom)), F.lit(False))


def chromosome_position(chrom: Column, pos: Column) -> Column:
    """telomeric, centromeric, short arm (p) or long arm (q); unknown chromosomes count as long arm."""
    size, lo = literal_map({k: v[0] for k, v in T.CHROMOSOMES.items()}), literal_map({k: v[1] for k, v in T.CHROMOSOMES.items()})
    n = F.try_element_at(size, chrom)
    telomere = n.isNotNull() & ((pos <= T.TELOMERE) | (pos >= n - T.TELOMERE))
    return F.when(telomere, "telomeric").when(in_centromere(chrom, pos), "centromeric").when(pos < F.try_element_at(lo, chrom), "short arm (p)").otherwise("long arm (q)")


def normalise_chromosome(raw: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(raw, "[^0-9]", ""), "^0+", "")
    return F.when(digits == "", raw).otherwise(F.concat(F.lit("chr"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)))


def base_report(s: Column) -> Column:
    """Structs of base, count, percent and the percent that the GC content alone would give."""
    gc = gc_content(s)
    share = lambda b: F.coalesce(F.try_divide(count_of(s, b) * 100.0, F.length(s)), F.lit(0.0))
    return F.array(*(F.struct(F.lit(b).alias("base"), count_of(s, b).alias("n"), share(b).alias("percent"), (gc / 2 if b in "GC" else (100 - gc) / 2).alias("expected")) for b in "ATGC"))


def traffic_lights(s: Column) -> Column:
    """Struct of bands: GC content from 40 to 60 percent and a melting temperature from 50 to 75 degrees are fine."""
    gc, tm = gc_content(s), melting_temperature(s)
    return F.struct(F.when(gc < 40, "low").when(gc > 60, "high").otherwise("fine").alias("gc"), F.when(tm < 50, "low").when(tm > 75, "high").otherwise("fine").alias("tm"))


def mean_skew(s: Column) -> Column:
    """Mean GC skew over windows of min(50, n / 4 + 1) bases at steps of min(10, n / 10 + 1); 0 for short sequences."""

    def of(z: Column) -> Column:
        text, n = z["s"], z["n"]
        w, step = F.floor(n / 4).cast("int") + 1, F.floor(n / 10).cast("int") + 1
        places = F.when((n < 196) & (n >= w), F.sequence(F.lit(0), F.greatest(n - w, F.lit(0)), F.least(F.lit(10), step))).otherwise(F.array().cast("array<int>"))

        def one(part: Column) -> Column:
            g, c = count_of(part, "G"), count_of(part, "C")
            return F.when(g + c == 0, F.lit(0.0)).otherwise((g - c) / F.greatest(g + c, F.lit(1)))

        # From 196 bases on the window is 50 and the step 10: one pass of the pattern matcher.
        few = F.transform(places, lambda i: F.substring(text, i + 1, F.least(F.lit(50), w)))
        parts = F.when(n >= 196, windows(text, 50, 10)).otherwise(few)
        return let(F.transform(parts, one), lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x)).otherwise(F.lit(0.0)))

    return let(F.struct(s.alias("s"), F.length(s).alias("n")), of)


def gene_ids(text: Column) -> Column:
    """Struct of the two kinds of rice gene ids found in a text."""
    return F.struct(F.regexp_extract(text, r"(?i)(Os\d{2}g\d{7})", 1).alias("rap"), F.regexp_extract(text, r"(?i)(LOC_Os\d{2}g\d{5})", 1).alias("msu"))


def crispr_efficiency(guide: Column, target: Column) -> Column:
    """Score 0 to 1 of a guide's last 20 bases against a target that ends with its PAM; 0 for a short guide or another PAM."""
    g = F.right(F.replace(F.upper(guide), F.lit("U"), F.lit("T")), F.lit(20))
    gc = count_of(g, "GC") * 5.0
    bonus = {1: 0.1, 2: 0.1, 18: 0.15, 19: 0.2, 20: 0.2}
    weight = sum((F.when(F.substring(g, p, 1) == "G", b).otherwise(0.0) for p, b in bonus.items()), F.lit(1.0))
    protospacer = F.right(F.substring(target, F.lit(1), F.greatest(F.length(target) - 3, F.lit(0))), F.lit(12))
    raw = F.when(gc.between(40.0, 70.0), 1.0).otherwise(0.5) * weight - 0.2 * hamming(F.right(g, F.lit(12)), protospacer)
    return F.when((F.length(guide) < 20) | ~target.endswith("GG"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
