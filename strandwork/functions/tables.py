"""Lookup tables of the life-science functions, in natural order."""

from __future__ import annotations

# Genetic codes as the 64 amino acids of the codons TTT, TTC, TTA, TTG, TCT, ... GGG (base order TCAG).
BASES = "TCAG"
CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}


def codon_table(code: int = 1) -> dict[str, str]:
    codons = (a + b + c for a in BASES for b in BASES for c in BASES)
    return dict(zip(codons, CODES[code]))


# Alphabets and complements.
ALPHABETS = {"DNA": "ATGC", "RNA": "AUGC", "PROTEIN": "ACDEFGHIKLMNPQRSTVWY*", "AMBIGUOUS_DNA": "ATGCNRYSWKMBDHV", "AMBIGUOUS_RNA": "AUGCNRYSWKMBDHV"}
DNA_COMPLEMENT = ("ATGCNRYSWKMBDHV", "TACGNYRSWMKVHDB")
RNA_COMPLEMENT = ("AUGC", "UACG")
IUPAC = {"R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ATGC"}

# Restriction enzymes, recognition site and cut offset.
ENZYMES = {
    "EcoRI": ("GAATTC", 1), "HindIII": ("AAGCTT", 1), "BamHI": ("GGATCC", 1), "XhoI": ("CTCGAG", 1), "NotI": ("GCGGCCGC", 2), "SalI": ("GTCGAC", 1),
    "SmaI": ("CCCGGG", 3), "MluI": ("ACGCGT", 1), "NcoI": ("CCATGG", 1), "NdeI": ("CATATG", 2), "XbaI": ("TCTAGA", 1), "BglII": ("AGATCT", 1),
    "KpnI": ("GGTACC", 5), "SacI": ("GAGCTC", 5), "MfeI": ("CAATTG", 1), "PacI": ("TTAATTAA", 3), "SphI": ("GCATGC", 5), "SpeI": ("ACTAGT", 1),
    "StuI": ("AGGCCT", 3), "NsiI": ("ATGCAT", 5), "AscI": ("GGCGCGCC", 2), "SwaI": ("TTTTAAAA", 4), "MssI": ("TAATTAA", 3),
}

# Amino-acid properties.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
MASS = {"A": 89.09, "R": 174.20, "N": 132.12, "D": 133.10, "C": 121.16, "E": 147.13, "Q": 146.15, "G": 75.03, "H": 155.16, "I": 131.17, "L": 131.17, "K": 146.19, "M": 149.21, "F": 165.19, "P": 115.13, "S": 105.09, "T": 119.12, "W": 204.23, "Y": 181.19, "V": 117.15}
WATER = 18.02
PKA = {"D": 3.9, "E": 4.1, "H": 6.0, "C": 8.3, "Y": 10.1, "K": 10.5, "R": 12.5}
PKA_N_TERM, PKA_C_TERM = 8.0, 3.1
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
BOMAN = {"L": -4.92, "I": -4.44, "V": -4.04, "F": -2.98, "M": -2.35, "W": -2.33, "A": -1.81, "C": -1.28, "G": -0.94, "Y": 0.14, "T": 2.57, "S": 3.40, "H": 4.66, "Q": 5.54, "K": 5.55, "N": 6.64, "E": 6.81, "D": 8.72, "R": 14.92, "P": 0.0}
INSTABILITY = {"WW": 1.0, "WC": 1.0, "WE": 1.0, "WT": -0.7, "AA": 1.0, "AC": 44.94, "AE": 0.0, "AD": -7.49, "AF": -14.03, "AG": 1.0, "AH": -7.49, "AI": -7.49, "AK": -7.49, "AL": -7.49, "AM": 1.0, "AN": 23.44, "AP": 20.26, "AQ": 0.0, "AR": 0.0, "AS": 1.0}
INTERFACE = {"A": 0.87, "C": 1.23, "D": 0.96, "E": 1.05, "F": 1.16, "G": 0.88, "H": 1.29, "I": 1.00, "K": 1.06, "L": 0.98, "M": 1.33, "N": 1.08, "P": 0.65, "Q": 1.10, "R": 1.29, "S": 0.96, "T": 0.94, "V": 0.88, "W": 1.37, "Y": 1.35}
COILED_COIL = {"A": 1.44, "E": 1.44, "I": 1.40, "L": 1.40, "M": 1.36, "Q": 1.33, "R": 1.37, "S": 0.99, "T": 0.87, "V": 1.31, "K": 1.23, "N": 1.00, "H": 1.05, "D": 0.98, "F": 1.19, "W": 1.08, "C": 1.04, "Y": 0.87, "G": 0.52, "P": 0.0}
HYDROPHOBIC = "AVILMFWP"
AROMATIC = "FHWY"
HYDROPHOBICITY = {"A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06, "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26}
# Hydrophilicity, side-chain mass, residue mass and acid constant of the residues.
HYDROPHILICITY = {"A": -0.5, "C": -1.0, "D": 3.0, "E": 3.0, "F": -2.5, "G": 0.0, "H": -0.5, "I": -1.8, "K": 3.0, "L": -1.8, "M": -1.3, "N": 0.2, "P": 0.0, "Q": 0.2, "R": 3.0, "S": 0.3, "T": -0.4, "V": -1.5, "W": -3.4, "Y": -2.3}
SIDE_MASS = {"A": 15.0, "C": 47.0, "D": 59.0, "E": 73.0, "F": 91.0, "G": 1.0, "H": 82.0, "I": 57.0, "K": 73.0, "L": 57.0, "M": 75.0, "N": 58.0, "P": 42.0, "Q": 72.0, "R": 100.0, "S": 31.0, "T": 45.0, "V": 43.0, "W": 130.0, "Y": 107.0}
RESIDUE_MASS = {"A": 71.03, "C": 103.01, "D": 115.03, "E": 129.04, "F": 147.07, "G": 57.02, "H": 137.06, "I": 113.08, "K": 128.09, "L": 113.08, "M": 131.04, "N": 114.04, "P": 97.05, "Q": 128.06, "R": 156.10, "S": 87.03, "T": 101.05, "V": 99.07, "W": 186.08, "Y": 163.06}
PK1 = {"A": 2.34, "C": 1.96, "D": 1.88, "E": 2.19, "F": 1.83, "G": 2.34, "H": 1.82, "I": 2.36, "K": 2.18, "L": 2.36, "M": 2.28, "N": 2.02, "P": 1.99, "Q": 2.17, "R": 2.17, "S": 2.21, "T": 2.09, "V": 2.32, "W": 2.83, "Y": 2.20}
# Places of the residues on the scale of sequence order; the distance of two residues is that of their places.
ORDER_PLACE = {"A": 0.11, "C": 0.0, "D": 0.94, "E": 0.90, "F": 0.0, "G": 0.67, "H": 0.90, "I": 0.69, "K": 0.94, "L": 0.0, "M": 0.0, "N": 0.94, "P": 0.60, "Q": 0.90, "R": 0.90, "S": 0.29, "T": 0.22, "V": 0.0, "W": 0.90, "Y": 0.22}
# Helix propensity (0.9 for others) and the residues that count towards sheets.
HELIX = {"A": 1.44, "E": 1.44, "L": 1.40, "M": 1.36, "Q": 1.33, "K": 1.23, "R": 1.37, "H": 1.05, "V": 1.31, "I": 1.40, "F": 1.19, "W": 1.08, "C": 1.04, "T": 0.87, "Y": 0.87, "S": 0.99}
SHEET_RESIDUES = "AVILMFWP"
# Property classes 1, 2, 3 of the composition, transition and distribution descriptors.
CTD = {
    "hydrophobicity": ("ACFILMVW", "DEGKNPQRST", "HY"),
    "vdwVolume": ("AGS", "CDNPTV", "EFHIKLMQRWY"),
    "polarity": ("AFGILMV", "CHPSTWY", "DEKNQR"),
    "secStructure": ("AEKLMQR", "CFHITVWY", "DGNPS"),
    "charge": ("DE", "ACFGILMNPQSTVWY", "HKR"),
}

# Nearest-neighbour enthalpy and entropy of DNA dinucleotides.
STACK_H = {"AA": -7.9, "AT": -7.2, "TA": -7.2, "CA": -8.5, "GT": -8.4, "CT": -7.8, "GA": -8.2, "CG": -10.6, "GC": -9.8, "GG": -8.0, "TT": -7.9, "TG": -8.5, "AG": -7.8, "TC": -8.2, "AC": -8.4, "CC": -8.0}
STACK_S = {"AA": -22.2, "AT": -20.4, "TA": -21.3, "CA": -22.7, "GT": -22.4, "CT": -21.0, "GA": -22.2, "CG": -27.2, "GC": -24.4, "GG": -19.9, "TT": -22.2, "TG": -22.7, "AG": -21.0, "TC": -22.2, "AC": -22.4, "CC": -19.9}

# Cis-regulatory motifs, alternatives separated by a bar.
CIS_MOTIFS = {
    "ABRE": "ACGTGG|ACGTGT|CACGTG|TACGTC", "ABRE-like": "ACGTG", "DRE/CRT": "TACCGACAT|RCCGAC", "MYCBS": "CATGTG", "MYBBS": "TAACTG", "G-box": "CACGTG",
    "I-box": "GATAAG|GATAAN", "GT-1": "GRWAAW", "GATA-motif": "TATCTA", "W-box": "TTGACY|TTGACT|TTGACC", "GCC-box": "AGCCGCC", "as-1/TCA": "TGACG",
    "CGTCA": "CGTCA", "TGACG": "TGACG", "AuxRE": "TGASTC|TGACGC", "GARE": "TAACAAA|TAACAAR", "CARE": "TGACG", "P-box": "CCTTTTG",
    "RY-element": "CATGCAT|CATGCAC", "GCN4": "TGACTCAT|TGAGTCAT", "AACA": "AACAAAC", "CCAAT-box": "CCAAT", "TATA-box": "TATAAATA|TATAAAAT|TATAAAT",
    "Inr": "TCANTCT", "EE": "AAATATCT", "Morning-E": "AACCACGAAAC", "TC-rich": "ATTTTCTTCA", "HSE": "AGAANTTCT|AGAANNTTCNAGAA", "ARE": "AAACCA",
    "SURE": "TGATAATG", "PIRF": "CACGCAACGC",
}

# Least repeats of microsatellites per motif length, and their names.
SSR_LEAST = {1: 10, 2: 6, 3: 5, 4: 5, 5: 4, 6: 4}
SSR_NAMES = {1: "mono", 2: "di", 3: "tri", 4: "tetra", 5: "penta", 6: "hexa"}

# Chromosome lengths and centromeres of the rice reference genome.
CHROMOSOMES = {
    "chr01": (43270923, 16589552, 17151912), "chr02": (35937250, 10000000, 10500000), "chr03": (36413819, 11000000, 11500000), "chr04": (35502694, 2000000, 2800000),
    "chr05": (29958434, 9000000, 9500000), "chr06": (31248787, 10000000, 10600000), "chr07": (29697621, 7000000, 7500000), "chr08": (28443022, 8000000, 8500000),
    "chr09": (23012720, 6000000, 6500000), "chr10": (23207287, 8000000, 8500000), "chr11": (29021106, 9000000, 9500000), "chr12": (27531856, 8000000, 8500000),
}
TELOMERE = 100000

# Patterns of resistance-gene evidence.
RGENE_PATTERNS = {"p_loop": "G.{4}GK[ST]", "rnbs": "RNBS", "mhd": "MHDV|MHDD|CFLH", "zipper": "L.{6}L.{6}L.{6}L", "kinase": "DFG|HRDL|VAIK"}
RGENE_LRR, RGENE_TIR = "L.{1,2}L.{1,2}L.{1,2}L", "[FW]LR[ND][LI]"
