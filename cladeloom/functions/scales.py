"""Fixed biochemical tables."""
from __future__ import annotations

# The twenty residues in alphabetical one-letter order.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Kyte-Doolittle hydropathy.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
              "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}

# Simplified side-chain charge at pH 7.
CHARGE = {"R": 1.0, "K": 1.0, "H": 0.5, "D": -1.0, "E": -1.0}

# Chou-Fasman helix propensity.
HELIX = {"A": 1.42, "R": 0.98, "N": 0.67, "D": 1.01, "C": 0.7, "Q": 1.11, "E": 1.51, "G": 0.57, "H": 1.0, "I": 1.08,
         "L": 1.21, "K": 1.16, "M": 1.45, "F": 1.13, "P": 0.57, "S": 0.77, "T": 0.83, "W": 1.08, "Y": 0.69, "V": 1.06}

# Average residue mass in dalton (a chain adds one water, 18.015).
RESIDUE_MASS = {"A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "Q": 128.1307, "E": 129.1155,
                "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766,
                "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326}

# Isoelectric points of the free amino acids.
ISOELECTRIC = {"A": 6.0, "R": 10.76, "N": 5.41, "D": 2.77, "C": 5.07, "Q": 5.65, "E": 3.22, "G": 5.97, "H": 7.59, "I": 6.02,
               "L": 5.98, "K": 9.74, "M": 5.74, "F": 5.48, "P": 6.3, "S": 5.68, "T": 5.6, "W": 5.89, "Y": 5.66, "V": 5.96}

# Residue classes.
RESIDUE_CLASSES = {"hydrophobic": "AVILMFWP", "polar": "STYNQC", "charged": "RKDEH", "tiny": "AGCS", "small": "AGCSTPNDV",
                   "aromatic": "FWY", "aliphatic": "ILV", "sulfur": "CM", "branched": "ILVT", "gc_rich": "GCAPR"}

# Nitrogen atoms per base and per residue.
NITROGEN_BASE = {"A": 5, "C": 3, "G": 5, "T": 2}
NITROGEN_RESIDUE = {"F": 1, "T": 1, "S": 1, "W": 2, "R": 4, "G": 1, "K": 2, "P": 1, "M": 1, "N": 2, "D": 1, "L": 1,
                    "C": 1, "Q": 2, "H": 3, "V": 1, "E": 1, "I": 1, "Y": 1, "A": 1}

# The ten Kidera factors per residue.
KIDERA = {
    "A": [-1.56, -1.67, -0.97, -0.27, -0.93, -0.78, -0.20, -0.08, 0.21, -0.48],
    "R": [0.22, 1.27, 1.37, 1.87, -1.70, 0.46, 0.92, -0.39, 0.23, 0.93],
    "N": [1.14, -0.07, -0.12, 0.81, 0.18, 0.37, -0.09, 1.23, 1.10, -1.73],
    "D": [0.58, -0.22, -1.58, 0.81, -0.92, 0.15, -1.52, 0.47, 0.76, 0.70],
    "C": [0.12, -0.89, 0.45, -1.05, -0.71, 2.41, 1.52, -0.69, 1.13, 1.10],
    "Q": [-0.47, 0.24, 0.07, 1.10, 1.10, 0.59, 0.84, -0.71, -0.03, -2.33],
    "E": [-1.45, 0.19, -1.61, 1.17, -1.31, 0.40, 0.04, 0.38, -0.35, -0.12],
    "G": [1.46, -1.96, -0.23, -0.16, 0.10, -0.11, 1.32, 2.36, -1.66, 0.46],
    "H": [-0.41, 0.52, -0.28, 0.28, 1.61, 1.01, -1.85, 0.47, 1.13, 1.63],
    "I": [-0.73, -0.16, 1.79, -0.77, -0.54, 0.03, -0.83, 0.51, 0.66, -1.78],
    "L": [-1.04, 0.00, -0.24, -1.10, -0.55, -2.05, 0.96, -0.76, 0.45, 0.93],
    "K": [-0.34, 0.82, -0.23, 1.70, 1.54, -1.62, 1.15, -0.08, -0.48, 0.60],
    "M": [-1.40, 0.18, -0.42, -0.73, 2.00, 1.52, 0.26, 0.11, -1.27, 0.27],
    "F": [-0.21, 0.98, -0.36, -1.43, 0.22, -0.81, 0.67, 1.10, 1.71, -0.44],
    "P": [2.06, -0.33, -1.15, -0.75, 0.88, -0.45, 0.30, -2.30, 0.74, -0.28],
    "S": [0.81, -1.08, 0.16, 0.42, -0.21, -0.43, -1.89, -1.15, -0.97, -0.23],
    "T": [0.26, -0.70, 1.21, 0.63, -0.10, 0.21, 0.24, -1.15, -0.56, 0.19],
    "W": [0.30, 2.10, -0.72, -1.57, -1.16, 0.57, -0.48, -0.40, -2.30, -0.60],
    "Y": [1.38, 1.48, 0.80, -0.56, -0.00, -0.68, -0.31, 1.03, -0.05, 0.53],
    "V": [-0.74, -0.71, 2.04, -0.40, 0.50, -0.81, -1.07, 0.06, -0.46, 0.65],
}

# Genetic code (bacterial / plastid), codons enumerated in TCAG order.
CODON_BASES = "TCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

# First two bases of codons whose third base is free, and accepted start codons.
FOURFOLD_PREFIXES = ["CT", "CC", "AC", "GC", "GG", "TC", "GT", "CG"]
START_CODONS = ["ATG", "GTG", "ACA"]

# Exchanges counted as conservative.
CONSERVATIVE_PAIRS = ["V-I", "I-V", "L-M", "M-L", "L-F", "F-L", "K-R", "R-K", "E-D", "D-E", "S-T", "T-S"]


def codon_table() -> dict[str, str]:
    codons = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]
    return dict(zip(codons, CODON_RESIDUES))
