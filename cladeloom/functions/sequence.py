"""Sequence measures as column expressions; nothing here explodes a sequence."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from cladeloom.functions import scales as sc


def count_chars(seq: Column, chars: str) -> Column:
    """Number of positions holding any of `chars`."""
    return reduce(lambda a, b: a + b, [F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit(""))) for c in chars])


def gc_fraction(seq: Column) -> Column:
    """(G+C)/length of the upper-cased sequence; 0 when empty."""
    return F.when(F.length(seq) == 0, 0.0).otherwise(count_chars(F.upper(seq), "GC") / F.length(seq))


def ambiguous_bases(seq: Column) -> Column:
    return count_chars(seq, "N").cast("bigint")


def pieces(seq: Column, k: int, step: int = 1) -> Column:
    """All length-k substrings at every `step`-th start, as an array; linear in the length."""
    if step == k:
        return F.regexp_extract_all(seq, F.lit(f"(?s).{{{k}}}"), F.lit(0))
    every = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return every if step == 1 else F.filter(every, lambda x, i: i % step == 0)


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTacgt", "TGCAtgca"))


def translate_codons(dna: Column) -> Column:
    """Residues of the in-frame codons; `?` for codons outside the table."""
    table = F.create_map(*[F.lit(x) for pair in sc.codon_table().items() for x in pair])
    return F.array_join(F.transform(pieces(dna, 3, 3), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("?"))), "")


def canonical_pieces(seq: Column, k: int) -> Column:
    """Overlapping k-mers, each as the smaller of itself and its reverse complement.

    The reverse complement is formed once per sequence: its k-mers, read backwards,
    are the complements of the forward ones.
    """
    return F.zip_with(pieces(seq, k), F.reverse(pieces(reverse_complement(seq), k)), lambda a, b: F.least(a, b))


def degap(seq: Column) -> Column:
    return F.translate(seq, "-.", "")


def fourfold_gc(cds: Column) -> Column:
    """GC share of third bases in codons with a free third base; needs a start codon."""
    up = F.upper(cds)
    free = F.filter(pieces(up, 3, 3), lambda c: F.substring(c, 1, 2).isin(sc.FOURFOLD_PREFIXES))
    gc = F.filter(free, lambda c: F.substring(c, 3, 1).isin("G", "C"))
    ok = (F.length(cds) >= 3) & F.substring(cds, 1, 3).isin(sc.START_CODONS) & (F.size(free) > 0)
    return F.when(ok, F.size(gc) / F.size(free))


def letter_counts(seq: Column, letters: str = sc.AMINO_ACIDS) -> dict[str, Column]:
    """One pass per letter; materialise these once and feed them to the measures below."""
    return {x: count_chars(seq, x).cast("bigint") for x in letters}


def _total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def weighted_sum(counts: Mapping[str, Column], scale: Mapping[str, float]) -> Column:
    """Sum over residues of a per-residue value."""
    return _total([counts[aa] * F.lit(float(w)) for aa, w in scale.items()])


def residue_mean(counts: Mapping[str, Column], scale: Mapping[str, float]) -> Column:
    """Mean of a per-residue value over residues the scale covers."""
    n = _total([counts[aa] for aa in scale])
    return F.when(n > 0, weighted_sum(counts, scale) / n)


def sequence_properties(counts: Mapping[str, Column], n: Column) -> dict[str, Column]:
    """Physico-chemical summary of a chain of length n from its residue counts."""
    out = {
        "hydropathy": residue_mean(counts, sc.HYDROPATHY),
        "net_charge": weighted_sum(counts, sc.CHARGE),
        "helix_propensity": residue_mean(counts, sc.HELIX),
        "molecular_weight": weighted_sum(counts, sc.RESIDUE_MASS) + 18.015,
        "aliphatic_index": 100 * (counts["A"] + 2.9 * counts["V"] + 3.9 * (counts["I"] + counts["L"])) / n,
    }
    out |= {f"prop_{k}": _total([counts[c] for c in chars]) / n for k, chars in sc.RESIDUE_CLASSES.items()}
    return {k: F.when(n > 0, c) for k, c in out.items()}


def kidera_vector(counts: Mapping[str, Column]) -> list[Column]:
    """Mean of each Kidera factor over the standard residues."""
    return [residue_mean(counts, {aa: f[i] for aa, f in sc.KIDERA.items()}) for i in range(10)]


def mismatches(a: Column, b: Column, gap: str = "-") -> Column:
    """Positions, over the shorter length, where both are ungapped and differ."""
    n = F.least(F.length(a), F.length(b))
    x, y = F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), "")
    diff = F.zip_with(x, y, lambda p, q: (p != q) & (p != gap) & (q != gap))
    return F.when(n == 0, F.lit(0)).otherwise(F.size(F.filter(diff, lambda d: d))).cast("bigint")


def element_usage(counts: Mapping[str, Column], atoms: Mapping[str, int]) -> Column:
    """Total atoms: sum of count x atoms, NULL counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) * F.lit(atoms[k]) for k, c in counts.items()])


def list_parse(text: Column) -> Column:
    """`['a', 'b']` written as text, back to an array."""
    body = F.regexp_replace(text, r"[\[\]'\" ]", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, ","))
