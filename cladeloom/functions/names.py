"""Names, identifiers, dates and lineage labels as column expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Sequencing platform patterns in priority order (matched on lower-cased text).
TECHNOLOGY_PATTERNS = [
    ("Illumina", r"\billumina\b|\bmiseq\b|\bnextseq\b|\bhisep\b|\bnovaseq\b"),
    ("PacBio", r"\bpacbio\b|\bpacific\s+biosciences\b|\bsequel\b|\brs ii\b"),
    ("Oxford Nanopore", r"\bnanopore\b|\boxford\s+nanopore\b|\bminion\b|\bpromethion\b"),
    ("Sanger", r"\bsanger\b|\bcapillary\b"),
    ("454/Roche", r"\b454\b|\broche\b"),
    ("Ion Torrent", r"\bion[\s_-]?torrent\b|\bpgm\b"),
    ("SOLiD", r"\bsolid\b"),
]

# Platform preference, best first.
TECHNOLOGY_RANK = ["PacBio", "Oxford Nanopore", "Illumina", "454/Roche", "Sanger", "Ion Torrent"]

# Rank markers that are not part of a species name.
RANK_MARKERS = ["x", "sp", "var", "subsp", "f", "spp", "cf", "aff", "ex"]


def match_cascade(text: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """First matching pattern wins."""
    low = F.lower(text)
    out: Column = F.lit(default)
    for label, pattern in reversed(list(patterns)):
        out = F.when(low.rlike(pattern), label).otherwise(out)
    return out


def detect_technology(comment: Column) -> Column:
    return match_cascade(comment, TECHNOLOGY_PATTERNS, "Unknown")


def year_from_date(text: Column) -> Column:
    """Year of a `dd-MMM-yyyy` date; NULL when it does not parse."""
    return F.year(F.try_to_timestamp(text, F.lit("dd-MMM-yyyy"))).cast("bigint")


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def species_name(name: Column) -> Column:
    """First two words once rank markers (dots stripped, case-insensitive) are removed."""
    words = F.filter(F.split(F.trim(name), r"\s+"),
                     lambda w: (w != "") & ~F.btrim(F.lower(w), F.lit(".")).isin(RANK_MARKERS))
    return F.concat_ws(" ", F.slice(words, 1, 2))


def universal_id(id_: Column, name: Column) -> Column:
    return F.concat(alnum_key(id_), alnum_key(species_name(name)))


def order_from_taxonomy(taxonomy: Column, sep: str = ";", suffix: str = "ales") -> Column:
    """First trimmed lineage level with the order suffix; NULL when there is none."""
    levels = F.transform(F.split(taxonomy, sep), lambda x: F.trim(x))
    return F.get(F.filter(levels, lambda x: x.endswith(suffix)), F.lit(0))


def lineage_group(taxonomy: Column, fixation: Column | None = None) -> Column:
    """Plot group by family / order, with nitrogen fixers (label "Yes") first."""
    t = F.coalesce(taxonomy, F.lit(""))
    base = (F.when(t.contains("Poaceae"), "Poaceae").when(t.contains("Fabaceae"), "Fabaceae")
            .when(t.contains("Fabales"), "Fabales_not_Fabaceae").otherwise("Other"))
    if fixation is None:
        return base
    return (F.when((fixation == "Yes") & t.contains("Fabaceae"), "N-fixer_Fabaceae")
            .when(fixation == "Yes", "N-fixer_nonFabaceae").otherwise(base))


def accession_from_filename(name: Column, suffix: str = "") -> Column:
    """Strip a file suffix and put a dot before the last character (version digit)."""
    stem = F.regexp_replace(name, suffix + "$", "") if suffix else name
    return F.regexp_replace(stem, "^(.*)(.)$", "$1.$2")


def genus(name: Column) -> Column:
    return F.substring_index(F.trim(name), " ", 1)


def prefix_category(name: Column, prefixes: Sequence[str], default: str = "other") -> Column:
    out: Column = F.lit(default)
    for p in reversed(list(prefixes)):
        out = F.when(name.startswith(p), p).otherwise(out)
    return out


def technology_rank(tech: Column) -> Column:
    """Preference number of a platform; unknown platforms come last."""
    out: Column = F.lit(len(TECHNOLOGY_RANK))
    for i, t in enumerate(TECHNOLOGY_RANK):
        out = F.when(tech == t, i).otherwise(out)
    return out
