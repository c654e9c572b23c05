"""Explicit schemas of the input tables (long form, 1-based inclusive positions)."""
from __future__ import annotations

from pyspark.sql import DataFrame

GENOMES = "id string, file_basename string, organism string, taxonomy string, year int, sequencing_tech string"
SEQUENCES = "id string, gene string, taxonomy string, seq string"
FEATURES = ("genome_id string, genome_size int, feature_type string, gene string, part_no int, "
            "start int, end int, strand int, translation string")
OCCURRENCES = ("gbif_id string, dataset_key string, species string, scientific_name string, "
               "decimal_latitude float, decimal_longitude float, year smallint, month tinyint, day tinyint, country_code string")
GRID = "layer string, row int, col int, value double"
SITES = "gene string, pos int, id string, allele string"
EDGES = "parent bigint, child bigint, length double"
NODE_STATES = "node bigint, pos int, aa string, prob double"
ATOMS = "chain string, resno int, resid string, atom string, x double, y double, z double"
COUPLINGS = "i int, j int, score double"


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Fail early, with the missing names, when a contract column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
