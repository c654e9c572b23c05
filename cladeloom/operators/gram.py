"""Cross-product matrices as a distributed sum: the sufficient statistic behind
correlations, least squares, ridge, principal components and RV coefficients.

Each task folds its Arrow batches into one small matrix per key, the matrices are
summed with map-side combine, and only a width x width result per key is solved.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cladeloom.functions import vectors as vx

FLUSH_KEYS = 2000


def gram(df: DataFrame, z: Column, by: Sequence[str] = ()) -> DataFrame:
    """by..., n, _gram: upper triangle (row-major) of the sum of z z^T, z prefixed by a constant 1."""
    types = dict(df.dtypes)
    by_list = list(by)

    def fold(batches):
        acc: dict[tuple, list] = {}

        def flush():
            if not acc:
                return None
            rows = [(*k, n, m[np.triu_indices(len(m))]) for k, (n, m) in acc.items()]
            acc.clear()
            return pd.DataFrame(rows, columns=[*by_list, "n", "_gram"])

        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = pdf["_z"].to_numpy()
            if by_list:
                groups = pdf.groupby(by_list, dropna=False, sort=False).indices.items()
            else:
                groups = [((), np.arange(len(pdf)))]
            for key, idx in groups:
                k = key if isinstance(key, tuple) else (key,)
                part = np.vstack(z[idx]).astype(float)
                part = np.hstack([np.ones((len(part), 1)), part])
                n, m = acc.get(k, (0, 0.0))
                acc[k] = (n + len(idx), m + part.T @ part)
            if len(acc) > FLUSH_KEYS:
                yield flush()
        out = flush()
        if out is not None:
            yield out

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "n bigint", "_gram array<double>"])
    parts = df.select(*by, z.alias("_z")).where(F.col("_z").isNotNull()).mapInPandas(fold, schema)
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        vx.sum_vector(F.col("_gram")).alias("_gram"),
    )


def gram_of_columns(df: DataFrame, cols: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """`gram` of a few columns as plain sums, without Python: for many small groups."""
    z = [F.lit(1.0), *cols]
    sums = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("_gram"))


def unpack(g) -> np.ndarray:
    """Full symmetric matrix from its packed upper triangle."""
    w = int((np.sqrt(8 * len(g) + 1) - 1) / 2)
    m = np.zeros((w, w))
    m[np.triu_indices(w)] = g
    return m + np.triu(m, 1).T


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, centred cross-products) from a matrix whose first column is the constant."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] - n * np.outer(mean, mean)
