"""Dense-vector arithmetic on array columns, without UDFs."""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def fold_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return fold_sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(fold_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sum_vector(v: Column) -> Column:
    """Aggregate: element-wise sum, combined map-side; sums of counts stay whole numbers.

    `Summarizer.sum` is a running mean times a count, which turns 603 into 602.99...; its 1-norm is added up
    directly, so the positive and the negative parts are summed apart.
    """
    up = F.transform(v, lambda x: F.when(x <= 0, 0.0).otherwise(x))
    down = F.transform(v, lambda x: F.when(x >= 0, 0.0).otherwise(-x))
    norm = lambda a: vector_to_array(Summarizer.normL1(array_to_vector(a)))
    return subtract(norm(up), norm(down))


def mean_vector(v: Column) -> Column:
    """Aggregate: element-wise mean, combined map-side."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))
