"""Arithmetic that stays defined on degenerate groups."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column | float, b: Column | float) -> Column:
    """a / b as a double; NULL where b is zero, so that one group without variance, spread or a second level
    gives NULL statistics and does not stop a scan."""
    col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.try_divide(col(a), col(b))


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL without spread in x or y."""
    both = x.isNotNull() & y.isNotNull()
    r = ratio(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)  # rounding


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x over the rows that have both; NULL without spread in x."""
    both = y.isNotNull() & x.isNotNull()
    return ratio(F.covar_pop(y, x), F.var_pop(F.when(both, x)))


def digest(*key: Column | str, seed: int = 42) -> Column:
    """MD5 of `key|...|seed` in hex; its order is that of `draw`, ties of the first 13 digits aside."""
    return F.md5(F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key], F.lit(str(seed))))


def draw(*key: Column | str, seed: int = 42) -> Column:
    """Seeded hash number of a key, the same in any engine that has MD5: its first 13 hex digits of `key|...|seed`."""
    return F.conv(F.substring(digest(*key, seed=seed), 1, 13), 16, 10).cast("bigint")
