"""Angles and guarded arithmetic."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def direction(dx: Column, dy: Column) -> Column:
    """Direction of a displacement, x first.

    By the C library, as in SQL engines: the JVM's last digit differs for a sixth of
    all displacements, which puts some at a bin's edge into another bin.
    """

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(list(map(math.atan2, x.tolist(), y.tolist())), dtype="float64")

    return F.when(dx.isNotNull() & dy.isNotNull(), of(dx.cast("double"), dy.cast("double")))


def direction_bin(angle: Column, bin_deg: float) -> Column:
    """Bin of an angle in [-pi, pi]; the last edge wraps to bin 0. Bins must divide the circle."""
    if 360 % bin_deg:
        raise ValueError("bins must divide the circle")
    n = int(360 / bin_deg)
    return F.pmod(F.floor((angle + math.pi) / math.radians(bin_deg)).cast("int"), F.lit(n))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two columns as an aggregate, from centred sums; null where a side has no variance."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
