"""Shared conventions: missing values are NULL, angles wrap to [-pi, pi), frames are 1-based longs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels with a meaning of their own.
NON_ANT_LABELS = ("NoAnt", "FOOD", "Larva")
MULTI_LABELS = ("MultiAnt", "Multi", "multi")
AMBIGUOUS_LABELS = ("Unknown", "??")
TAG_COLOURS = ("B", "G", "O", "P")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN becomes NULL, because Spark holds NaN to be larger than all numbers and equal to itself."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def wrap(x: Column, period: float = 2 * math.pi) -> Column:
    """x moved by whole periods into [-period/2, period/2)."""
    return F.pmod(x + period / 2, F.lit(period)) - period / 2


def mean_all(x: Column) -> Column:
    """The mean that is NULL if any value is missing (as a plain array mean would be NaN)."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))
