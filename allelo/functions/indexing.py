"""Numbering of parameters: population sizes first, then migration rates grouped by the receiving population."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate_index(source: Column, target: Column, n: Column | int) -> Column:
    """Number of the rate source -> target among n populations (both from 0); of a population size where they are equal."""
    n = F.lit(n) if isinstance(n, int) else n
    rate = n + target * (n - 1) + F.when(source < target, source).otherwise(source - 1)
    return F.when(source == target, target).otherwise(rate)


def rate_target(index: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(index < n, index).otherwise(F.floor((index - n) / (n - 1)).cast("int"))


def rate_source(index: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    t = rate_target(index, n)
    k = F.pmod(index - n, n - 1)
    return F.when(index < n, index).when(k < t, k).otherwise(k + 1).cast("int")


def first_rate(target: Column, n: Column | int) -> Column:
    """Number of the first rate into ``target``."""
    n = F.lit(n) if isinstance(n, int) else n
    return n + target * (n - 1)


def pair_index(i: Column, j: Column, n: Column | int) -> Column:
    """Number of the unordered pair i < j among n items."""
    n = F.lit(n) if isinstance(n, int) else n
    return (i * n - F.floor(i * (i + 1) / 2) + j - i - 1).cast("int")
