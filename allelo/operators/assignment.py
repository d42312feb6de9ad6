"""Assignment of individuals to populations, haplotype pairs, error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Share taken for a population that an individual never visited.
LEAST = 1e-20


def assignment(df: DataFrame, ind: str, locus: str, pop: str) -> DataFrame:
    """Share of visits of each individual at each locus to each population that occurs at all; unvisited ones 1e-20."""
    n = df.groupBy(ind, locus, pop).agg(F.count("*").alias("visits"))
    pops = df.select(pop).distinct().agg(F.collect_set(pop).alias("_pops"))  # the dimension of populations: one row
    total = n.groupBy(ind, locus).agg(F.sum("visits").alias("_n"))
    grid = total.crossJoin(F.broadcast(pops)).withColumn(pop, F.explode("_pops")).drop("_pops")
    d = grid.join(n, [ind, locus, pop], "left")
    return d.select(ind, locus, pop, F.greatest(F.coalesce("visits", F.lit(0)) / F.col("_n"), F.lit(LEAST)).alias("p"))


def assignment_all_loci(a: DataFrame, ind: str, pop: str) -> DataFrame:
    """Normalised product over the loci, in logarithms."""
    s = a.groupBy(ind, pop).agg(F.sum(F.log("p")).alias("_s"))
    per = W.partitionBy(ind)
    e = F.exp(F.col("_s") - F.max("_s").over(per))
    return s.withColumn("_e", e).select(ind, pop, (F.col("_e") / F.sum("_e").over(per)).alias("p"))


def haplotype_shares(df: DataFrame, keys: list[str], haplotype: str, complement: str) -> DataFrame:
    """Counts and shares of pairs of complementary haplotypes, whichever of the two was seen."""
    n = df.groupBy(*keys, F.least(haplotype, complement).alias("pair")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def error_rates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def population_frequency(df: DataFrame, keys: list[str], pop: str, pops: DataFrame, least: float = 0.1) -> DataFrame:
    """Frequencies of populations among current tips; each counts ``least`` at least before they are normalised."""
    n = df.groupBy(*keys, pop).agg(F.count("*").alias("n"))
    grid = df.select(*keys).distinct().crossJoin(F.broadcast(pops)).join(n, [*keys, pop], "left")  # pops: the dimension
    d = grid.withColumn("_w", F.greatest(F.coalesce(F.col("n").cast("double"), F.lit(0.0)), F.lit(least)))
    return d.select(*keys, pop, (F.col("_w") / F.sum("_w").over(W.partitionBy(*keys))).alias("freq"))


def count_keys(df: DataFrame, key: str, n: str | None = None) -> DataFrame:
    """Counts by string key."""
    return df.groupBy(key).agg((F.count("*") if n is None else F.sum(n)).alias("n"))
