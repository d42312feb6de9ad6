"""Marginal likelihoods: thermodynamic integration, Bezier end segment, harmonic mean, stepping stones, sums over loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import stored

#: Handles of the end segment's curve, as parts of the way, and its number of chords.
HANDLES, CHORDS = (0.2, 0.8), 100


def temperature_means(df: DataFrame, keys: list[str], beta: str, loglike: str) -> DataFrame:
    """Mean log likelihood at each inverse temperature ``beta``."""
    return df.groupBy(*keys, beta).agg(F.avg(loglike).alias("mean_l"), F.count(loglike).alias("n"))


def thermodynamic(means: DataFrame, keys: list[str], beta: str) -> DataFrame:
    """Trapezoid integral of the mean log likelihood over beta."""
    by = W.partitionBy(*keys).orderBy(beta)
    d = means.withColumn("_b", F.lag(beta).over(by)).withColumn("_l", F.lag("mean_l").over(by))
    return d.groupBy(*keys).agg(F.sum((F.col(beta) - F.col("_b")) * (F.col("mean_l") + F.col("_l")) / 2).alias("thermo"))


def bezier_end(means: DataFrame, keys: list[str], beta: str) -> DataFrame:
    """The integral with the hottest interval under a cubic curve instead of a chord: ``bezier_end`` (that interval) and
    ``chord_end`` (what the trapezoid gives for it)."""
    by = W.partitionBy(*keys).orderBy(beta)
    d = means.withColumn("_n", F.row_number().over(by)).withColumn("b1", F.lead(beta).over(by)).withColumn("l1", F.lead("mean_l").over(by))
    d = d.where((F.col("_n") == 1) & F.col("b1").isNotNull()).withColumnsRenamed({beta: "b0", "mean_l": "l0"})
    h1, h2 = HANDLES
    # control points: start, straight up at the start, level at the end, end
    x = (F.col("b0"), F.col("b0"), F.col("b0") + (F.col("b1") - F.col("b0")) * h1, F.col("b1"))
    y = (F.col("l0"), F.col("l0") + (F.col("l1") - F.col("l0")) * h2, F.col("l1"), F.col("l1"))

    def at(points, i):
        t = i / F.lit(float(CHORDS))
        u = F.lit(1.0) - t
        return u * u * u * points[0] + F.lit(3.0) * u * u * t * points[1] + F.lit(3.0) * u * t * t * points[2] + t * t * t * points[3]

    area = F.aggregate(F.sequence(F.lit(1), F.lit(CHORDS)), F.lit(0.0), lambda a, i: a + (at(x, i) - at(x, i - 1)) * (at(y, i) + at(y, i - 1)) / 2)
    return d.select(*keys, area.alias("bezier_end"), ((F.col("b1") - F.col("b0")) * (F.col("l0") + F.col("l1")) / 2).alias("chord_end"))


#: Values are scaled within steps of so much, so that no exponential of a step under- or overflows.
_STEP = 256.0


def log_sum_exp(df: DataFrame, keys: list[str], value: str, name: str, count: str | None = None) -> DataFrame:
    """ln(sum(exp(value))) of each group, and its number of values as ``count``. Values of one step are summed before the
    shuffle, scaled by its upper end; then the sums of the few steps are put together. Rows are not moved or joined."""
    top = F.ceil(F.col(value) / F.lit(_STEP)) * F.lit(_STEP)
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, top.alias("_t")).agg(F.sum(F.exp(F.col(value) - top)).alias("_e"), F.count("*").alias("_c"))
    steps = F.collect_list(F.struct("_t", "_e"))  # a row a step
    d = d.groupBy(*keys).agg(F.max("_t").alias("_m"), steps.alias("_s"), F.sum("_c").alias("_c"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["_e"] * F.exp(x["_t"] - F.col("_m")))
    return d.select(*keys, (F.col("_m") + F.log(total)).alias(name), *([F.col("_c").alias(count)] if count else []))


def harmonic_mean(df: DataFrame, keys: list[str], loglike: str) -> DataFrame:
    """The logarithm of the harmonic mean of the likelihoods."""
    s = log_sum_exp(df.select(*keys, (-F.col(loglike)).alias("_l")), keys, "_l", "_s", "_n")
    return s.select(*keys, (F.log(F.col("_n").cast("double")) - F.col("_s")).alias("harmonic"))


def stepping_stones(df: DataFrame, keys: list[str], beta: str, loglike: str) -> DataFrame:
    """Sum over temperatures of the log mean of exp((next beta - beta) * l)."""
    steps = df.select(*keys, beta).distinct().withColumn("_step", F.lead(beta).over(W.partitionBy(*keys).orderBy(beta)) - F.col(beta))
    steps = stored(steps.where(F.col("_step").isNotNull()))  # a row a temperature, of a size that Spark sees
    d = df.join(steps, [*keys, beta]).select(*keys, beta, (F.col("_step") * F.col(loglike)).alias("_v"))
    s = log_sum_exp(d, [*keys, beta], "_v", "_s", "_n")
    return s.groupBy(*keys).agg(F.sum(F.col("_s") - F.log(F.col("_n").cast("double"))).alias("stepping"))


def scaling_factor(combined: DataFrame, keys: list[str], log_density: str, width: float) -> DataFrame:
    """Sum over parameters of ln(bin width) + ln(sum of exp(log density)): what joining loci adds to their sum."""
    s = log_sum_exp(combined, keys, log_density, "_s")
    return s.agg(F.sum(F.col("_s") + F.log(F.lit(float(width)))).alias("factor"))


def all_loci(per_locus: DataFrame, value: str, factor: DataFrame) -> DataFrame:
    """Marginal likelihood of all loci: their sum plus the factor (one row each)."""
    return per_locus.agg(F.sum(value).alias("_s")).crossJoin(factor).select((F.col("_s") + F.col("factor")).alias("all_loci"))
