"""Posterior histograms: binning, smoothing, modes, medians, credible sets, and their combination over loci."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.priors import log_density_col, log_mass_col, truncated_mean_col

#: Comparisons of cumulated probabilities with a bound allow for the order of summation.
EPSILON = 1e-9


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of equal width from 0; values beyond either bound go to the first or last bin."""
    raw = F.floor((value - low) / ((high - low) / F.lit(float(bins)))).cast("int")
    return F.greatest(F.lit(0), F.least(raw, F.lit(bins - 1)))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Dense histogram of each group: bin, middle, count, density (integrates to 1)."""
    lo, hi, width = F.lit(float(low)), F.lit(float(high)), (high - low) / bins
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, bin_of(F.col(value), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"))
    grid = n.groupBy(*keys).agg(F.sum("n").alias("total")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    d = grid.join(n, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select(*keys, "bin", (lo + (F.col("bin") + 0.5) * F.lit(width)).alias("middle"), "n", (F.col("n") / (F.col("total") * F.lit(width))).alias("density"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, second raw moment and standard deviation (n - 1)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg(F.col(value) * F.col(value)).alias("second_moment"), F.stddev_samp(value).alias("sd"))


def kernel_weights(half: int) -> list[float]:
    """Epanechnikov weights for offsets -half..half: 0.75 (1 - u^2), u = offset / half."""
    return [0.75 * (1.0 - (k / half) ** 2) for k in range(-half, half + 1)]


def smooth(h: DataFrame, keys: list[str], value: str, bins: int, half: int | None = None) -> DataFrame:
    """Adds ``smoothed``: the weighted mean over neighbouring bins, zero beyond the ends, with the total of each group kept."""
    half = max(5, int(bins**0.5)) if half is None else half
    by = W.partitionBy(*keys).orderBy("bin")
    raw = None
    for k, w in zip(range(-half, half + 1), kernel_weights(half), strict=True):
        if w > 0:
            term = F.coalesce(F.lag(value, -k).over(by), F.lit(0.0)) * F.lit(w)
            raw = term if raw is None else raw + term
    d = h.withColumn("_raw", raw)
    per = W.partitionBy(*keys)
    return d.withColumn("smoothed", F.col("_raw") * F.sum(value).over(per) / F.sum("_raw").over(per)).drop("_raw")


def kernel_density(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int, half: int) -> DataFrame:
    """Kernel smoothing straight from the samples: each adds its weights to the bins around it, inside the grid."""
    weights = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-half, half + 1), kernel_weights(half), strict=True) if w > 0])
    n = df.groupBy(*keys, bin_of(F.col(value), F.lit(float(low)), F.lit(float(high)), bins).alias("_b")).agg(F.count("*").alias("_n"))
    d = n.select(*keys, "_b", "_n", F.explode(weights).alias("x")).withColumn("bin", F.col("_b") + F.col("x.k"))
    d = d.where(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg(F.sum(F.col("_n") * F.col("x.w")).alias("w"))
    return d.withColumn("density", F.col("w") / F.sum("w").over(W.partitionBy(*keys)) / ((high - low) / bins)).drop("w")


def savitzky_golay_weights(half: int, degree: int, at: int = 0) -> list[float]:
    """Weights of the values at offsets -half..half for the fitted polynomial's value at offset ``at``."""
    import numpy as np

    x = np.arange(-half, half + 1)
    return (np.vander([at], degree + 1, increasing=True) @ np.linalg.pinv(np.vander(x, degree + 1, increasing=True)))[0].tolist()


def savitzky_golay(h: DataFrame, keys: list[str], value: str, half: int, degree: int = 2, edges: bool = False) -> DataFrame:
    """Adds ``fitted``: the value at each bin (from 0, dense) of a least-squares polynomial over the bins around it. The first
    and last ``half`` bins are null, or with ``edges`` take the polynomial of the first or last full window; null where a
    group has no full window."""
    by = W.partitionBy(*keys).orderBy("bin")

    def fit(at: int) -> Column:
        """From the window whose middle is ``at`` bins before this one."""
        terms = [F.lag(value, at - k).over(by) * F.lit(w) for k, w in zip(range(-half, half + 1), savitzky_golay_weights(half, degree, at), strict=True)]
        return reduce(lambda a, b: a + b, terms)

    fitted = fit(0)
    if edges:
        last = F.max("bin").over(W.partitionBy(*keys))
        for j in range(half):
            fitted = F.when(F.col("bin") == j, fit(j - half)).when(F.col("bin") == last - j, fit(half - j)).otherwise(fitted)
    return h.withColumn("fitted", fitted)


def mode_and_median(h: DataFrame, keys: list[str], prob: str, skip: int = 2, after: bool = False) -> DataFrame:
    """Middle of the highest bin (bins below ``skip`` excluded, of equals the first) and of the bin where the cumulated
    probability crosses a half; ``after``: of the bin after that one."""
    per = W.partitionBy(*keys)
    up = per.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    d = h.withColumn("_cdf", F.sum(prob).over(up) / F.sum(prob).over(per)).withColumn("_next", F.lead("middle").over(per.orderBy("bin")))
    best = F.max(F.when(F.col("bin") >= skip, F.struct(F.round(prob, 12).alias("p"), (-F.col("bin")).alias("b"), "middle")))
    at = F.struct("bin", (F.coalesce("_next", "middle") if after else F.col("middle")).alias("m"))
    half = F.min(F.when(F.col("_cdf") >= 0.5 - EPSILON, at))
    mean = F.sum(F.col("middle") * F.col(prob)) / F.sum(prob)
    return d.groupBy(*keys).agg(best["middle"].alias("mode"), half["m"].alias("median"), mean.alias("mean"))


def credible_set(h: DataFrame, keys: list[str], prob: str, level: float, name: str) -> DataFrame:
    """Adds ``name``: whether a bin is in the smallest set of highest bins that holds ``level`` of the probability."""
    per = W.partitionBy(*keys)
    down = per.orderBy(F.round(prob, 12).desc(), "bin").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(prob).over(down), F.lit(0.0)) / F.sum(prob).over(per)
    return h.withColumn(name, (before < level - EPSILON) & (F.col(prob) > 0))


def credible_interval(h: DataFrame, keys: list[str], prob: str, flag: str, width: float, name: str) -> DataFrame:
    """First and last bin start of the unbroken stretch of flagged bins around the highest bin."""
    by = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    d = h.withColumn("_island", F.sum((~F.col(flag)).cast("int")).over(by)).where(F.col(flag))
    peak = d.groupBy(*keys).agg(F.max(F.struct(F.round(prob, 12).alias("p"), (-F.col("bin")).alias("b"), "_island")).alias("m"))
    d = d.join(peak.select(*keys, F.col("m._island").alias("_at")), keys).where(F.col("_island") == F.col("_at"))
    start = F.col("middle") - width / 2
    return d.groupBy(*keys).agg(F.min(start).alias(f"{name}_low"), F.max(start).alias(f"{name}_high"))


def combine_loci(h: DataFrame, locus: str, keys: list[str], prob: str, prior: Column, least_log_prior: float = -11.0) -> DataFrame:
    """Posterior over all loci: in each bin the sum of log densities + (1 - loci) log prior, normalised from its maximum.

    Bins that a locus leaves empty and bins with a log prior at or under ``least_log_prior`` are left out.
    """
    d = h.withColumn("_lp", F.log(prior)).where((F.col(prob) > 0) & (F.col("_lp") > least_log_prior))
    loci = h.select(locus).distinct().agg(F.count("*").alias("_loci"))  # one row
    d = d.groupBy(*keys, "bin", "middle").agg(F.sum(F.log(prob)).alias("_s"), F.count("*").alias("_n"), F.max("_lp").alias("_lp"))
    d = d.crossJoin(F.broadcast(loci)).where(F.col("_n") == F.col("_loci"))
    d = d.withColumn("log_density", F.col("_s") + (1 - F.col("_loci")) * F.col("_lp"))
    per = W.partitionBy(*keys)
    e = F.exp(F.col("log_density") - F.max("log_density").over(per))
    return d.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(per)).select(*keys, "bin", "middle", "log_density", "prob")


def prior_bins(priors: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Priors, one a row (keys, kind, low, high, mean, sd, alpha) -> for each of equal bins between the bounds its middle and
    the log density there, with the prior's mean between its bounds. A projection: masses are computed once a prior."""
    p = [F.col(c) for c in ("kind", "low", "high", "mean", "sd", "alpha")]
    d = priors.select(*keys, *p, log_mass_col(*p).alias("_mass"), truncated_mean_col(*p).alias("prior_mean"))
    d = d.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    d = d.withColumn("middle", F.col("low") + (F.col("bin") + 0.5) * ((F.col("high") - F.col("low")) / F.lit(float(bins))))
    return d.select(*keys, "kind", "bin", "middle", log_density_col(F.col("middle"), *p, F.col("_mass")).alias("log_prior"), "prior_mean")


def against_prior(h: DataFrame, keys: list[str], prob: str, priors: DataFrame) -> DataFrame:
    """Bins of histograms beside the bins of their priors (``prior_bins`` of the same bounds), with ``log_ratio``, how much
    the data changed the density; null in empty bins."""
    d = h.drop("middle").join(priors, [*keys, "bin"])
    return d.withColumn("log_ratio", F.when(F.col(prob) > 0, F.log(F.when(F.col(prob) > 0, F.col(prob))) - F.col("log_prior")))


def summary(h: DataFrame, keys: list[str], prob: str, width: float) -> DataFrame:
    """Mode, median, mean and the 50 % and 95 % intervals of each group."""
    out = mode_and_median(h, keys, prob)
    for level, name in ((0.5, "in50"), (0.95, "in95")):
        out = out.join(credible_interval(credible_set(h, keys, prob, level, name), keys, prob, name, width, name), keys)
    return out


def wide_bound_warnings(s: DataFrame, high: float, share: float = 0.9) -> DataFrame:
    """Rows of a summary whose upper 50 % and 95 % bounds both lie above a share of the prior's maximum."""
    return s.where((F.col("in50_high") > share * high) & (F.col("in95_high") > share * high)).withColumn("warning", F.lit("upper bounds near the prior maximum"))
