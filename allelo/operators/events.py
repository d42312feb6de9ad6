"""Event times: histograms, tables, skylines over time bins, lineages through time, tree length, coalescent density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import stored
from .chains import autocorrelation, cumulated, neighbours


def intervals(df: DataFrame, keys: list[str], age: str, tie: str) -> DataFrame:
    """Adds ``start`` (age of the event before, 0 for the first), ``length`` and ``is_last``."""
    d = neighbours(df, keys, [age, tie], age)
    d = d.withColumn("start", F.coalesce("_prev", F.lit(0.0)))
    return d.withColumn("length", F.col(age) - F.col("start")).withColumn("is_last", F.col("_ends")).drop("_prev", "_next", "_ends")


def event_histogram(df: DataFrame, keys: list[str], age: str, width: float, is_last: Column) -> DataFrame:
    """Events, and last events of their tree, in each time bin."""
    return df.groupBy(*keys, F.floor(F.col(age) / F.lit(float(width))).cast("long").alias("bin")).agg(
        F.count("*").alias("n_all"), F.sum(is_last.cast("long")).alias("n_mrca")
    )


def event_frequencies(h: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Adds the share of each bin in its group."""
    return h.withColumn("freq", F.col(n) / F.sum(n).over(W.partitionBy(*keys)))


def event_table(h: DataFrame, keys: list[str], n: str, width: float) -> DataFrame:
    """Mean, standard deviation and median of the ages from bin middles, and the group's share of all events."""
    per = W.partitionBy(*keys)
    d = h.withColumn("mid", (F.col("bin") + 0.5) * F.lit(float(width)))
    up = per.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_half", F.sum(n).over(up) * 2 >= F.sum(n).over(per))
    mean = F.sum(F.col(n) * F.col("mid")) / F.sum(n)
    var = F.sum(F.col(n) * F.col("mid") * F.col("mid")) / F.sum(n) - mean * mean
    t = d.groupBy(*keys).agg(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), F.min(F.when(F.col("_half"), F.col("mid"))).alias("median"), F.sum(n).alias("total"))
    everything = t.agg(F.sum("total").alias("_all"))
    return t.crossJoin(F.broadcast(everything)).withColumn("share", F.col("total") / F.col("_all")).drop("_all")  # one row


def over_bins(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """A row for each time bin that an interval meets: ``bin`` and the covered ``part`` of the bin."""
    w = F.lit(float(width))
    first, last = F.floor(F.col(start) / w).cast("long"), F.ceil(F.col(end) / w).cast("long") - 1
    d = df.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
    part = (F.least(F.col(end), (F.col("bin") + 1) * w) - F.greatest(F.col(start), F.col("bin") * w)) / w
    return d.withColumn("part", part)


def skyline(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, weighted variance, summed weight and count of the values in each bin."""
    w, v = F.col(weight), F.col(value)
    mean = F.sum(w * v) / F.sum(w)
    return df.where(w > 0).groupBy(*keys, "bin").agg(
        mean.alias("mean"), F.greatest(F.sum(w * v * v) / F.sum(w) - mean * mean, F.lit(0.0)).alias("var"), F.sum(w).alias("weight"), F.count("*").alias("n")
    )


def skyline_deviations(df: DataFrame, keys: list[str], order: list[str], value: str, weight: str) -> DataFrame:
    """Finalised skyline: weighted mean, its standard deviation corrected for the correlation of successive values in a bin,
    lag-1 autocorrelation ``r``, effective number ``ess`` of values, mean weight and its standard deviation. ``sd`` is null
    in bins with one effective value or fewer, ``weight_sd`` in those with one value."""
    w, v = F.col(weight), F.col(value)
    d = df.where((w > 0) & v.isNotNull())
    mean = F.sum(w * v) / F.sum(w)
    s = d.groupBy(*keys, "bin").agg(
        mean.alias("mean"), F.greatest(F.sum(w * v * v) / F.sum(w) - mean * mean, F.lit(0.0)).alias("_var"), F.avg(w).alias("mean_weight"), F.stddev_samp(w).alias("weight_sd")
    )
    e = autocorrelation(d, [*keys, "bin"], order, value).drop("mean")
    k = [*keys, "bin"]
    e = e.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(k)], "n", "r", "ess")
    s = s.join(e, [s[c].eqNullSafe(e[f"_k{i}"]) for i, c in enumerate(k)])
    # summed weighted squares are n times mean weight times variance, over (ess - 1) times the mean weight; of a mean of n
    sd = F.when(F.col("ess") > 1 + 1e-6, F.sqrt(F.col("_var") / (F.col("ess") - 1)))
    return s.select(*k, "mean", sd.alias("sd"), "r", "ess", "mean_weight", "weight_sd", "n")


def drop_outliers(df: DataFrame, keys: list[str], value: str, times: float = 10.0) -> DataFrame:
    """Without values over ``times`` the mean of their group (two passes, whatever the order of rows): the means, a row a
    group and stored, are joined to the rows, which Spark moves only where they are too many to broadcast."""
    m = stored(df.groupBy(*keys).agg(F.avg(value).alias("_m")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_m"))
    same = [df[k].eqNullSafe(m[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(m, [*same, df[value] <= m["_m"] * times]).select(*[df[c] for c in df.columns])


def trim_tail(s: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Without the bins after the last one with weight."""
    last = F.max(F.when(F.col(weight) > 0, F.col("bin"))).over(W.partitionBy(*keys))
    return s.withColumn("_last", last).where(F.col("bin") <= F.col("_last")).drop("_last")


def combine_skylines(s: DataFrame, keys: list[str]) -> DataFrame:
    """Skylines of several loci as one: means by weight, variances of the weighted mean, shares of the weight."""
    d = s.groupBy(*keys, "bin").agg(
        (F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"),
        (F.sum(F.col("var") * F.col("weight")) / F.sum("weight")).alias("var"),
        F.sum("weight").alias("weight"),
    )
    return d.withColumn("sd", F.sqrt("var")).withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy(*keys)))


def expected_theta(length: Column, k: Column) -> Column:
    """Theta that an interval of ``k`` lineages ending in a coalescence suggests."""
    return length * k * (k - 1)


def expected_rate(length: Column, k: Column) -> Column:
    """Rate of an event that any of ``k`` lineages has once in the interval."""
    return F.lit(1.0) / (length * k)


def lineages(df: DataFrame, keys: list[str], order: list[str], delta: Column) -> DataFrame:
    """Adds ``k``: the running sum of ``delta`` (+1 tip, -1 coalescence, both for a migration) in each series."""
    return cumulated(df, keys, order, delta, "k")


def event_sums(df: DataFrame, keys: list[str], length: str, k: str, kind: str) -> DataFrame:
    """Per series: sum of k (k - 1) t, sum of k t, and the number of events of each series."""
    t, n = F.col(length), F.col(k)
    return df.groupBy(*keys).agg(F.sum(n * (n - 1) * t).alias("kt"), F.sum(n * t).alias("km"), F.count(kind).alias("events"))


def event_counts(df: DataFrame, keys: list[str], origin: str, target: str) -> DataFrame:
    """Per series and (origin, target): events, with ``within`` for those that stay in a population (coalescences) and false
    for those between two (migrations). Rows without either end do not count."""
    d = df.where(F.col(origin).isNotNull() & F.col(target).isNotNull())
    return d.groupBy(*keys, origin, target).agg(F.count("*").alias("n")).withColumn("within", F.col(origin) == F.col(target))


def divergence_models(pairs: DataFrame, models: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of populations with the columns of their divergence model (null where they have none) and whether they
    diverge. Models are a row a pair."""
    return pairs.join(models.withColumn("diverges", F.lit(True)), on, "left").withColumn("diverges", F.coalesce("diverges", F.lit(False)))


def coalescent_log_density(df: DataFrame, keys: list[str], length: str, k: str, kind: str, theta: float, migration: float) -> DataFrame:
    """Log density of time lists: -t (k (k - 1) / theta + k M) of each interval, ln(2 / theta) of each coalescence (type i),
    ln M of each migration (type m)."""
    wait = -F.col(length) * (F.col(k) * (F.col(k) - 1) / F.lit(float(theta)) + F.col(k) * F.lit(float(migration)))
    point = F.when(F.col(kind) == "i", F.log(F.lit(2.0 / theta))).when(F.col(kind) == "m", F.log(F.lit(float(migration)))).otherwise(F.lit(0.0))
    return df.groupBy(*keys).agg(F.sum(wait + point).alias("log_density"))


def tree_length(edges: DataFrame, keys: list[str], child_time: str, parent_time: str) -> DataFrame:
    return edges.groupBy(*keys).agg(F.sum(F.col(parent_time) - F.col(child_time)).alias("tree_length"))


def first_event(df: DataFrame, keys: list[str], time: str, kind: str) -> DataFrame:
    """The earliest of competing events."""
    return df.groupBy(*keys).agg(F.min(F.struct(time, kind)).alias("_m")).select(*keys, F.col(f"_m.{time}").alias(time), F.col(f"_m.{kind}").alias(kind))


def tip_dates(tips: DataFrame, dates: DataFrame, on: list[str], date: str, forward: bool = False, compat: bool = False) -> DataFrame:
    """Tips with their dates (0 where none is given) as ages from the youngest. Backward dates are taken from the smallest;
    forward ones up to the greatest (``compat``: youngest minus date, which is 0 or less)."""
    d = tips.join(dates, on, "left")
    s = dates.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    d = d.crossJoin(F.broadcast(s))  # one row
    age = F.col(date) - F.col("_lo") if not forward else (F.col("_lo") - F.col(date) if compat else F.col("_hi") - F.col(date))
    return d.withColumn(date, F.coalesce(age, F.lit(0.0))).drop("_lo", "_hi")


def scaled_rates(rates: DataFrame, weights: DataFrame, on: list[str], rate: str, weight: str = "weight") -> DataFrame:
    """Rates times the geographic weights of their pairs; pairs without weight keep theirs."""
    d = rates.join(weights.select(*on, F.col(weight).alias("_w")), on, "left")
    return d.withColumn(rate, F.col(rate) * F.coalesce("_w", F.lit(1.0))).drop("_w")


def geographic_weights(pairs: DataFrame, d: str) -> DataFrame:
    """1 / distance; 1 where no distance is given."""
    return pairs.withColumn("weight", F.when(F.col(d).isNull(), F.lit(1.0)).otherwise(F.lit(1.0) / F.greatest(F.col(d), F.lit(1e-6))))
