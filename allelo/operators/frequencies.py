"""Allele frequencies, diversity and gene copies of genotype tables in long form; null is a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def allele_spectrum(df: DataFrame, pop: str, locus: str, allele: str) -> DataFrame:
    """Count and share of each allele in each population and locus."""
    n = df.where(F.col(allele).isNotNull()).groupBy(pop, locus, allele).agg(F.count("*").alias("n"))
    return n.withColumn("freq", F.col("n") / F.sum("n").over(W.partitionBy(pop, locus)))


def allele_spectrum_with_total(df: DataFrame, pop: str, locus: str, allele: str) -> DataFrame:
    """As ``allele_spectrum``, with rows of null population for all populations together; one aggregation makes both."""
    d = df.where(F.col(allele).isNotNull() & F.col(pop).isNotNull())
    sets = [[F.col(pop), F.col(locus), F.col(allele)], [F.col(locus), F.col(allele)]]
    n = d.groupingSets(sets, pop, locus, allele).agg(F.count("*").alias("n"))
    return n.withColumn("freq", F.col("n") / F.sum("n").over(W.partitionBy(pop, locus)))


def allele_counts(df: DataFrame, pop: str, locus: str, allele: str) -> DataFrame:
    """Distinct alleles and gene copies of each population and locus; null population: of the locus as a whole."""
    s = allele_spectrum_with_total(df, pop, locus, allele)
    return s.groupBy(pop, locus).agg(F.count("*").alias("n_alleles"), F.sum("n").alias("n_copies"))


def expected_heterozygosity(spectrum: DataFrame, *keys: str) -> DataFrame:
    """1 - sum of squared frequencies."""
    return spectrum.groupBy(*keys).agg((F.lit(1.0) - F.sum(F.col("freq") * F.col("freq"))).alias("h_exp"))


def mean_heterozygosity(h: DataFrame, *keys: str) -> DataFrame:
    """Average over the loci."""
    return h.groupBy(*keys).agg(F.avg("h_exp").alias("mean_h"), F.count("*").alias("n_loci"))


def pooled_heterozygosity(spectrum: DataFrame, locus: str, allele: str) -> DataFrame:
    """Expected heterozygosity of each locus from the counts of all populations together."""
    pooled = spectrum.groupBy(locus, allele).agg(F.sum("n").alias("n"))
    s = pooled.groupBy(locus).agg(F.sum("n").alias("n_copies"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("_s"))
    n = F.col("n_copies").cast("double")
    return s.select(locus, "n_copies", (F.lit(1.0) - F.col("_s") / (n * n)).alias("h_exp"))


def gene_copies(df: DataFrame, pop: str, locus: str, value: str) -> DataFrame:
    """Present and missing gene copies of each (locus, pop), of each locus, and altogether (null keys)."""
    missing = F.sum(F.col(value).isNull().cast("long"))
    return df.rollup(locus, pop).agg(F.count(value).alias("n_copies"), missing.alias("n_missing"))


def base_frequencies(df: DataFrame, key: str, symbol: str, weights: DataFrame) -> DataFrame:
    """Frequencies of bases, where an ambiguous symbol counts in parts: ``weights`` has (symbol, base, w), fixed rows.

    Symbols that ``weights`` lacks carry no information. The smallest frequency is 1e-6, before the last normalisation.
    """
    n = df.groupBy(key, symbol).agg(F.count("*").alias("n")).join(F.broadcast(weights.withColumnRenamed("symbol", symbol)), symbol)
    f = n.groupBy(key, "base").agg(F.sum(F.col("n") * F.col("w")).alias("w"))
    per = W.partitionBy(key)
    f = f.withColumn("freq", F.greatest(F.col("w") / F.sum("w").over(per), F.lit(1e-6)))
    return f.select(key, "base", "w", (F.col("freq") / F.sum("freq").over(per)).alias("freq"))


def em_frequencies(counts: DataFrame, key: str, symbol: str, n: str, masks: DataFrame, steps: int = 1, least: float = 1e-10) -> DataFrame:
    """(key, f array): frequencies of bases from counts of symbols that may stand for several bases, by ``steps`` rounds of
    expectation (a symbol's count is shared out as the frequencies say) and normalisation, from equal ones on.

    ``masks`` is (``symbol``, mask array) with a number above 0 for each base that the symbol can be. The rounds run on the
    counts, a row a key with one entry a symbol, so they cost the same for any number of sites; sums under ``least`` get it added."""
    d = counts.join(masks, symbol).groupBy(key, symbol).agg(F.sum(n).cast("double").alias("n"), F.first("mask").alias("m"))
    d = d.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(symbol).alias("s"), "n", "m"))).alias("_c"))
    k = F.size(F.col("_c")[0]["m"])
    start = F.transform(F.sequence(F.lit(1), k), lambda _: F.lit(1.0) / k)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def step(f: Column) -> Column:
        share = lambda r: F.transform(F.zip_with(f, r["m"], lambda x, m: x * m), lambda w: w * r["n"] / total(F.zip_with(f, r["m"], lambda x, m: x * m)))
        sums = F.aggregate("_c", F.transform(f, lambda _: F.lit(0.0)), lambda a, r: F.zip_with(a, share(r), lambda x, y: x + y))
        return F.transform(sums, lambda x: F.when(x < least, x + least).otherwise(x))

    def normal(xs: Column) -> Column:
        return F.transform(xs, lambda x: x / total(xs))

    rounds = F.sequence(F.lit(1), F.lit(steps)) if steps else F.array().cast("array<int>")
    return d.select(key, F.aggregate(rounds, start, lambda f, _: normal(step(f))).alias("f"))


def hash_uniform(*parts: Column | str) -> Column:
    """A number between 0 and 1, neither included, from the MD5 of the parts as text, joined by a bar."""
    h = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def weighted_subset(df: DataFrame, keys: list[str], name: str, weight: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each group, drawn one after the other without replacement with probabilities that go by ``weight``: those with
    the smallest -ln(u) / weight, u a seeded hash of the name. Every task passes on ``n`` rows of a group at most; rows
    without a weight above 0 are never drawn. Adds ``draw``, the place at which a row was drawn."""
    d = df.where(F.col(weight) > 0).withColumn("_key", -F.log(hash_uniform(name, F.lit(seed))) / F.col(weight))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_key", name))
    return d.withColumn("draw", rank).where(F.col("draw") <= n).drop("_key")


def allele_range(df: DataFrame, key: str, value: str) -> DataFrame:
    """Smallest, greatest and mean repeat number of the values present."""
    return df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"))


def relabel(df: DataFrame, pop: str, mapping: DataFrame, to: str) -> DataFrame:
    """Populations merged as ``mapping`` (pop, to) says; those that it lacks stay out. The map is a dimension."""
    return df.join(mapping, pop).drop(pop).withColumnRenamed(to, pop)


def random_subset(df: DataFrame, keys: list[str], name: str, n: int, seed: str) -> DataFrame:
    """``n`` individuals of each group in the order of a seeded hash of their names."""
    order = F.md5(F.concat(F.col(name).cast("string"), F.lit(seed)).cast("binary"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order, name))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def keep_listed(df: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(listed, on, "left_semi")


def drop_listed(df: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(listed, on, "left_anti")


def drop_rare_alleles(df: DataFrame, locus: str, allele: str, pop: str, min_freq: float, min_pops: float) -> DataFrame:
    """Rows of alleles with an overall share of their locus of ``min_freq`` at least, in a share ``min_pops`` of all
    populations at least."""
    present = df.where(F.col(allele).isNotNull())
    pops = present.select(pop).distinct().agg(F.count("*").alias("n_pops"))
    a = present.groupBy(locus, allele).agg(F.count("*").alias("n"), F.countDistinct(pop).alias("in_pops"))
    a = a.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(locus))).crossJoin(F.broadcast(pops))  # one row
    good = a.where((F.col("share") >= min_freq) & (F.col("in_pops") / F.col("n_pops") >= min_pops)).select(locus, allele)
    return df.join(good, [locus, allele], "left_semi")


def drop_sparse(df: DataFrame, expected: DataFrame, group: list[str], have: str, need: str, most_missing: float) -> DataFrame:
    """Rows of groups of which a share ``most_missing`` at most is missing: ``expected`` has (group, need)."""
    n = df.groupBy(*group).agg(F.count("*").alias(have)).join(expected, group)
    good = n.where(1 - F.col(have) / F.col(need) <= most_missing).select(*group)
    return df.join(good, group, "left_semi")


def drop_monomorphic(df: DataFrame, locus: str, allele: str) -> DataFrame:
    several = df.groupBy(locus).agg(F.countDistinct(allele).alias("k")).where(F.col("k") > 1).select(locus)
    return df.join(several, locus, "left_semi")


def biallelic(df: DataFrame, site: list[str], allele: str) -> DataFrame:
    two = df.groupBy(*site).agg(F.countDistinct(allele).alias("k")).where(F.col("k") == 2).select(*site)
    return df.join(two, site, "left_semi")


def clip_cut_sites(seq: Column, site: str, rest: str) -> Column:
    """A sequence without the restriction site at its start and its remnant at its end."""
    s = F.when(seq.startswith(site), F.substring(seq, F.lit(len(site) + 1), F.length(seq))).otherwise(seq)
    return F.when(s.endswith(rest), F.substring(s, F.lit(1), F.length(s) - len(rest))).otherwise(s)


def clean_name(name: Column, width: int = 10) -> Column:
    """Trimmed, blanks as underscores, padded to the width."""
    return F.rpad(F.translate(F.trim(name), " ", "_"), width, " ")


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def first_seen_index(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Number of each value of a group in the order of its first appearance, from 0 (allele dictionary)."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_at", value)) - 1
    return seen.select(*keys, value, rank.alias("idx"))


def allele_index(df: DataFrame, keys: list[str], value: str, dictionary: DataFrame) -> DataFrame:
    """Rows with the number ``idx`` of their value in the dictionary of their group (see ``first_seen_index``); null for
    values that it lacks and for missing ones."""
    return df.join(dictionary.select(*keys, value, "idx"), [*keys, value], "left").select(*[df[c] for c in df.columns], "idx")


def repeat_offset(df: DataFrame, locus: str, length: str, unit: int) -> DataFrame:
    """For each locus the shift r in 0..unit-1 with the least sum of squared distances of (length - r) to multiples of
    ``unit`` (of equals the smallest), and that sum."""
    shifts = df.select(locus, length).where(F.col(length).isNotNull()).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(unit - 1))))
    off = F.pmod(F.col(length) - F.col("r"), F.lit(unit))
    d = F.least(off, unit - off)
    s = shifts.groupBy(locus, "r").agg(F.sum(d * d).alias("ss"))
    return s.groupBy(locus).agg(F.min(F.struct("ss", "r")).alias("m")).select(locus, F.col("m.r").alias("shift"), F.col("m.ss").alias("ss"))


def to_repeats(length: Column, shift: Column, unit: int, tie: Column, base: int = 10) -> Column:
    """Fragment length as a number of repeats: the nearest multiple; ``tie`` (0 or 1) decides where two are equally near."""
    x = (length - shift) / F.lit(unit)
    low = F.floor(x)
    return (F.when(x - low == 0.5, low + tie).otherwise(F.floor(x + 0.5)) + base).cast("long")
