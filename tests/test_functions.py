import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelo.functions import model
from allelo.functions import special as sp
from allelo.functions.priors import Prior, bin_prior, log_density_col, log_mass_col, truncated_mean_col
from allelo.operators import chains, events, frequencies, marginal, posterior
from allelo.report import text_table
from allelo.streaming.event_bins import binned_events


def test_gamma_and_friends():
    assert sp.gamma_p(1.0, 2.0) == pytest.approx(1 - math.exp(-2))
    assert sp.gamma_p(0.5, 3.0) == pytest.approx(math.erf(math.sqrt(3)))
    assert sp.gamma_p(30.0, 45.0) == pytest.approx(1 - sum(math.exp(-45) * 45**k / math.factorial(k) for k in range(30)))
    assert sp.chi2_quantile(0.95, 1) == pytest.approx(3.841458820694124)
    assert sp.inverse_normal(0.975) == pytest.approx(1.959963984540054)
    for x in (0.1, 1.0, 10.0, 1e4):
        w = sp.lambert_w(x)
        assert w * np.exp(w) == pytest.approx(x)
    assert sp.gamma_rates(0.5, 4) == pytest.approx([0.03338775, 0.25191592, 0.82026848, 2.89442785], rel=1e-5)
    r, w = sp.laguerre_rates(0.7, 6)
    assert w.sum() == pytest.approx(1) and (r * w).sum() == pytest.approx(1)
    assert sp.romberg(math.sin, 0, math.pi) == pytest.approx(2)


def test_mittag_leffler():
    assert sp.mittag_leffler(1.0, np.array([-2.0]))[0] == pytest.approx(math.exp(-2))
    x = np.array([-0.5, -2.0])
    erfcx = [math.exp(v * v) * math.erfc(-v) for v in x]
    assert sp.mittag_leffler(0.5, x) == pytest.approx(erfcx, rel=1e-3)


@pytest.mark.parametrize("kind", ["uniform", "exponential", "gamma", "normal", "multiplicative"])
def test_priors(kind):
    p = Prior(kind, 0.5, 4.0, mean=1.5, sd=0.8, alpha=2.0)
    x = p.draw(np.random.default_rng(1), 4000)
    assert x.min() >= 0.5 and x.max() <= 4.0
    grid = np.linspace(0.5, 4.0, 20001)
    d = np.exp(p.log_density(grid))
    assert np.sum(d) * (grid[1] - grid[0]) == pytest.approx(1, rel=2e-3)
    assert x.mean() == pytest.approx(p.mean_truncated(), rel=0.04)
    assert bin_prior(p, 7000).sum() * 3.5 / 7000 == pytest.approx(1, rel=1e-3)


def test_columns(spark):
    d = spark.createDataFrame([(3.0,), (0.5,), (None,)], "x double")
    got = [r[0] for r in d.select(sp.lgamma_col("x")).collect()]
    assert got[:2] == pytest.approx([math.lgamma(3), math.lgamma(0.5)])
    c = log_density_col(F.lit(0.05), F.lit("uniform"), F.lit(0.0), F.lit(0.1), F.lit(0.01))
    assert spark.range(1).select(c).first()[0] == pytest.approx(math.log(10))


def test_gamma_functions_by_row(spark):
    pairs = [(a, x) for a in (0.05, 0.5, 1.0, 3.7, 40.0, 300.0) for x in (0.0, 1e-9, 0.3, 1.0, 4.7, 41.0, 300.5, 302.0, 900.0)]
    d = spark.createDataFrame(pairs, "a double, x double")
    got = [tuple(r) for r in d.select(sp.gamma_p_col(F.col("a"), F.col("x")), sp.lgamma_col("a"), sp.erf_col(F.col("x") - 1), sp.normal_cdf_col(F.col("x") - 2)).collect()]
    for (a, x), (p, g, e, c) in zip(pairs, got, strict=True):
        assert p == pytest.approx(float(sp.gamma_p(a, x)), rel=1e-9, abs=1e-13)
        assert g == pytest.approx(math.lgamma(a), rel=1e-13, abs=1e-13)
        assert e == pytest.approx(math.erf(x - 1), abs=1e-13) and c == pytest.approx(float(sp.normal_cdf(x - 2)), abs=1e-13)
    assert spark.range(1).select(sp.gamma_p_col(F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None


@pytest.mark.parametrize("kind", ["uniform", "exponential", "gamma", "normal", "multiplicative"])
def test_priors_by_row(spark, kind):
    """One table of priors with different bounds against the numpy form; densities sum to 1 and means agree."""
    given = [(k, kind, *b) for k, b in enumerate([(0.5, 4.0, 1.5, 0.8, 2.0), (0.001, 30.0, 7.0, 9.0, 0.6), (2.0, 2.5, 1.3, 1.0, 9.0)])]
    d = spark.createDataFrame(given, "k int, kind string, low double, high double, mean double, sd double, alpha double")
    rows = {r["k"]: r for r in posterior.prior_bins(d, ["k"], 3000).groupBy("k").agg(F.sum(F.exp("log_prior")).alias("s"), F.avg("prior_mean").alias("m"), F.max_by("log_prior", "bin").alias("last"), F.count("*").alias("n")).collect()}
    for k, _, low, high, mean, sd, alpha in given:
        p = Prior(kind, low, high, mean=mean, sd=sd, alpha=alpha)
        assert rows[k]["n"] == 3000
        assert rows[k]["last"] == pytest.approx(float(p.log_density(high - (high - low) / 6000)), rel=1e-8)
        if (kind, k) not in (("gamma", 1), ("multiplicative", 1)):  # steep at the lower bound: equal bins are too coarse there
            assert rows[k]["s"] * (high - low) / 3000 == pytest.approx(1, rel=1e-3)
            assert rows[k]["m"] == pytest.approx(p.mean_truncated(20001), rel=1e-3)


def test_priors_by_row_defined_cases(spark):
    kinds = [("uniform",), ("exponential",), ("gamma",), ("normal",), ("multiplicative",), ("other",), (None,)]
    d = spark.createDataFrame(kinds, "kind string")
    lit = [F.lit(float(x)) for x in (0.0, 4.0, 1.5, 0.8, 2.0)]
    outside = d.select(log_density_col(F.lit(5.0), F.col("kind"), *lit)).collect()
    assert all(r[0] == float("-inf") for r in outside)
    at_zero = [r[0] for r in d.select(log_density_col(F.lit(0.0), F.col("kind"), *lit)).collect()]
    assert at_zero[5:] == [None, None] and all(x is not None for x in at_zero[:5])
    far = [F.lit(x) for x in (100.0, 101.0, 1.0, 1.0, 1.0)]  # no mass in doubles
    assert d.where("kind = 'normal'").select(log_mass_col(F.col("kind"), *far), truncated_mean_col(F.col("kind"), *far)).first()[:] == (None, None)
    no_sd = d.where("kind in ('gamma', 'normal')").select(log_density_col(F.lit(1.0), F.col("kind"), *lit[:3])).collect()
    assert [r[0] for r in no_sd] == [None, None]


def test_histogram_against_its_prior(spark):
    """Quantiles of a prior leave no trace: log ratios near 0; empty bins are null; a group without prior is left out."""
    p = Prior("gamma", 0.5, 4.0, mean=1.5, alpha=2.0)
    x = p.quantile((np.arange(1000) + 0.5) / 1000)
    d = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)] + [("c", 3.9)], "k string, v double")
    h = posterior.histogram(d, ["k"], "v", 0.5, 4.0, 10)
    priors = spark.createDataFrame([("a", "gamma", 0.5, 4.0, 1.5, 1.0, 2.0), ("c", "uniform", 0.5, 4.0, 1.5, 1.0, 2.0)], "k string, kind string, low double, high double, mean double, sd double, alpha double")
    got = posterior.against_prior(h, ["k"], "density", posterior.prior_bins(priors, ["k"], 10)).collect()
    assert sorted({r["k"] for r in got}) == ["a", "c"] and len(got) == 20
    assert max(abs(r["log_ratio"]) for r in got if r["k"] == "a") < 0.15
    assert [r["log_ratio"] is None for r in sorted(got, key=lambda r: r["bin"]) if r["k"] == "c"] == [True] * 9 + [False]


def test_constant_series_and_single_chain(spark):
    d = spark.createDataFrame([(1, i, 2.0) for i in range(5)], "c int, i int, v double")
    e = chains.autocorrelation(d, ["c"], ["i"], "v").first()
    assert (e["r"], e["ess"]) == (1.0, 0.0)
    assert chains.gelman_rubin(d.withColumn("k", F.lit(1)), ["k"], "c", "v").first()["r_hat"] is None


def test_value_at_the_upper_bound_and_equal_modes(spark):
    d = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 1.5), (1, -1.0)], "k int, v double")
    h = posterior.histogram(d, ["k"], "v", 0.0, 1.0, 4)
    assert [r["n"] for r in h.orderBy("bin").collect()] == [2, 0, 0, 2]
    m = posterior.mode_and_median(h, ["k"], "density", skip=0).first()
    assert m["mode"] == 0.125


def test_intervals_over_bins(spark):
    d = spark.createDataFrame([(0.2, 0.2), (0.5, 0.9), (0.5, 3.5)], "s double, e double")
    got = sorted((r["s"], r["e"], r["bin"], round(r["part"], 6)) for r in events.over_bins(d, "s", "e", 1.0).collect())
    assert got == [(0.2, 0.2, 0, 0.0), (0.5, 0.9, 0, 0.4), (0.5, 3.5, 0, 0.5), (0.5, 3.5, 1, 1.0), (0.5, 3.5, 2, 1.0), (0.5, 3.5, 3, 0.5)]


def test_all_missing_locus_and_empty_table(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, "x")], "pop string, locus int, allele string")
    assert frequencies.allele_spectrum(d, "pop", "locus", "allele").count() == 1
    assert {(r["locus"], r["pop"]): (r["n_copies"], r["n_missing"]) for r in frequencies.gene_copies(d, "pop", "locus", "allele").collect()}[1, "a"] == (0, 1)
    assert frequencies.allele_spectrum(d.limit(0), "pop", "locus", "allele").count() == 0


def test_one_temperature(spark):
    d = spark.createDataFrame([(1, 1.0, -3.0), (1, 1.0, -4.0)], "k int, beta double, l double")
    assert marginal.thermodynamic(marginal.temperature_means(d, ["k"], "beta", "l"), ["k"], "beta").first()["thermo"] is None
    assert marginal.harmonic_mean(d, ["k"], "l").first()["harmonic"] == pytest.approx(-4 - math.log((1 + math.exp(-1)) / 2))


def test_report(spark):
    t = text_table(spark.createDataFrame([(1, 0.5), (2, None)], "locus int, x double"), "Title")
    assert t.splitlines()[0] == "Title" and "0.5" in t and "-" in t


def test_stream(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = binned_events(s, "ts", "event_type", "1 day", "1 day").writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bins").agg(F.sum("n")).first()[0] == e.count()


def test_migration_matrix(spark):
    rows = model.parse_matrix("{xs0 sxm 0mc}", 3)
    at = {(r["from_pop"], r["to_pop"]): r for r in rows}
    assert at[2, 1]["rep_idx"] == at[1, 2]["rep_idx"] and at[3, 2]["rep_idx"] == at[2, 3]["rep_idx"]
    assert [r["estimated"] for r in rows[:3]] == [True, True, False] and not at[3, 1]["estimated"]
    dim = spark.createDataFrame([tuple(r.values()) for r in rows], "param_idx int, kind string, from_pop int, to_pop int, setting string, rep_idx int, estimated boolean")
    assert sorted(r["param_idx"] for r in model.representatives(spark.range(9).select(F.col("id").cast("int").alias("param_idx")), dim).collect()) == [0, 1, 3, 6]
    with pytest.raises(ValueError):
        model.parse_matrix("xx", 3)


def test_tables_round_trip(spark, tmp_path):
    from allelo.sources import tables

    d = spark.createDataFrame([(1, 2, 3, 0.5, 4, 1)], "locus long, param long, bin long, age double, n_all long, n_mrca long")
    tables.write_table(d, str(tmp_path / "e"), "events")
    assert tables.read_table(spark, str(tmp_path / "e"), "events").collect() == d.collect()
