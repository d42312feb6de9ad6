"""Queries on posterior samples: histograms and credible sets (q22 to q26, q47 to q50), chains and marginal likelihoods
(q27 to q34, q37 to q39, q51 to q53, q66, q67, q73 to q76, q85, q88), priors (q89), filters on histograms (q72)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import inverse_normal
from ..operators import chains as ch
from ..operators import marginal as ml
from ..operators import posterior as po
from .common import rounded, table

LOW, HIGH, BINS = 900.0, 105000.0, 60
WIDTH = (HIGH - LOW) / BINS
HALF = 7


def _prices(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("locus"), F.col("l_extendedprice").alias("value"))


def _histogram(spark, sf):
    return po.histogram(_prices(spark, sf), ["locus"], "value", LOW, HIGH, BINS)


def _smoothed(spark, sf):
    return po.smooth(_histogram(spark, sf), ["locus"], "density", BINS)


def q22_histogram(spark, sf):
    return rounded(_histogram(spark, sf), 12)


def q23_smooth(spark, sf):
    return rounded(_smoothed(spark, sf).select("locus", "bin", "n", "smoothed"), 12)


def q24_mode_median(spark, sf):
    return rounded(po.mode_and_median(_smoothed(spark, sf), ["locus"], "smoothed"), 6)


def q25_hpd(spark, sf):
    return rounded(po.summary(_smoothed(spark, sf), ["locus"], "smoothed", WIDTH), 6)


def q26_combine_loci(spark, sf):
    return rounded(po.combine_loci(_histogram(spark, sf), "locus", [], "density", F.lit(1.0 / (HIGH - LOW)), -20.0), 9)


def q27_ess(spark, sf):
    return rounded(ch.autocorrelation(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey"], "o_totalprice"), 6)


def q28_ess_summary(spark, sf):
    e = ch.autocorrelation(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], "o_totalprice")
    return rounded(ch.ess_summary(e, ["o_orderstatus"]), 6)


def q29_gelman(spark, sf):
    return rounded(ch.gelman_rubin(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", "l_quantity"), 8)


def q30_covariance(spark, sf):
    c = ch.covariances(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(c, 5)


def q66_pairwise_gelman(spark, sf):
    return rounded(ch.pairwise_gelman_rubin(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", "l_quantity"), 8)


def q67_mean_covariance(spark, sf):
    return rounded(ch.mean_covariances(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", ["l_quantity", "l_discount", "l_tax"]), 6)


def _loglike(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("locus"), (F.col("l_linenumber") / F.lit(7.0)).alias("beta"), (-F.col("l_quantity") - F.col("l_discount")).alias("l")
    )


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def q85_partial_correlations(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("locus"), *MEASURES)
    return rounded(ch.partial_correlations(d, ["locus"], list(MEASURES)), 8)


def q31_harmonic(spark, sf):
    return rounded(ml.harmonic_mean(_loglike(spark, sf), ["locus"], "l"), 7)


def q32_thermo(spark, sf):
    return rounded(ml.thermodynamic(ml.temperature_means(_loglike(spark, sf), ["locus"], "beta", "l"), ["locus"], "beta"), 7)


def q33_bezier(spark, sf):
    return rounded(ml.bezier_end(ml.temperature_means(_loglike(spark, sf), ["locus"], "beta", "l"), ["locus"], "beta"), 7)


def q34_stepping(spark, sf):
    d = _loglike(spark, sf)
    t = ml.thermodynamic(ml.temperature_means(d, ["locus"], "beta", "l"), ["locus"], "beta")
    s = ml.stepping_stones(d, ["locus"], "beta", "l")
    c = po.combine_loci(_histogram(spark, sf), "locus", [], "density", F.lit(1.0 / (HIGH - LOW)), -20.0).withColumn("param", F.lit(1))
    factor = ml.scaling_factor(c, ["param"], "log_density", WIDTH)
    every = ml.all_loci(t, "thermo", factor)
    return rounded(s.join(t, "locus").crossJoin(every), 6)  # one row


def q37_thin_accept(spark, sf):
    e = ch.thin(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 3)
    return rounded(ch.acceptance(e, ["event_type"], F.col("value") > 20))


def q38_quantiles(spark, sf):
    return rounded(ch.quantiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice"), 6)


def q39_union_offset(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("locus"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("value"))
    a, b = d.where("flag = 'A'"), d.where("flag <> 'A'")
    last = a.agg(F.max("locus").alias("shift"))
    b = b.crossJoin(F.broadcast(last)).select((F.col("locus") + F.col("shift")).alias("locus"), "flag", "value")  # one row
    every = a.unionByName(b)
    done = every.where("flag = 'N'").select("locus").distinct()
    n = every.groupBy("locus").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return n.join(done.withColumn("more", F.lit(True)), "locus", "left").withColumn("more", F.coalesce("more", F.lit(False)))


def q47_moments(spark, sf):
    return rounded(po.moments(_prices(spark, sf), ["locus"], "value"), 3)


def q48_kernel_density(spark, sf):
    return rounded(po.kernel_density(_prices(spark, sf), ["locus"], "value", LOW, HIGH, BINS, HALF), 12)


def q49_savitzky_golay(spark, sf):
    return rounded(po.savitzky_golay(_histogram(spark, sf), ["locus"], "density", 2).select("locus", "bin", "fitted"), 12)


def q50_warnings(spark, sf):
    s = po.summary(_smoothed(spark, sf), ["locus"], "smoothed", WIDTH)
    a = po.wide_bound_warnings(s, HIGH, 0.3).select("locus", "warning")
    e = ch.autocorrelation(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], "o_totalprice")
    return a.unionByName(ch.low_ess(e, 1000).select(F.col("o_orderpriority").alias("locus"), "warning"))


def q51_geweke(spark, sf):
    return rounded(ch.geweke(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey"], "o_totalprice"), 6)


def q52_swaps(spark, sf):
    return rounded(ch.swap_ratios(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", F.col("l_tax") < 0.03))


def q53_burnin(spark, sf):
    d = table(spark, sf, "orders").withColumn("step", F.floor(F.col("o_orderkey") / 1000))
    c = d.groupBy("o_orderstatus", "step").agg(F.var_samp("o_totalprice").alias("var"), F.count("*").cast("double").alias("ess"))
    return ch.stop_burnin(c, ["o_orderstatus"], 1e9, 0.02)


def q72_savitzky_golay_edges(spark, sf):
    return rounded(po.savitzky_golay(_histogram(spark, sf), ["locus"], "density", 2, edges=True).select("locus", "bin", "fitted"), 12)


def q73_best_state(spark, sf):
    d = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("score"))
    return ch.best_state(d, ["o_orderpriority"], ["o_orderkey"], "score")


def q74_running_moments(spark, sf):
    return rounded(ch.running_moments(table(spark, sf, "lineitem"), ["l_returnflag"], "l_orderkey", "l_quantity", 1000), 7)


LAGS = (1, 2, 5, 10, 50)


def q75_autocorrelations(spark, sf):
    return rounded(ch.autocorrelations(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey"], "o_totalprice", LAGS), 7)


def q88_heidelberger_welch(spark, sf):
    return rounded(ch.heidelberger_welch(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey"], "o_totalprice", orders=2), 6)


KINDS = ("uniform", "exponential", "gamma", "normal", "multiplicative")
LEAST, MOST = 1.0, 11000.0


def q89_prior_bins(spark, sf):
    """Balances by region beside a prior of each kind with the region's mean and deviation."""
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.select(F.col("n_regionkey").alias("region"), (F.col("c_acctbal") + 1000).cast("double").alias("value")).where(F.col("value").isNotNull())
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("region") % len(KINDS) + 1).cast("int"))
    p = d.groupBy("region").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    p = p.select("region", kind.alias("kind"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"), "mean", "sd", (F.col("mean") * F.col("mean") / F.col("sd") / F.col("sd")).alias("alpha"))
    h = po.histogram(d, ["region"], "value", LEAST, MOST, BINS)
    r = po.against_prior(h, ["region"], "density", po.prior_bins(p, ["region"], BINS))
    return rounded(r.select("region", "kind", "bin", "n", F.round("prior_mean", 4).alias("prior_mean"), "log_prior", "log_ratio"), 7)


def q76_raftery_lewis(spark, sf):
    return rounded(ch.raftery_lewis(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey"], "o_totalprice"), 4)


_GRID = f"""v AS (SELECT l_returnflag AS locus, l_extendedprice AS value FROM lineitem WHERE l_extendedprice IS NOT NULL),
b AS (SELECT locus, greatest(0, least(floor((value - {LOW}::DOUBLE) / (({HIGH}::DOUBLE - {LOW}::DOUBLE) / {BINS}))::INT, {BINS - 1})) AS bin, count(*) AS n FROM v GROUP BY ALL),
grid AS (SELECT locus, sum(n) AS total, i::INT AS bin FROM b, generate_series(0, {BINS - 1}) g(i) GROUP BY locus, i),
h AS (SELECT locus, bin, {LOW}::DOUBLE + (bin + 0.5) * {WIDTH!r}::DOUBLE AS middle, coalesce(n, 0) AS n, coalesce(n, 0) / (total * {WIDTH!r}::DOUBLE) AS density FROM grid LEFT JOIN b USING (locus, bin))"""
_SMOOTH = f"""{_GRID},
raw AS (SELECT a.locus, a.bin, a.middle, a.n, a.density, sum(x.density * 0.75 * (1 - ((x.bin - a.bin) / {HALF}.0::DOUBLE) ** 2)) AS raw
  FROM h a JOIN h x ON a.locus = x.locus AND abs(a.bin - x.bin) < {HALF} GROUP BY ALL),
s AS (SELECT *, raw * sum(density) OVER (PARTITION BY locus) / sum(raw) OVER (PARTITION BY locus) AS smoothed FROM raw)"""
_MODE = f"""{_SMOOTH},
c AS (SELECT *, sum(smoothed) OVER (PARTITION BY locus ORDER BY bin) / sum(smoothed) OVER (PARTITION BY locus) AS cdf,
  row_number() OVER (PARTITION BY locus ORDER BY CASE WHEN bin >= 2 THEN round(smoothed, 12) END DESC NULLS LAST, bin) AS best FROM s),
m AS (SELECT locus, max(middle) FILTER (best = 1) AS mode, min(middle) FILTER (cdf >= 0.5 - 1e-9) AS median, sum(middle * smoothed) / sum(smoothed) AS mean FROM c GROUP BY locus)"""


def _interval(level: float, name: str) -> str:
    return f"""{name}_f AS (SELECT locus, bin, middle, smoothed, smoothed > 0 AND coalesce(sum(smoothed) OVER (PARTITION BY locus ORDER BY round(smoothed, 12) DESC, bin
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(smoothed) OVER (PARTITION BY locus) < {level} - 1e-9 AS flag FROM s),
{name}_i AS (SELECT *, sum((NOT flag)::INT) OVER (PARTITION BY locus ORDER BY bin) AS island,
  row_number() OVER (PARTITION BY locus ORDER BY flag DESC, round(smoothed, 12) DESC, bin) AS best FROM {name}_f),
{name} AS (SELECT i.locus, min(i.middle - {WIDTH / 2!r}::DOUBLE) AS {name}_low, max(i.middle - {WIDTH / 2!r}::DOUBLE) AS {name}_high FROM {name}_i i
  JOIN {name}_i p ON p.locus = i.locus AND p.best = 1 AND p.island = i.island WHERE i.flag GROUP BY i.locus)"""


_HPD = f"{_MODE}, {_interval(0.5, 'in50')}, {_interval(0.95, 'in95')}"
_COMBINE = f"""{_GRID},
nl AS (SELECT count(DISTINCT locus) AS loci FROM h),
j AS (SELECT bin, middle, sum(ln(density)) + (1 - max(loci)) * ln({1.0 / (HIGH - LOW)!r}::DOUBLE) AS log_density FROM h, nl WHERE density > 0 GROUP BY bin, middle HAVING count(*) = max(loci)),
comb AS (SELECT *, exp(log_density - max(log_density) OVER ()) AS e FROM j)"""


def _ess(source: str, keys: str, order: str, value: str) -> str:
    return f"""x AS (SELECT {keys}, {value} AS v, {value} - avg({value}) OVER (PARTITION BY {keys}) AS x, {order} AS o FROM {source}),
y AS (SELECT *, lag(x) OVER (PARTITION BY {keys} ORDER BY o) AS p FROM x),
r AS (SELECT {keys}, count(*) AS n, avg(v) AS mean, CASE WHEN sum(x * x) > 0 THEN coalesce(sum(x * p), 0) / sum(x * x) ELSE 1.0 END AS r FROM y GROUP BY {keys}),
e AS (SELECT *, n * (1 - r) / (1 + r) AS ess FROM r)"""


_LL = """ll AS (SELECT l_returnflag AS locus, l_linenumber / 7.0::DOUBLE AS beta, -l_quantity - l_discount AS l FROM lineitem)"""
_MEANS = f"""{_LL}, means AS (SELECT locus, beta, avg(l) AS mean_l FROM ll GROUP BY ALL)"""
_THERMO = f"""{_MEANS}, steps AS (SELECT *, lag(beta) OVER w AS b, lag(mean_l) OVER w AS pl FROM means WINDOW w AS (PARTITION BY locus ORDER BY beta)),
thermo AS (SELECT locus, sum((beta - b) * (mean_l + pl) / 2) AS thermo FROM steps GROUP BY locus)"""
_PAIRS = [(x, y) for i, x in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for y in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i:]]


def _sg() -> str:
    w = po.savitzky_golay_weights(2, 2)
    return " + ".join(f"lag(density, {-k}) OVER w * {x!r}::DOUBLE" if k < 0 else f"lead(density, {k}) OVER w * {x!r}::DOUBLE" for k, x in zip(range(-2, 3), w, strict=True))


_EDGES = ", ".join(f"({at}, {k}, {w!r}::DOUBLE)" for at in range(-2, 3) for k, w in zip(range(-2, 3), po.savitzky_golay_weights(2, 2, at), strict=True))
_Z = float(inverse_normal(0.975))

def _given(pair: tuple[str, str], rest: tuple[str, ...]) -> str:
    """A correlation given others, from those given one fewer."""
    a, b = pair
    if not rest:
        return f"r_{min(a, b)}_{max(a, b)}"
    c, less = rest[0], rest[1:]
    r, s, t = _given((a, b), less), _given((a, c), less), _given((b, c), less)
    return f"(({r} - {s} * {t}) / sqrt((1 - {s} * {s}) * (1 - {t} * {t})))"




def _zero(source: str, name: str) -> str:
    """Spectral density at zero of series (k, o, v), of orders up to 2 by the equations of Yule and Walker."""
    return f"""{name}_x AS (SELECT k, o, v, v - avg(v) OVER (PARTITION BY k) AS x FROM {source}),
        {name}_l AS (SELECT *, lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM {name}_x WINDOW w AS (PARTITION BY k ORDER BY o)),
        {name}_r AS (SELECT k, count(*) AS m, avg(v) AS mean, sum(x * x) AS s, coalesce(sum(x * x1), 0) / sum(x * x) AS r1, coalesce(sum(x * x2), 0) / sum(x * x) AS r2 FROM {name}_l GROUP BY k HAVING count(*) > 3 AND sum(x * x) > 0),
        {name}_p AS (SELECT *, r1 * (1 - r2) / (1 - r1 * r1) AS a, (r2 - r1 * r1) / (1 - r1 * r1) AS b FROM {name}_r),
        {name}_f AS (SELECT k, m, mean, 0 AS q, 1.0::DOUBLE AS e, s / (m - 1) AS d FROM {name}_p
          UNION ALL SELECT k, m, mean, 1, 1 - r1 * r1, s * (1 - r1 * r1) / (m - 2) / (1 - r1) ** 2 FROM {name}_p
          UNION ALL SELECT k, m, mean, 2, 1 - a * r1 - b * r2, s * (1 - a * r1 - b * r2) / (m - 3) / (1 - a - b) ** 2 FROM {name}_p),
        {name} AS (SELECT k, any_value(m) AS m, any_value(mean) AS mean, arg_min(d, m * ln(e) + 2 * q) AS spectrum FROM {name}_f GROUP BY k)"""


_PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]

SQL = {
    "q85_partial_correlations": "WITH r AS (SELECT l_returnflag AS locus, "
    + ", ".join(f"corr({a}, {b}) AS r_{min(a, b)}_{max(a, b)}" for a, b in _PAIRS)
    + " FROM lineitem GROUP BY ALL) "
    + " UNION ALL ".join(f"SELECT locus, '{a}' AS a, '{b}' AS b, round({_given((a, b), tuple(m for m in MEASURES if m not in (a, b)))}, 8) AS partial FROM r" for a, b in _PAIRS),
    "q88_heidelberger_welch": f"""WITH n AS (SELECT o_orderpriority AS k, o_orderkey AS o, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n,
          count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders WHERE o_totalprice IS NOT NULL),
        late AS (SELECT k, o, v FROM n WHERE n > total // 2), {_zero("late", "h")},
        t AS (SELECT k, j, total, total * j // 10 AS skipped, v, o, avg(v) OVER (PARTITION BY k, j) AS mean FROM n, generate_series(0, 5) g(j) WHERE n > total * j // 10),
        b AS (SELECT k, j, total, skipped, sum(v - mean) OVER (PARTITION BY k, j ORDER BY o ROWS UNBOUNDED PRECEDING) AS b FROM t),
        c AS (SELECT k, j, total, skipped, sum(b * b) / (total - skipped) ** 2 / any_value(spectrum) AS c FROM b JOIN h USING (k) GROUP BY k, j, total, skipped),
        s AS (SELECT k, total, min(j) FILTER (c < {ch.BRIDGE_LIMIT}) AS j, max(c) FILTER (j = 5) AS last FROM c GROUP BY k, total),
        f AS (SELECT s.k, s.total, c.skipped, coalesce(c.c, s.last) AS c FROM s LEFT JOIN c ON c.k = s.k AND c.j = s.j),
        kept AS (SELECT n.k, o, v FROM n JOIN f USING (k) WHERE n > skipped), {_zero("kept", "e")}
        SELECT f.k AS o_orderpriority, total AS n, skipped::BIGINT AS dropped, round(c, 6) AS statistic, round(mean, 6) AS mean, round({_Z!r}::DOUBLE * sqrt(spectrum / m), 6) AS halfwidth,
        skipped IS NOT NULL AS stationary, coalesce({_Z!r}::DOUBLE * sqrt(spectrum / m) <= abs(mean) * 0.1::DOUBLE, false) AS exact FROM f LEFT JOIN e USING (k)""",
    "q89_prior_bins": f"""WITH v AS (SELECT n_regionkey AS region, (c_acctbal + 1000)::DOUBLE AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal IS NOT NULL),
        p AS (SELECT region, {list(KINDS)!r}[region % {len(KINDS)} + 1] AS kind, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS total FROM v GROUP BY region),
        x AS (SELECT 0 AS part, i, {LEAST!r}::DOUBLE + i * {(MOST - LEAST) / 8000!r}::DOUBLE AS x FROM generate_series(0, 8000) g(i)
          UNION ALL SELECT 1, i, {LEAST!r}::DOUBLE + (i + 0.5) * {(MOST - LEAST) / BINS!r}::DOUBLE FROM generate_series(0, {BINS - 1}) g(i)),
        f AS (SELECT *, CASE kind WHEN 'uniform' THEN 1.0::DOUBLE WHEN 'exponential' THEN exp(-x / m) WHEN 'gamma' THEN x ** ((m / sd) ** 2 - 1) * exp(-x * m / sd ** 2)
          WHEN 'normal' THEN exp(((x - m) / sd) ** 2 / -2) ELSE 1 / x END AS f FROM p, x),
        s AS (SELECT region, kind, f, x, CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {(MOST - LEAST) / 24000!r}::DOUBLE AS w FROM f WHERE part = 0),
        mass AS (SELECT region, CASE kind WHEN 'multiplicative' THEN ln({MOST / LEAST!r}::DOUBLE) ELSE sum(f * w) END AS mass, sum(f * x * w) AS first FROM s GROUP BY region, kind),
        n AS (SELECT region, greatest(0, least(floor((value - {LEAST!r}::DOUBLE) / {(MOST - LEAST) / BINS!r}::DOUBLE)::INT, {BINS - 1})) AS i, count(*) AS n FROM v GROUP BY ALL)
        SELECT region, kind, i::INT AS bin, coalesce(n, 0) AS n, round(first / mass, 4) AS prior_mean, round(ln(f / mass), 7) AS log_prior,
        CASE WHEN n > 0 THEN round(ln(n / (total * {(MOST - LEAST) / BINS!r}::DOUBLE)) - ln(f / mass), 7) END AS log_ratio
        FROM f JOIN mass USING (region) LEFT JOIN n USING (region, i) WHERE part = 1""",
    "q72_savitzky_golay_edges": f"""WITH {_GRID}, w(place, k, w) AS (VALUES {_EDGES}),
        c AS (SELECT locus, bin, greatest(2, least(bin, {BINS - 3})) AS middle FROM h)
        SELECT c.locus, c.bin, round(sum(h.density * w.w), 12) AS fitted FROM c JOIN w ON w.place = c.bin - c.middle JOIN h ON h.locus = c.locus AND h.bin = c.middle + w.k GROUP BY ALL""",
    "q73_best_state": """WITH s AS (SELECT o_orderpriority, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS score FROM orders)
        SELECT o_orderpriority, o_orderkey, score FROM s QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY score DESC, o_orderkey) = 1""",
    "q74_running_moments": """WITH b AS (SELECT DISTINCT l_returnflag, floor(l_orderkey / 1000)::BIGINT AS block FROM lineitem)
        SELECT b.l_returnflag, b.block, count(l_quantity) AS n, round(avg(l_quantity), 7) AS mean, round(stddev_samp(l_quantity), 7) AS sd
        FROM b JOIN lineitem l ON l.l_returnflag = b.l_returnflag AND floor(l_orderkey / 1000)::BIGINT <= b.block GROUP BY ALL""",
    "q75_autocorrelations": "WITH x AS (SELECT o_orderpriority, o_orderkey AS o, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS x FROM orders) " + " UNION ALL ".join(
        f"SELECT o_orderpriority, {k} AS lag, count(*) AS n, round(sum(x * p) / sum(x * x), 7) AS r FROM (SELECT *, lag(x, {k}) OVER (PARTITION BY o_orderpriority ORDER BY o) AS p FROM x) GROUP BY o_orderpriority"
        for k in LAGS
    ),
    "q76_raftery_lewis": f"""WITH c AS (SELECT o_orderpriority AS k, quantile_cont(o_totalprice, 0.025) AS cut FROM orders GROUP BY ALL),
        z AS (SELECT k, o_totalprice <= cut AS low, lead(o_totalprice <= cut) OVER (PARTITION BY k ORDER BY o_orderkey) AS nxt FROM orders JOIN c ON k = o_orderpriority),
        r AS (SELECT k, avg((nxt <> low)::INT) FILTER (NOT low) AS a, avg((nxt <> low)::INT) FILTER (low) AS b FROM z WHERE nxt IS NOT NULL GROUP BY k),
        f AS (SELECT k, ceil(ln(0.001::DOUBLE * (a + b) / greatest(a, b)) / ln(abs(1 - (a + b))))::BIGINT AS burn_in, (2 - (a + b)) * a * b / (a + b) ** 3 * {(_Z / 0.005) ** 2!r}::DOUBLE AS needed,
              {_Z * _Z * 0.025 * 0.975 / 0.005**2!r}::DOUBLE AS least FROM r)
        SELECT k AS o_orderpriority, burn_in, round(needed, 4) AS needed, round(least, 4) AS least, round((burn_in + needed) / least, 4) AS dependence FROM f""",
    "q22_histogram": f"WITH {_GRID} SELECT locus, bin, round(middle, 12) AS middle, n, round(density, 12) AS density FROM h",
    "q23_smooth": f"WITH {_SMOOTH} SELECT locus, bin, n, round(smoothed, 12) AS smoothed FROM s",
    "q24_mode_median": f"WITH {_MODE} SELECT locus, round(mode, 6) AS mode, round(median, 6) AS median, round(mean, 6) AS mean FROM m",
    "q25_hpd": f"""WITH {_HPD} SELECT locus, round(mode, 6) AS mode, round(median, 6) AS median, round(mean, 6) AS mean, round(in50_low, 6) AS in50_low, round(in50_high, 6) AS in50_high,
        round(in95_low, 6) AS in95_low, round(in95_high, 6) AS in95_high FROM m JOIN in50 USING (locus) JOIN in95 USING (locus)""",
    "q26_combine_loci": f"WITH {_COMBINE} SELECT bin, round(middle, 9) AS middle, round(log_density, 9) AS log_density, round(e / sum(e) OVER (), 9) AS prob FROM comb",
    "q27_ess": f"WITH {_ess('orders', 'o_orderpriority', 'o_orderkey', 'o_totalprice')} SELECT o_orderpriority, n, round(mean, 6) AS mean, round(r, 6) AS r, round(ess, 6) AS ess FROM e",
    "q28_ess_summary": f"""WITH {_ess('orders', 'o_orderstatus, o_orderpriority', 'o_orderkey', 'o_totalprice')}
        SELECT o_orderstatus, round(sum(ess), 6) AS ess, round(avg(r), 6) AS mean_r, round(min(ess), 6) AS least_ess, count(*) AS chains FROM e GROUP BY ALL""",
    "q29_gelman": """WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL),
        g AS (SELECT l_returnflag, avg(v) AS within, var_samp(m) AS between, avg(n) AS mean_n, count(*) AS chains FROM c GROUP BY ALL)
        SELECT l_returnflag, round(within, 8) AS within, round("between", 8) AS between, round(mean_n, 8) AS mean_n, chains,
        round(sqrt(((mean_n - 1) / mean_n * within + "between") / within), 8) AS r_hat FROM g""",
    "q30_covariance": " UNION ALL ".join(
        f"SELECT l_returnflag, '{x}' AS a, '{y}' AS b, round(covar_pop({x}, {y}), 5) AS cov_pop, round(covar_samp({x}, {y}), 5) AS cov_samp, round(corr({x}, {y}), 5) AS corr FROM lineitem GROUP BY ALL"
        for x, y in _PAIRS
    ),
    "q66_pairwise_gelman": """WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL),
        p AS (SELECT a.l_returnflag, a.l_linenumber AS chain_a, b.l_linenumber AS chain_b, (a.v + b.v) / 2 AS w, (a.n + b.n) / 2 AS n, (a.m - b.m) * (a.m - b.m) / 2 AS bt
              FROM c a JOIN c b ON a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber)
        SELECT l_returnflag, chain_a, chain_b, CASE WHEN w > 0 THEN round(sqrt(((n - 1) / n * w + bt) / w), 8) END AS r_hat FROM p""",
    "q67_mean_covariance": "SELECT l_returnflag, a, b, count(c) AS n_loci, round(avg(c), 6) AS mean_cov FROM (" + " UNION ALL ".join(
        f"SELECT l_returnflag, l_linenumber, '{x}' AS a, '{y}' AS b, covar_samp({x}, {y}) AS c FROM lineitem GROUP BY ALL"
        for x, y in (("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_discount"), ("l_discount", "l_tax"), ("l_tax", "l_tax"))
    ) + ") GROUP BY ALL",
    "q31_harmonic": f"WITH {_LL}, m AS (SELECT locus, min(l) AS m FROM ll GROUP BY locus) SELECT locus, round(max(m) - ln(avg(exp(m - l))), 7) AS harmonic FROM ll JOIN m USING (locus) GROUP BY locus",
    "q32_thermo": f"WITH {_THERMO} SELECT locus, round(thermo, 7) AS thermo FROM thermo",
    "q33_bezier": f"""WITH {_MEANS}, d AS (SELECT locus, beta AS b0, mean_l AS l0, lead(beta) OVER w AS b1, lead(mean_l) OVER w AS l1, row_number() OVER w AS n FROM means WINDOW w AS (PARTITION BY locus ORDER BY beta)),
        e AS (SELECT *, b0 AS x0, b0 AS x1, b0 + (b1 - b0) * 0.2 AS x2, b1 AS x3, l0 AS y0, l0 + (l1 - l0) * 0.8 AS y1, l1 AS y2, l1 AS y3 FROM d WHERE n = 1),
        p AS (SELECT *, i, i / 100.0::DOUBLE AS t FROM e, generate_series(0, 100) g(i)),
        q AS (SELECT locus, i, b0, b1, l0, l1, (1-t)**3*x0 + 3*(1-t)**2*t*x1 + 3*(1-t)*t**2*x2 + t**3*x3 AS x, (1-t)**3*y0 + 3*(1-t)**2*t*y1 + 3*(1-t)*t**2*y2 + t**3*y3 AS y FROM p),
        z AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM q WINDOW w AS (PARTITION BY locus ORDER BY i))
        SELECT locus, round(sum((x - px) * (y + py) / 2), 7) AS bezier_end, round((max(b1) - max(b0)) * (max(l0) + max(l1)) / 2, 7) AS chord_end FROM z GROUP BY locus""",
    "q34_stepping": f"""WITH {_COMBINE}, {_THERMO},
        nb AS (SELECT locus, beta, lead(beta) OVER (PARTITION BY locus ORDER BY beta) - beta AS step FROM means),
        sv AS (SELECT locus, beta, step * l AS v FROM ll JOIN nb USING (locus, beta) WHERE step IS NOT NULL),
        mx AS (SELECT locus, beta, max(v) AS m FROM sv GROUP BY ALL),
        st AS (SELECT locus, beta, max(m) + ln(sum(exp(v - m))) - ln(count(*)) AS s FROM sv JOIN mx USING (locus, beta) GROUP BY ALL),
        f AS (SELECT (SELECT max(log_density) FROM comb) + ln((SELECT sum(e) FROM comb)) + ln({WIDTH!r}::DOUBLE) AS factor)
        SELECT locus, round((SELECT sum(s) FROM st WHERE st.locus = thermo.locus), 6) AS stepping, round(thermo, 6) AS thermo,
        round((SELECT sum(thermo) FROM thermo) + (SELECT factor FROM f), 6) AS all_loci FROM thermo""",
    "q37_thin_accept": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
        SELECT event_type, count(*) AS trials, sum((value > 20)::INT)::BIGINT AS accepted, round(sum((value > 20)::INT) / count(*), 8) AS ratio FROM t WHERE n % 3 = 0 GROUP BY event_type""",
    "q38_quantiles": "SELECT o_orderpriority, "
    + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 6) AS q{n}" for p, n in ((0.025, "2_5"), (0.25, "25"), (0.5, "50"), (0.75, "75"), (0.975, "97_5")))
    + " FROM orders GROUP BY ALL",
    "q39_union_offset": """WITH d AS (SELECT l_linenumber AS locus, l_returnflag AS flag, l_quantity AS value FROM lineitem),
        u AS (SELECT locus, flag, value FROM d WHERE flag = 'A' UNION ALL SELECT locus + (SELECT max(locus) FROM d WHERE flag = 'A'), flag, value FROM d WHERE flag <> 'A')
        SELECT locus, count(*) AS n, sum(value) AS total, bool_or(flag = 'N') AS more FROM u GROUP BY locus""",
    "q47_moments": """SELECT l_returnflag AS locus, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(avg(l_extendedprice * l_extendedprice), 3) AS second_moment,
        round(stddev_samp(l_extendedprice), 3) AS sd FROM lineitem GROUP BY ALL""",
    "q48_kernel_density": f"""WITH {_GRID}, k AS (SELECT h.locus, x.bin, sum(h.n * 0.75 * (1 - ((x.bin - h.bin) / {HALF}.0::DOUBLE) ** 2)) AS w FROM h JOIN (SELECT DISTINCT bin FROM h) x ON abs(x.bin - h.bin) < {HALF} WHERE h.n > 0 GROUP BY ALL)
        SELECT locus, bin, round(w / sum(w) OVER (PARTITION BY locus) / {WIDTH!r}::DOUBLE, 12) AS density FROM k""",
    "q49_savitzky_golay": f"WITH {_GRID} SELECT locus, bin, round({_sg()}, 12) AS fitted FROM h WINDOW w AS (PARTITION BY locus ORDER BY bin)",
    "q50_warnings": f"""WITH {_HPD}, {_ess('orders', 'o_orderstatus, o_orderpriority', 'o_orderkey', 'o_totalprice')}
        SELECT locus, 'upper bounds near the prior maximum' AS warning FROM in50 JOIN in95 USING (locus) WHERE in50_high > 0.3 * {HIGH} AND in95_high > 0.3 * {HIGH}
        UNION ALL SELECT o_orderpriority, 'few effective samples' FROM e WHERE ess < 1000""",
    "q51_geweke": """WITH n AS (SELECT o_orderpriority AS k, o_totalprice AS v, o_orderkey AS o, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders),
        p AS (SELECT k, v, o, CASE WHEN n <= total * 0.1 THEN 'a' WHEN n > total * 0.5 THEN 'b' END AS part FROM n),
        x AS (SELECT *, v - avg(v) OVER (PARTITION BY k, part) AS x FROM p WHERE part IS NOT NULL),
        y AS (SELECT *, lag(x) OVER (PARTITION BY k, part ORDER BY o) AS px FROM x),
        r AS (SELECT k, part, count(*) AS n, avg(v) AS m, var_samp(v) AS var, sum(x * px) / sum(x * x) AS r FROM y GROUP BY ALL),
        e AS (SELECT *, var / greatest(n * (1 - r) / (1 + r), 1.0) AS se2 FROM r)
        SELECT k AS o_orderpriority, round((max(m) FILTER (part = 'a') - max(m) FILTER (part = 'b')) / sqrt(sum(se2)), 6) AS z FROM e GROUP BY k""",
    "q52_swaps": "SELECT l_returnflag, l_linenumber, count(*) AS trials, sum((l_tax < 0.03)::INT)::BIGINT AS accepted, round(sum((l_tax < 0.03)::INT) / count(*), 8) AS ratio FROM lineitem GROUP BY ALL",
    "q53_burnin": """WITH c AS (SELECT o_orderstatus, floor(o_orderkey / 1000)::BIGINT AS step, var_samp(o_totalprice) AS v FROM orders GROUP BY ALL),
        r AS (SELECT *, v / lag(v) OVER (PARTITION BY o_orderstatus ORDER BY step) AS ratio FROM c) SELECT o_orderstatus, min(step) AS step FROM r WHERE abs(ratio - 1) <= 0.02 GROUP BY o_orderstatus""",
}
QUERIES = {k: globals()[k] for k in SQL}
