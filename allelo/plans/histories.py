"""Queries on event times and assignments: q17 to q21, q35, q36, q40, q54 to q63, q68, q69, q77, q78."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assignment as asg
from ..operators import events as ev
from ..operators.chains import neighbours
from .common import rounded, table

DAY = 86400.0
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _ages(spark, sf):
    """Events with their age in seconds since the first one."""
    e = table(spark, sf, "events").withColumn("t", F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / 1e6)
    return e.crossJoin(F.broadcast(e.agg(F.min("t").alias("t0")))).withColumn("age", F.col("t") - F.col("t0"))  # one row


def _times(spark, sf):
    return ev.intervals(_ages(spark, sf), ["user_id"], "age", "event_id")


def _event_histogram(spark, sf):
    return ev.event_histogram(_times(spark, sf), ["event_type"], "age", DAY, F.col("is_last"))


def q17_event_histogram(spark, sf):
    return _event_histogram(spark, sf)


def q18_event_table(spark, sf):
    return rounded(ev.event_table(_event_histogram(spark, sf), ["event_type"], "n_all", DAY), 5)


def _over_hours(spark, sf):
    return ev.over_bins(_times(spark, sf).where("length > 0").withColumn("locus", F.pmod("user_id", F.lit(4))), "start", "age", 6 * 3600.0)


def q19_interval_overlap(spark, sf):
    return rounded(ev.skyline(_over_hours(spark, sf), ["locus"], "value", "part"), 6)


def q20_lineages(spark, sf):
    delta = F.when(F.col("event_type") == "purchase", -1).when(F.col("event_type") == "view", 1).otherwise(0)
    return ev.lineages(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], delta).select("event_id", "user_id", "k")


def q21_skyline_combine(spark, sf):
    s = ev.skyline(_over_hours(spark, sf), ["locus"], "value", "part")
    return rounded(ev.combine_skylines(ev.trim_tail(s, ["locus"], "weight"), []), 6)


def _visits(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("ind"), F.date_trunc("week", "ts").cast("date").alias("locus"), F.col("event_type").alias("pop"))


def q35_assignment(spark, sf):
    a = asg.assignment(_visits(spark, sf), "ind", "locus", "pop")
    return rounded(asg.assignment_all_loci(a, "ind", "pop"), 8)


def q36_haplotypes(spark, sf):
    bits = F.transform(F.slice("embedding", 1, 4), lambda x: F.when(x > 0, "1").otherwise("0"))
    d = table(spark, sf, "embeddings").withColumn("h", F.array_join(bits, "")).withColumn("c", F.translate("h", "01", "10"))
    return rounded(asg.haplotype_shares(d, ["label"], "h", "c"))


def q40_coalescent_prior(spark, sf):
    d = _times(spark, sf).withColumn("k", F.pmod("event_id", F.lit(5)) + 2).withColumn("length", F.col("length") / DAY)
    kind = F.when(F.col("event_type") == "purchase", "i").when(F.col("event_type") == "click", "m").otherwise("t")
    return rounded(ev.coalescent_log_density(d.withColumn("type", kind), ["user_id"], "length", "k", "type", 0.5, 2.0), 6)


def q54_event_frequencies(spark, sf):
    h = ev.event_frequencies(_event_histogram(spark, sf), ["event_type"], "n_all")
    return rounded(h.groupBy("bin").agg(F.avg("freq").alias("mean_freq"), F.count("*").alias("kinds")))


def q55_outliers(spark, sf):
    d = ev.drop_outliers(table(spark, sf, "events"), ["event_type"], "value", 2.0)
    return rounded(d.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), 6)


def q56_event_sums(spark, sf):
    d = _times(spark, sf).withColumn("k", F.pmod("event_id", F.lit(5)) + 2).withColumn("length", F.col("length") / DAY)
    return rounded(ev.event_sums(d, ["user_id"], "length", "k", "event_type"), 5)


def q57_tree_length(spark, sf):
    return rounded(ev.tree_length(_times(spark, sf), ["user_id"], "start", "age"), 4)


def q58_first_event(spark, sf):
    return ev.first_event(table(spark, sf, "events"), ["user_id"], "ts", "event_type").select("user_id", "event_type")


def q59_tip_dates(spark, sf):
    tips = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    dates = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.expr(f"timestampdiff(SECOND, {EPOCH}, o_orderdate)") / DAY).alias("date"))
    return rounded(ev.tip_dates(tips, dates, ["c_custkey"], "date", forward=True), 6)


def q60_error_rates(spark, sf):
    return rounded(asg.error_rates(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_tax"), 9)


def q61_population_frequency(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("locus"), F.col("c_nationkey").alias("pop"))
    pops = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pop"))
    return rounded(asg.population_frequency(d, ["locus"], "pop", pops))


def q62_key_counts(spark, sf):
    return asg.count_keys(table(spark, sf, "part"), "p_type")


def q63_expected_theta(spark, sf):
    d = _times(spark, sf).where("length > 0").withColumn("k", F.pmod("event_id", F.lit(5)) + 2).withColumn("t", F.col("length") / DAY)
    return rounded(
        d.groupBy("event_type").agg(F.avg(ev.expected_theta(F.col("t"), F.col("k"))).alias("theta"), F.avg(F.log(ev.expected_rate(F.col("t"), F.col("k")))).alias("log_rate")), 6
    )


def q68_skyline_deviations(spark, sf):
    return rounded(ev.skyline_deviations(_over_hours(spark, sf), ["locus"], ["event_id"], "value", "part"), 7)


def q69_scaled_rates(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("a")).agg(F.avg("c_acctbal").alias("rate"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("b"))
    rates = c.crossJoin(b).where("a <> b")  # all pairs of a dimension
    weights = ev.geographic_weights(rates.where((F.col("a") + F.col("b")) % 3 != 0).select("a", "b", F.abs(F.col("a") - F.col("b")).cast("double").alias("d")), "d")
    return rounded(ev.scaled_rates(rates, weights, ["a", "b"], "rate"), 6)


def q77_event_counts(spark, sf):
    d = neighbours(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    d = d.withColumn("to", F.col("_next")).withColumn("group", F.pmod("user_id", F.lit(4)))
    return ev.event_counts(d, ["group"], "event_type", "to")


def q78_divergence_models(spark, sf):
    n = table(spark, sf, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("b"), "n_regionkey"), "n_regionkey").where("a <> b").select("a", "b")
    models = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("a"), F.pmod(F.col("s_nationkey") + 1, F.lit(25)).alias("b"))
    models = models.agg(F.avg("s_acctbal").alias("mean"), F.stddev_samp("s_acctbal").alias("sd"))
    return rounded(ev.divergence_models(pairs, models, ["a", "b"]), 6)


_AGE = """a AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE - (SELECT min(epoch_us(ts) / 1e6::DOUBLE) FROM events) AS age FROM events),
i AS (SELECT *, coalesce(lag(age) OVER w, 0.0) AS start, age - coalesce(lag(age) OVER w, 0.0) AS length, lead(age) OVER w IS NULL AS is_last FROM a WINDOW w AS (PARTITION BY user_id ORDER BY age, event_id))"""
_EH = f"{_AGE}, h AS (SELECT event_type, floor(age / 86400.0)::BIGINT AS bin, count(*) AS n_all, sum(is_last::INT)::BIGINT AS n_mrca FROM i GROUP BY ALL)"
_BINS = f"""{_AGE}, l AS (SELECT user_id % 4 AS locus, event_id, value, start, age FROM i WHERE length > 0),
p AS (SELECT locus, event_id, value, b AS bin, (least(age, (b + 1) * 21600.0::DOUBLE) - greatest(start, b * 21600.0::DOUBLE)) / 21600.0::DOUBLE AS part
  FROM l, LATERAL (SELECT unnest(generate_series(floor(start / 21600.0)::BIGINT, greatest(floor(start / 21600.0)::BIGINT, ceil(age / 21600.0)::BIGINT - 1))) AS b)),
s AS (SELECT locus, bin, sum(part * value) / sum(part) AS mean, greatest(sum(part * value * value) / sum(part) - (sum(part * value) / sum(part)) ** 2, 0) AS var, sum(part) AS weight, count(*) AS n
  FROM p WHERE part > 0 GROUP BY ALL)"""

SQL = {
    "q17_event_histogram": f"WITH {_EH} SELECT * FROM h",
    "q18_event_table": f"""WITH {_EH}, m AS (SELECT *, (bin + 0.5) * 86400.0::DOUBLE AS mid, sum(n_all) OVER (PARTITION BY event_type ORDER BY bin) * 2 >= sum(n_all) OVER (PARTITION BY event_type) AS half FROM h),
        t AS (SELECT event_type, sum(n_all * mid) / sum(n_all) AS mean, sqrt(greatest(sum(n_all * mid * mid) / sum(n_all) - (sum(n_all * mid) / sum(n_all)) ** 2, 0)) AS sd,
        min(mid) FILTER (half) AS median, sum(n_all)::BIGINT AS total FROM m GROUP BY ALL)
        SELECT event_type, round(mean, 5) AS mean, round(sd, 5) AS sd, round(median, 5) AS median, total, round(total / sum(total) OVER (), 5) AS share FROM t""",
    "q19_interval_overlap": f"WITH {_BINS} SELECT locus, bin, round(mean, 6) AS mean, round(var, 6) AS var, round(weight, 6) AS weight, n FROM s",
    "q20_lineages": """SELECT event_id, user_id, sum(CASE event_type WHEN 'purchase' THEN -1 WHEN 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS k FROM events""",
    "q21_skyline_combine": f"""WITH {_BINS}, c AS (SELECT bin, sum(mean * weight) / sum(weight) AS mean, sum(var * weight) / sum(weight) AS var, sum(weight) AS weight FROM s GROUP BY bin)
        SELECT bin, round(mean, 6) AS mean, round(var, 6) AS var, round(weight, 6) AS weight, round(sqrt(var), 6) AS sd, round(weight / sum(weight) OVER (), 6) AS share FROM c""",
    "q35_assignment": """WITH v AS (SELECT user_id AS ind, date_trunc('week', ts)::DATE AS locus, event_type AS pop FROM events),
        n AS (SELECT ind, locus, pop, count(*) AS visits FROM v GROUP BY ALL), t AS (SELECT ind, locus, sum(visits) AS n FROM n GROUP BY ALL),
        g AS (SELECT ind, pop, ln(greatest(coalesce(visits, 0) / t.n, 1e-20)) AS lp FROM t CROSS JOIN (SELECT DISTINCT pop FROM v) LEFT JOIN n USING (ind, locus, pop)),
        s AS (SELECT ind, pop, sum(lp) AS s FROM g GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY ind)) AS e FROM s)
        SELECT ind, pop, round(e / sum(e) OVER (PARTITION BY ind), 8) AS p FROM e""",
    "q36_haplotypes": """WITH h AS (SELECT label, array_to_string(list_transform(embedding[1:4], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS h FROM embeddings),
        p AS (SELECT label, least(h, translate(h, '01', '10')) AS pair, count(*) AS n FROM h GROUP BY ALL)
        SELECT label, pair, n, round(n / sum(n) OVER (PARTITION BY label), 8) AS share FROM p""",
    "q40_coalescent_prior": f"""WITH {_AGE}, d AS (SELECT user_id, event_type, length / 86400.0::DOUBLE AS t, event_id % 5 + 2 AS k FROM i)
        SELECT user_id, round(sum(-t * (k * (k - 1) / 0.5::DOUBLE + k * 2.0::DOUBLE) + CASE event_type WHEN 'purchase' THEN ln(4.0::DOUBLE) WHEN 'click' THEN ln(2.0::DOUBLE) ELSE 0 END), 6) AS log_density FROM d GROUP BY user_id""",
    "q54_event_frequencies": f"WITH {_EH}, f AS (SELECT bin, n_all / sum(n_all) OVER (PARTITION BY event_type) AS freq FROM h) SELECT bin, round(avg(freq), 8) AS mean_freq, count(*) AS kinds FROM f GROUP BY bin",
    "q55_outliers": """WITH m AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM m WHERE value <= m * 2 GROUP BY event_type""",
    "q56_event_sums": f"""WITH {_AGE}, d AS (SELECT user_id, event_type, length / 86400.0::DOUBLE AS t, event_id % 5 + 2 AS k FROM i)
        SELECT user_id, round(sum(k * (k - 1) * t), 5) AS kt, round(sum(k * t), 5) AS km, count(*) AS events FROM d GROUP BY user_id""",
    "q57_tree_length": f"WITH {_AGE} SELECT user_id, round(sum(age - start), 4) AS tree_length FROM i GROUP BY user_id",
    "q58_first_event": "SELECT user_id, arg_min(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id",
    "q59_tip_dates": """WITH d AS (SELECT o_custkey AS c_custkey, max(epoch(date_trunc('second', o_orderdate)) / 86400.0::DOUBLE) AS date FROM orders GROUP BY ALL)
        SELECT c_custkey, c_nationkey, round(coalesce((SELECT max(date) FROM d) - date, 0.0), 6) AS date FROM customer LEFT JOIN d USING (c_custkey)""",
    "q60_error_rates": "SELECT l_returnflag, l_linestatus, round(avg(l_tax), 9) AS mean, round(stddev_samp(l_tax), 9) AS sd FROM lineitem GROUP BY ALL",
    "q61_population_frequency": """WITH n AS (SELECT c_mktsegment AS locus, c_nationkey AS pop, count(*) AS n FROM customer GROUP BY ALL),
        w AS (SELECT l.locus, n_nationkey AS pop, greatest(coalesce(n, 0)::DOUBLE, 0.1::DOUBLE) AS w FROM (SELECT DISTINCT c_mktsegment AS locus FROM customer) l CROSS JOIN nation LEFT JOIN n ON n.locus = l.locus AND n.pop = n_nationkey)
        SELECT locus, pop, round(w / sum(w) OVER (PARTITION BY locus), 8) AS freq FROM w""",
    "q62_key_counts": "SELECT p_type, count(*) AS n FROM part GROUP BY p_type",
    "q63_expected_theta": f"""WITH {_AGE}, d AS (SELECT event_type, length / 86400.0::DOUBLE AS t, event_id % 5 + 2 AS k FROM i WHERE length > 0)
        SELECT event_type, round(avg(t * k * (k - 1)), 6) AS theta, round(avg(ln(1.0::DOUBLE / (t * k))), 6) AS log_rate FROM d GROUP BY event_type""",
    "q68_skyline_deviations": f"""WITH {_BINS}, x AS (SELECT *, value - avg(value) OVER (PARTITION BY locus, bin) AS x FROM p WHERE part > 0),
        y AS (SELECT *, lag(x) OVER (PARTITION BY locus, bin ORDER BY event_id) AS px FROM x),
        e AS (SELECT locus, bin, sum(part * value) / sum(part) AS mean, greatest(sum(part * value * value) / sum(part) - (sum(part * value) / sum(part)) ** 2, 0) AS var,
          CASE WHEN sum(x * x) > 0 THEN coalesce(sum(x * px), 0.0) / sum(x * x) ELSE 1.0 END AS r, avg(part) AS mean_weight, stddev_samp(part) AS weight_sd, count(*) AS n FROM y GROUP BY ALL),
        f AS (SELECT *, n * (1 - r) / (1 + r) AS ess FROM e)
        SELECT locus, bin, round(mean, 7) AS mean, round(CASE WHEN ess > 1 + 1e-6 THEN sqrt(var / (ess - 1)) END, 7) AS sd, round(r, 7) AS r, round(ess, 7) AS ess,
        round(mean_weight, 7) AS mean_weight, round(weight_sd, 7) AS weight_sd, n FROM f""",
    "q69_scaled_rates": """WITH c AS (SELECT c_nationkey AS a, avg(c_acctbal) AS rate FROM customer GROUP BY ALL)
        SELECT a, n_nationkey AS b, round(rate * CASE WHEN (a + n_nationkey) % 3 <> 0 THEN 1.0::DOUBLE / greatest(abs(a - n_nationkey)::DOUBLE, 1e-6::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS rate
        FROM c, nation WHERE a <> n_nationkey""",
    "q77_event_counts": """WITH d AS (SELECT user_id % 4 AS "group", event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "to" FROM events)
        SELECT "group", event_type, "to", count(*) AS n, event_type = "to" AS within FROM d WHERE event_type IS NOT NULL AND "to" IS NOT NULL GROUP BY ALL""",
    "q78_divergence_models": """WITH m AS (SELECT s_nationkey AS a, (s_nationkey + 1) % 25 AS b, avg(s_acctbal) AS mean, stddev_samp(s_acctbal) AS sd, count(*) AS c FROM supplier GROUP BY 1, 2)
        SELECT x.n_nationkey AS a, y.n_nationkey AS b, round(mean, 6) AS mean, round(sd, 6) AS sd, c IS NOT NULL AS diverges
        FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey LEFT JOIN m ON m.a = x.n_nationkey AND m.b = y.n_nationkey""",
}
QUERIES = {k: globals()[k] for k in SQL}
