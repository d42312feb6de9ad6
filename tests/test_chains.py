"""Diagnostics of long series against plain loops; the session's eight ranges cut every series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allelo.operators import chains, events, posterior


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    rows = [(k, i, float(v)) for k, n in (("a", 400), ("b", 7), (None, 90), ("one", 1), ("same", 30)) for i, v in enumerate(np.cumsum(rng.normal(size=n)) if k != "same" else np.ones(n))]
    rows += [("a", 1000, None), ("none", 0, None)]
    rng.shuffle(rows)
    return [(k if k is None else str(k), int(i), None if v is None else float(v)) for k, i, v in rows]


def _values(series):
    out = {}
    for k, i, v in sorted(series, key=lambda r: r[1]):
        if v is not None:
            out.setdefault(k, []).append(v)
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("lag", [1, 3])
def test_autocorrelation(spark, series, lag):
    d = spark.createDataFrame(series, "k string, i int, v double").repartition(5)
    got = {r.k: r for r in chains.autocorrelation(d, ["k"], ["i"], "v", lag).collect()}
    want = _values(series)
    assert set(got) == set(want)
    for k, v in want.items():
        x = v - v.mean()
        r = (x[lag:] * x[:-lag]).sum() / (x * x).sum() if (x * x).sum() > 0 else 1.0
        assert (got[k].n, got[k].mean, got[k].r) == pytest.approx((len(v), v.mean(), r)), k


def test_quantiles(spark, series):
    d = spark.createDataFrame(series, "k string, i int, v double")
    got = {r.k: r for r in chains.quantiles(d, ["k"], "v", (0.0, 0.3, 1.0)).collect()}
    for k, v in _values(series).items():
        assert list(got[k])[1:] == pytest.approx(list(np.quantile(v, [0, 0.3, 1]))), k
    assert list(got["none"])[1:] == [None] * 3


def test_numbers(spark, series):
    d = spark.createDataFrame(series, "k string, i int, v double")
    got = pd.DataFrame([r.asDict() for r in chains.numbered(d, ["k"], ["i"], "v").collect()]).fillna({"k": "null"})
    for k, g in got.groupby("k"):
        g = g.sort_values("i")
        assert g["_n"].tolist() == list(range(1, len(g) + 1)) and set(g["_all"]) == {g["v"].notna().sum()}, k


def test_outliers(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 9.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "k string, v double")
    assert sorted(map(str, map(tuple, events.drop_outliers(d, ["k"], "v", 1.5).collect()))) == sorted(["(None, 1.0)", "('a', 1.0)", "('a', 2.0)"])
    assert events.drop_outliers(d.limit(0), ["k"], "v").count() == 0


def test_skyline_deviations(spark):
    rows = [(1, i, v, w) for i, (v, w) in enumerate([(2.0, 1.0), (4.0, 0.5), (3.0, 1.0), (7.0, 0.25)])] + [(2, 9, 5.0, 1.0), (3, 1, 1.0, 0.0)]
    d = spark.createDataFrame(rows, "bin int, i int, v double, w double")
    got = {r.bin: r for r in events.skyline_deviations(d, [], ["i"], "v", "w").collect()}
    v, w = np.array([2.0, 4, 3, 7]), np.array([1, 0.5, 1, 0.25])
    mean, x = (v * w).sum() / w.sum(), v - v.mean()
    r = (x[1:] * x[:-1]).sum() / (x * x).sum()
    ess = 4 * (1 - r) / (1 + r)
    var = (w * (v - mean) ** 2).sum() / ((ess - 1) * w.mean())
    assert list(got[1])[1:] == pytest.approx([mean, np.sqrt(var) / 2, r, ess, w.mean(), w.std(ddof=1), 4])
    assert set(got) == {1, 2} and got[2].sd is None and got[2].ess == 0


def test_autocorrelations(spark, series):
    d = spark.createDataFrame(series, "k string, i int, v double")
    got = {(r.k, r.lag): (r.n, r.r) for r in chains.autocorrelations(d, ["k"], ["i"], "v", (2, 9)).collect()}
    for k, v in _values(series).items():
        x = v - v.mean()
        for lag in (2, 9):
            assert got[k, lag] == pytest.approx((len(v), (x[lag:] * x[:-lag]).sum() / (x * x).sum() if (x * x).sum() > 0 else 1.0)), (k, lag)


def test_raftery_lewis(spark, series):
    d = spark.createDataFrame(series, "k string, i int, v double")
    got = {r.k: r for r in chains.raftery_lewis(d, ["k"], ["i"], "v", q=0.3).collect()}
    for k in ("a", None):
        v = _values(series)[k]
        low = v <= np.quantile(v, 0.3)
        a, b = low[1:][~low[:-1]].mean(), (~low)[1:][low[:-1]].mean()
        z = 1.959963984540054
        burn_in = np.ceil(np.log(0.001 * (a + b) / max(a, b)) / np.log(abs(1 - a - b)))
        needed, least = (2 - a - b) * a * b / (a + b) ** 3 * (z / 0.005) ** 2, z * z * 0.21 / 0.005**2
        assert list(got[k])[1:] == pytest.approx([burn_in, needed, least, (burn_in + needed) / least]), k
    assert got["same"].needed is None and "one" not in got and "none" not in got


def test_running_moments(spark, series):
    d = spark.createDataFrame(series, "k string, i int, v double")
    got = {(r.k, r.block): r for r in chains.running_moments(d, ["k"], "i", "v", 50).collect()}
    v = _values(series)["a"]
    assert [b for k, b in sorted(got, key=str) if k == "a"] == list(range(8))
    for b in range(8):
        x = v[: 50 * (b + 1)]
        assert list(got["a", b])[2:] == pytest.approx([len(x), x.mean(), x.std(ddof=1)])
    assert got["one", 0].sd is None and ("none", 0) not in got


def test_best_state(spark):
    rows = [(None, 1, 2.0), (None, 2, 5.0), ("a", 3, 7.0), ("a", 1, 7.0), ("a", 2, None), ("b", 1, None)]
    got = chains.best_state(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], ["i"], "v").collect()
    assert sorted(map(str, map(tuple, got))) == ["('a', 1, 7.0)", "(None, 2, 5.0)"]


def test_savitzky_golay_edges(spark):
    y = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    h = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)] + [("short", i, 1.0) for i in range(3)], "k string, bin int, v double")
    got = {(r.k, r.bin): r.fitted for r in posterior.savitzky_golay(h, ["k"], "v", 2, edges=True).collect()}
    for i in range(8):
        m = min(max(i, 2), 5)
        assert got["a", i] == pytest.approx(np.polyval(np.polyfit(range(m - 2, m + 3), y[m - 2 : m + 3], 2), i))
    assert all(got["short", i] is None for i in range(3))


def test_event_counts_and_divergence(spark):
    d = spark.createDataFrame([(1, "x", "x"), (1, "x", "y"), (1, "x", "y"), (2, None, "y"), (2, "y", None)], "k int, a string, b string")
    assert sorted(map(tuple, events.event_counts(d, ["k"], "a", "b").collect())) == [(1, "x", "x", 1, True), (1, "x", "y", 2, False)]
    models = spark.createDataFrame([("x", "y", 0.5)], "a string, b string, mean double")
    got = {(r.a, r.b): (r["mean"], r.diverges) for r in events.divergence_models(d.select("a", "b").distinct(), models, ["a", "b"]).collect()}
    assert got["x", "y"] == (0.5, True) and got["x", "x"] == (None, False) and len(got) == 4


def _zero_by_equations(v, orders):
    """Spectral density at zero of the best autoregression, each order by solving its equations."""
    x, n = v - v.mean(), len(v)
    if n <= orders + 1 or not (x * x).sum() > 0:
        return None
    r = np.array([(x[k:] * x[: n - k]).sum() for k in range(orders + 1)]) / (x * x).sum()
    best = []
    for k in range(orders + 1):
        f = np.linalg.solve(r[np.abs(np.subtract.outer(range(k), range(k)))], r[1 : k + 1]) if k else np.zeros(0)
        e = 1 - f @ r[1 : k + 1]
        best.append((n * np.log(e) + 2 * k, k, (x * x).sum() * e / (n - k - 1) / (1 - f.sum()) ** 2))
    return min(best)[2]


def _heidelberger_welch(v, orders, eps=0.1):
    n, late = len(v), _zero_by_equations(v[len(v) // 2 :], orders)
    statistic = None
    for j in range(6) if late else ():
        y = v[n * j // 10 :]
        bridge = np.cumsum(y) - np.arange(1, len(y) + 1) * y.mean()
        statistic = (bridge**2).sum() / len(y) ** 2 / late
        if statistic < chains.BRIDGE_LIMIT:
            s = _zero_by_equations(y, orders)
            half = None if s is None else 1.959963985 * np.sqrt(s / len(y))
            return n, n * j // 10, statistic, y.mean(), half, True, half is not None and bool(half <= eps * abs(y.mean()))
    return n, None, statistic, None, None, False, False


@pytest.mark.parametrize("orders", [1, 4])
def test_heidelberger_welch(spark, series, orders):
    """A walk, short, constant, empty and nameless series, noise, correlated noise, noise after a false start, and with a trend."""
    rng = np.random.default_rng(11)
    noise = rng.normal(10, 1, 500)
    around = [rng.normal()]
    for e in rng.normal(size=699):
        around.append(0.8 * around[-1] + e)
    more = {"noise": noise, "around": np.array(around) + 3, "start": np.where(np.arange(500) < 120, noise + 6, noise), "trend": noise + 0.006 * np.arange(500)}
    rows = series + [(k, i, float(x)) for k, v in more.items() for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in chains.heidelberger_welch(d, ["k"], ["i"], "v", orders).collect()}
    want = {k: _heidelberger_welch(v, orders) for k, v in _values(rows).items()}
    assert set(got) == set(want)
    for k, w in want.items():
        for g, x in zip(got[k], w, strict=True):
            assert g is None if x is None else g == pytest.approx(x, rel=1e-6), (k, got[k], w)
    assert want["start"][1] > 0 and want["noise"][1] == 0 and want["noise"][6] and not want["trend"][5]
    assert chains.heidelberger_welch(d.limit(0), ["k"], ["i"], "v", orders).count() == 0


def test_no_table_of_all_rows_is_broadcast(spark, monkeypatch):
    """Stored rows look small (they compress well): what they are joined to is stored too, a row a range, so that Spark sees
    which of both is the small one. Successors are no join of all rows with themselves."""
    d = spark.range(60000).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    made = []
    store = chains.stored
    monkeypatch.setattr(chains, "stored", lambda df: made.append(store(df)) or made[-1])
    for run in (chains.numbered, chains.neighbours):
        made.clear()
        run(d, ["k"], ["i"], "v")
        assert made[0].count() == 60000 and len(made) == 2 and made[1].count() <= 8
    made.clear()
    chains.raftery_lewis(d, ["k"], ["i"], "v", q=0.3)
    assert sorted(m.count() > 8 for m in made) == [False] * 3 + [True] * 2  # all rows by value and by order
