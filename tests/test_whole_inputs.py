"""Records, lines and trees of any length, the grammar of the sites line, scans over ranges, draws."""

import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelo.functions.special import digamma_col, harmonic_col, trigamma_col
from allelo.operators import chains, events, frequencies, marginal
from allelo.sources import converters, native, newick
from allelo.sources.lines import numbered


def shape(line, **k):
    return [(p.locus, p.sublocus, p.kind, p.length, p.start) for p in native.parse_sites(line, **k)]


def test_sites_grammar():
    assert shape("(s200 s800) (n5) m1") == [(1, 1, "s", 200, None), (1, 2, "s", 800, None), (2, 1, "n", 5, None), (3, 1, "m", 1, None)]
    assert shape("(12s5) (40 s5 s7)") == [(1, 1, "s", 5, 12), (2, 1, "s", 5, 40), (2, 2, "s", 7, None)]
    assert shape("10 20 30") == [(i + 1, 1, "s", 10 * (i + 1), None) for i in range(3)]
    assert shape("[3](s100) (n4)") == [(1, 1, "s", 33, 0), (2, 1, "s", 33, 33), (3, 1, "s", 34, 66), (4, 1, "n", 4, 100)]
    assert shape("(s10) [4o5_2](s103)") == [(1, 1, "s", 10, None), (2, 1, "s", 5, 11), (2, 2, "s", 5, 36), (3, 1, "s", 5, 61), (3, 2, "s", 5, 86)]
    drawn = shape("[6r7](s60)", seed=3)
    assert drawn == shape("[6r7](s60)", seed=3) != shape("[6r7](s60)", seed=4)
    assert all(a[4] + 7 <= b[4] for a, b in zip(drawn, drawn[1:], strict=False)) and drawn[-1][4] + 7 <= 60
    whole = shape("[5r0](s90)")
    assert whole[0][4] == 0 and sum(p[3] for p in whole) == 90 and all(a[4] + a[3] == b[4] for a, b in zip(whole, whole[1:], strict=False))
    for wrong in ("(0 s5o2)", "(z5)", "(s)", "[2x3](s9)", "[5o9](s20)"):
        with pytest.raises(ValueError):
            native.parse_sites(wrong)


def test_sliced_sequences(spark, tmp_path):
    p = tmp_path / "infile"
    p.write_text("s 1 3 slices\n[2o3](s10) (s2)\n2 pop\n" + "a         ACGTACGTACGG\n" + "b         TTTTTCCCCCAA\n")
    got = {(r["ind_name"], r["locus"]): r["value"] for r in native.read_genotypes(spark, str(p)).collect()}
    assert got == {("a", 1): "ACG", ("a", 2): "CGT", ("a", 3): "GG", ("b", 1): "TTT", ("b", 2): "CCC", ("b", 3): "AA"}


def test_population_lines_among_numeric_names(spark, tmp_path):
    p = tmp_path / "infile"
    sizes = [3, 1, 4, 2, 5]
    lines = ["m 5 1 . numbers"]
    for k, n in enumerate(sizes):
        lines += [f"{n} pop{k}" if k else f"{n}"] + [f"{i:<10}{i}.{i + 1}" for i in range(n)]
    p.write_text("\n".join(lines) + "\n")
    got = native.population_lines(numbered(spark, str(p), r"^\s*(#|$)"), 1, 5).orderBy("pop").collect()
    assert [(r["pop"], r["pop_name"], r["size"]) for r in got] == [(1, "population 1", 3), (2, "pop1", 1), (3, "pop2", 4), (4, "pop3", 2), (5, "pop4", 5)]
    assert native.read_genotypes(spark, str(p)).count() == 2 * sum(sizes)
    p.write_text("\n".join(lines[:5] + ["oops"] + lines[6:]) + "\n")
    with pytest.raises(ValueError):
        native.read_genotypes(spark, str(p))


def test_fasta_record_of_over_a_million_lines(spark, tmp_path):
    n = 1_100_000
    p = tmp_path / "x.fa"
    p.write_text(">one\n" + "ACGT\n" * n + ">" + "n" * 70 + "\nAC\n")
    got = converters.read_fasta(spark, str(p)).select("name", F.length("seq").alias("n")).orderBy("nr").collect()
    assert [tuple(r) for r in got] == [("one", 4 * n), ("n" * 70, 2)]


def test_deep_newick_round_trip():
    text = "(" * 3000 + "t0:1" + "".join(f",t{i}:1):1" for i in range(1, 3001))
    text = text.rsplit(":", 1)[0] + ";"
    edges = newick.parse(text)
    assert len(edges) == 6001 and newick.parse(newick.write(edges)) == edges


def test_scans_over_ranges(spark):
    d = spark.range(3000).select((F.col("id") % 7 == 0).cast("int").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    by = W.partitionBy("k").orderBy("i")
    want = d.withColumns({"_prev": F.lag("v").over(by), "_next": F.lead("v").over(by), "_ends": F.lead("i").over(by).isNull()})
    key = lambda x: sorted(map(tuple, x.select("k", "i", "_prev", "_next", "_ends").collect()), key=lambda r: r[1])
    assert key(chains.neighbours(d, ["k"], ["i"], "v")) == key(want)
    up = d.withColumn("s", F.sum(F.coalesce("v", F.lit(0.0))).over(by))
    got = chains.cumulated(d, ["k"], ["i"], F.coalesce("v", F.lit(0.0)), "s")
    assert sorted(map(tuple, got.select("i", "s").collect())) == sorted(map(tuple, up.select("i", "s").collect()))
    thin = d.withColumn("n", F.row_number().over(by)).where("n % 5 = 0")
    assert sorted(r["i"] for r in chains.thin(d, ["k"], ["i"], 5).collect()) == sorted(r["i"] for r in thin.collect())
    one = events.intervals(d.where("k = 0"), ["k"], "i", "v").where("is_last").collect()
    assert [r["i"] for r in one] == [2999]


def test_polygamma_and_harmonic_numbers(spark):
    n = [1, 2, 3, 10, 1000, 300_000_000]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select("n", harmonic_col(F.col("n")).alias("a"), harmonic_col(F.col("n"), 2).alias("b"), digamma_col(F.col("n")).alias("d"), trigamma_col(F.col("n")).alias("t")).collect()
    for r in rows[:5]:
        assert r["a"] == pytest.approx(sum(1 / k for k in range(1, r["n"])), abs=1e-12)
        assert r["b"] == pytest.approx(sum(1 / k**2 for k in range(1, r["n"])), abs=1e-12)
    assert rows[5]["a"] == pytest.approx(math.log(3e8) + 0.57721566490153286 - 1 / 6e8, abs=1e-9) and rows[0]["t"] == pytest.approx(math.pi**2 / 6)


def test_log_sums_of_far_apart_values(spark):
    d = spark.createDataFrame([("a", -5000.0), ("a", -5001.0), ("a", None), ("b", 900.0), ("b", -900.0), ("c", 0.0)], "k string, v double")
    got = {r["k"]: (r["s"], r["n"]) for r in marginal.log_sum_exp(d, ["k"], "v", "s", "n").collect()}
    assert got["a"] == (pytest.approx(-5000 + math.log(1 + math.exp(-1))), 2) and got["b"] == (pytest.approx(900.0), 2) and got["c"] == (0.0, 1)


def test_weighted_draws(spark):
    d = spark.range(4000).select((F.col("id") % 400).alias("g"), F.col("id").alias("i"), F.when(F.col("id") < 1200, F.lit(9.0)).when(F.col("id") >= 3600, F.lit(0.0)).otherwise(F.lit(1.0)).alias("w"))
    got = frequencies.weighted_subset(d, ["g"], "i", "w", 1, "seed").collect()
    assert len(got) == 400 and all(r["w"] > 0 for r in got)
    heavy = sum(r["w"] == 9 for r in got) / 400  # 27 of 33
    assert abs(heavy - 27 / 33) < 0.08
    again = frequencies.weighted_subset(d.repartition(7), ["g"], "i", "w", 1, "seed").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_partial_correlations_of_dependent_columns_are_null(spark):
    d = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"), (F.col("id") * 7 % 5).alias("c"))
    assert all(r["partial"] is None for r in chains.partial_correlations(d, ["k"], ["a", "b", "c"]).collect())


def test_em_frequencies_share_out_ambiguous_symbols(spark):
    masks = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("n", [1.0, 1.0])], "s string, mask array<double>")
    counts = spark.createDataFrame([("x", "a", 30), ("x", "b", 10), ("x", "n", 20), ("x", "z", 99), ("y", "a", 5)], "k string, s string, n long")
    got = {r["k"]: r["f"] for r in frequencies.em_frequencies(counts, "k", "s", "n", masks, 60).collect()}
    assert got["x"] == pytest.approx([0.75, 0.25]) and got["y"] == pytest.approx([1.0, 0.0], abs=1e-9)


def test_removed_tables_leave_no_name(spark):
    from allelo import store

    with store.made_here() as folders:
        d = store.bucketed(spark.range(10), "id")
        assert d.count() == 10
    before = {t.name for t in spark.catalog.listTables()}
    store.remove(spark, folders)
    assert len(before - {t.name for t in spark.catalog.listTables()}) == 1 and not folders
