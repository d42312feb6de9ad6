"""The near-duplicate stage where one document is the partner of very many."""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from allelo.llm import components, simhash
from allelo.store import bucketed, stored


def test_rows_of_a_hot_id_are_copied_for_parts_of_its_pairs(spark):
    of = bucketed(spark.range(3000).select(F.col("id").alias("u"), F.concat(F.lit("t"), "id").alias("tu")), "u")
    hot = spark.range(1, 2000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    pairs = stored(hot.union(spark.range(2000, 2999).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))))
    got = simhash._beside(pairs, "u", "v", of, 50)
    assert sorted(map(tuple, got.select("u", "v", "tu").collect())) == sorted((r["u"], r["v"], f"t{r['u']}") for r in pairs.collect())
    sizes = [r["n"] for r in got.where("u = 0").groupBy(F.pmod(F.xxhash64("v"), F.lit(40))).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 40 and max(sizes) <= 2 * sum(sizes) / len(sizes)  # forty parts of near-equal size


def test_ranks_are_bounded(spark, monkeypatch):
    docs = spark.range(50).select(F.lit(" ".join(f"w{i}" for i in range(30))).alias("text"), F.col("id").alias("doc_id")).withColumn("text", F.concat("text", F.lit(" "), "doc_id"))
    monkeypatch.setattr(simhash, "RANKED", 7)
    words, seen = simhash._common_shingles(docs)
    assert len(words) == 7 and (seen == 50).all() and (words[1:] > words[:-1]).all()


def test_a_pair_that_shares_many_shingles_is_passed_on_once():
    """Sets of 0 to 299 but for a few numbers, all postings: each pair comes once; runs of others between two shared ones
    (longer than BEFORE) let it come again, never less than once."""
    rng = np.random.default_rng(3)
    sets = [np.setdiff1d(np.arange(300), rng.integers(0, 300, 8)) for _ in range(6)]
    sets.append(np.setdiff1d(np.arange(300), np.arange(100, 100 + simhash.BEFORE + 4)))
    rows = []
    for k, x in enumerate(sets):
        bits = simhash.folded(simhash.parity(x.astype(np.uint64) << np.uint64(34)), 8).tobytes()
        rows += [(int(w), 0, 0, 0, k, k, len(x), bits, x[max(0, at - simhash.BEFORE) : at].tolist()) for at, w in enumerate(x)]
    rows.sort(key=lambda r: r[0])
    types = [pa.int64()] * 7 + [pa.binary(), pa.list_(pa.int64())]
    for step in (40, len(rows)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + step], strict=True), types, strict=True)], names=list("wijbcdefg")) for a in range(0, len(rows), step)]
        got = [pair for b in simhash._pairs(0.8)(iter(batches)) for pair in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        want = set(combinations(range(7), 2))
        assert set(got) == want and len(got) <= len(want) + 6


def test_pairs_of_connected_components_are_not_compared(spark, monkeypatch):
    """Two components of near copies with all their pairs, and a third that is not similar: one link is enough for the first."""
    base = [f"w{i}" for i in range(40)]
    texts = {i: " ".join([*base[:-1], f"x{i}"]) if i < 60 else " ".join(f"y{k}" for k in range(39)) + f" z{i}" for i in range(63)}
    root = {i: 0 if i < 30 else 30 if i < 60 else 60 for i in texts}
    h = {i: simhash.shingle_set(t) for i, t in texts.items()}
    sets = bucketed(spark.createDataFrame([(i, len(x), bytearray(simhash.parity(x).tobytes())) for i, x in h.items()], "id long, n int, parity binary"), "id")
    docs = bucketed(spark.createDataFrame(list(texts.items()), "id long, text string"), "id")
    roots = stored(spark.createDataFrame(list(root.items()), "id long, root long"))
    pairs = [(u, v, root[u], root[v]) for u, v in combinations(range(63), 2) if root[u] != root[v]]
    asked = []
    possible = simhash._possible
    monkeypatch.setattr(simhash, "_possible", lambda p, *a: asked.append(p.count()) or possible(p, *a))
    got = simhash._links_between(stored(spark.createDataFrame(pairs, "u long, v long, a long, b long")), sets, docs, roots, 0.8)
    links = {tuple(r) for d in got for r in d.collect()}
    assert links and all(u < 30 <= v < 60 for u, v in links)
    assert asked[0] == 3 and sum(asked) == 3 + 180 - 2  # all pairs of those that are not similar, one of the others


def test_pairs_of_a_large_group_are_not_rows(spark):
    """Sixty near copies and three strangers at one shingle, in two blocks, none connected yet: no more rows than came are passed
    on, though all pairs of the copies are candidates, and the links found there connect the copies and nothing else."""
    base = [f"w{i}" for i in range(40)]
    texts = {i: " ".join([*base[:-1], f"x{i}"]) if i < 60 else " ".join([*base[:20], *[f"y{i}v{k}" for k in range(20)]]) for i in range(63)}
    h = {i: simhash.shingle_set(t) for i, t in texts.items()}
    rows = [(7, *sorted((i % 2, o)), i % 2, i, i, len(x), bytearray(simhash.folded(simhash.parity(x), 8).tobytes()), []) for i, x in h.items() for o in (0, 1)]
    d = stored(spark.createDataFrame(rows, "w long, i int, j int, block int, id long, root long, n int, bits binary, before array<long>"))
    batch = d.orderBy("w", "i", "j").toArrow().combine_chunks().to_batches()
    got = [r for b in simhash._pairs(0.8, True)(iter(batch)) for r in b.to_pylist()]
    assert len(got) <= len(rows)
    assert {tuple(sorted((r["id"], o))) for r in got for o in r["others"]} >= set(combinations(range(60), 2))
    docs = bucketed(spark.createDataFrame(list(texts.items()), "id long, text string"), "id")
    for block in (simhash.BLOCK, 1):
        links = simhash._links_in_cells(d, docs, 0.8, block)
        assert links.count() <= len(rows)
        nodes = [r["node"] for r in simhash.connected_components(links).collect()]
        assert sorted(nodes) == list(range(60)) and len({r["root"] for r in simhash.connected_components(links).collect()}) == 1


def test_components_take_few_tables(spark, monkeypatch):
    """A long path: rounds over ever fewer edges made dozens of tables, each with its jobs, which the driver remembers."""
    path = spark.createDataFrame([(i * 7919 % 3001, (i + 1) * 7919 % 3001) for i in range(3000)] + [(9001, 9002)], "u long, v long")
    made = []
    monkeypatch.setattr(components, "stored", lambda df: made.append(1) or stored(df))
    groups: dict = {}
    for r in components.connected_components(path).collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [2, 3001] and all(root in g for root, g in groups.items())
    assert len(made) <= 6


def test_components_of_names_and_without_a_last_task(spark):
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(50)] + [("x", "y"), ("y", "z")], "u string, v string")
    for last in (0, 5, components.LAST):
        groups: dict = {}
        for r in components.connected_components(chain, last).collect():
            groups.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(len, groups.values())) == [3, 51]
