"""The data source of genotype blocks: rows of the reader, partitions, pushed conditions, round trip, aborted jobs."""

import os

import pytest
from pyspark.sql import functions as F

from allelo.sources import blocks, native

COLUMNS = [c.split()[0] for c in blocks.SCHEMA.split(", ")]


def rows(d):
    return sorted(map(str, (tuple(r) for r in d.select(*COLUMNS).collect())))


@pytest.fixture
def alleles(tmp_path):
    p = tmp_path / "infile.msat"
    lines = ["# a comment", " 3 3 . numbers and names"]
    for k, n in enumerate((4, 1, 3)):
        lines += [f"{n}  pop {'ä' * k}x"] + [f"{('?' if i == 2 else '') + str(i):<10}{i}.{i + 1} ?.{k} 7" + ("\r" if k == 1 else "") for i in range(n)] + ["", "# between"]
    p.write_bytes(("\n".join(lines) + "\n").encode())
    return str(p)


def test_rows_are_those_of_the_reader(spark, alleles, tmp_path):
    want = rows(native.read_genotypes(spark, alleles))
    d = blocks.load_blocks(spark, alleles)
    assert rows(d) == want and len(want) == 48 and d.rdd.getNumPartitions() == 3
    blocks.register(spark)
    assert rows(spark.read.format(blocks.FORMAT).option("path", alleles).load()) == want
    s = tmp_path / "infile.seq"
    s.write_text("s 2 2 sites\n(s3 s2) [2o2](s6)\n2 one\n" + "a         ACGTA CCGGTT\n" + "b         ACGTACCGGTA\n" + "1 two\nc         TTTTTTTTTTT\n")
    assert rows(blocks.load_blocks(spark, str(s))) == rows(native.read_genotypes(spark, str(s)))


def test_conditions_leave_out_blocks_and_loci(spark, alleles):
    d = blocks.load_blocks(spark, alleles)
    want = native.read_genotypes(spark, alleles)
    some = d.where((F.col("pop") == 3) & F.col("locus").isin(1, 3))
    assert rows(some) == rows(want.where("pop = 3 and locus in (1, 3)")) and some.rdd.getNumPartitions() == 1
    assert rows(d.where("pop = 9")) == [] and rows(d.where("value = '7' and pop in (1, 2)")) == rows(want.where("value = '7' and pop in (1, 2)"))


def test_round_trip_of_many_loci(spark, tmp_path):
    n = 100_000
    people = spark.createDataFrame([(1, "north", 1, "a"), (1, "north", 2, "b"), (2, "south", 1, "c")], "pop int, pop_name string, ind int, ind_name string")
    d = people.crossJoin(spark.range(1, n + 1).select(F.col("id").cast("int").alias("locus"))).crossJoin(spark.range(1, 3).select(F.col("id").cast("int").alias("copy")))
    d = d.withColumn("value", F.when(F.pmod(F.xxhash64("ind_name", "locus", "copy"), F.lit(9)) > 0, F.pmod(F.xxhash64("locus", "copy", "ind"), F.lit(50)).cast("string")))
    path = str(tmp_path / "out")
    blocks.save_blocks(d, path)
    got = spark.read.format(blocks.FORMAT).option("path", path).load()
    both = d.join(got, ["pop", "pop_name", "ind", "ind_name", "locus", "copy"]).where(d["value"].eqNullSafe(got["value"]))
    # a cell with one value missing reads as homozygous, as in any such file
    half = d.groupBy("pop", "ind", "locus").agg(F.count("value").alias("k"), F.max(F.when(F.col("copy") == 1, F.col("value"))).alias("a")).where("k = 1").count()
    assert got.count() == 6 * n and both.count() >= 6 * n - half
    assert got.groupBy("pop").agg(F.countDistinct("ind").alias("k")).orderBy("pop").collect()[0]["k"] == 2


def test_an_aborted_job_leaves_no_blocks(spark, tmp_path):
    d = spark.createDataFrame([(1, "p", i, f"n{i}", 1 if i < 5 else 7, 1, "x") for i in range(6)], "pop int, pop_name string, ind int, ind_name string, locus int, copy int, value string")
    blocks.register(spark)
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="locus 7"):
        d.write.format(blocks.FORMAT).options(path=path, loci=3).mode("append").save()
    assert not os.path.exists(f"{path}/_blocks.json")


def test_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], "pop int, pop_name string, ind int, ind_name string, locus int, copy int, value string")
    blocks.save_blocks(d, str(tmp_path / "out"))
    assert spark.read.format(blocks.FORMAT).option("path", str(tmp_path / "out")).load().count() == 0
