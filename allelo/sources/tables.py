"""Small side files: distances, tip dates, site weights and categories, samples of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import stored
from .lines import numbered, stripped
from .native import population_lines

SAMPLE_KEYS = ["Steps", "Locus", "Replicate"]


def read_distances(spark: SparkSession, path: str, name_width: int = 10) -> DataFrame:
    """A square matrix (a count, then a name and a row each) as (i, j, d) from 1; off the diagonal 1e-6 at least."""
    d = numbered(spark, path, r"^\s*(#|$)").where("nr > 0")
    row = F.split(stripped(F.substring(F.col("line"), F.lit(name_width + 1), F.length("line"))), r"\s+")
    d = d.select(F.col("nr").cast("int").alias("i"), F.posexplode(row).alias("_j", "_v"))
    d = d.select("i", (F.col("_j") + 1).alias("j"), F.col("_v").cast("double").alias("d"))
    return d.withColumn("d", F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(F.greatest("d", F.lit(1e-6))))


def read_dates(spark: SparkSession, path: str, name_width: int = 10) -> DataFrame:
    """Tip dates: a header, then blocks ``n name`` and n lines of name and date -> (pop, ind, ind_name, date)."""
    d = numbered(spark, path, r"^\s*(#|$)").where("nr > 0")
    pops = stored(population_lines(d, 1, 1 << 31).select("pop", "first", "last"))
    d = d.join(pops, F.col("nr").between(F.col("first"), F.col("last")))  # a row a population, of a size that Spark sees
    value = stripped(F.substring(F.col("line"), F.lit(name_width + 1), F.length("line"))).cast("double")
    return d.select("pop", (F.col("nr") - F.col("first") + 1).cast("int").alias("ind"), stripped(F.substring("line", 1, name_width)).alias("ind_name"), value.alias("date"))


def read_site_values(spark: SparkSession, path: str) -> DataFrame:
    """Weights or categories of sites as digits and letters (A is 10) -> (site, value); blanks are ignored."""
    d = numbered(spark, path).select("nr", F.posexplode(F.filter(F.split("line", ""), lambda c: c.rlike("[0-9A-Za-z]"))).alias("_p", "c"))
    lengths = d.groupBy("nr").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("nr").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(lengths.select("nr", before.alias("b")), "nr")
    v = F.when(F.col("c").rlike("[0-9]"), F.col("c").cast("int")).otherwise(F.ascii(F.upper("c")) - 55)
    return d.select((F.col("b") + F.col("_p") + 1).alias("site"), v.alias("value"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Posterior samples of a run, tab separated below comments and a header, in wide form; gzip by extension."""
    head = spark.read.text(path).where(F.col("value").startswith("Steps")).limit(1).collect()
    if not head:
        raise ValueError(f"no header of samples in {path}")
    names = head[0]["value"].split("\t")
    d = spark.read.text(path).where(F.col("value").rlike(r"^\s*[0-9]"))
    w = F.split("value", "\t")
    kinds = {"Steps": "long", "Locus": "int", "Replicate": "int"}
    return d.select(*[F.get(w, F.lit(i)).cast(kinds.get(n, "double")).alias(n) for i, n in enumerate(names) if n.strip()])


def write_samples(d: DataFrame, path: str) -> None:
    """One folder a locus and replicate, as columns."""
    d.write.partitionBy("Locus", "Replicate").parquet(path)


def write_samples_text(d: DataFrame, path: str) -> None:
    d.write.option("sep", "\t").option("header", True).csv(path)


def long_samples(d: DataFrame, parameters: list[str]) -> DataFrame:
    """(Steps, Locus, Replicate, param, value)."""
    return d.unpivot(SAMPLE_KEYS, parameters, "param", "value")


def remaining_work(work: DataFrame, samples: DataFrame, wanted: int) -> DataFrame:
    """Chains (locus, replicate) of the work list with fewer than ``wanted`` - 1 rows among the samples."""
    done = samples.groupBy(F.col("Locus").alias("locus"), F.col("Replicate").alias("replicate")).agg(F.count("*").alias("n"))
    return work.join(done.where(F.col("n") >= wanted - 1), ["locus", "replicate"], "left_anti")


def merge_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples of two runs; the loci of the second are numbered after those of the first."""
    last = a.agg(F.max("Locus").alias("_last"))
    b = b.crossJoin(F.broadcast(last)).withColumn("Locus", F.col("Locus") + F.coalesce("_last", F.lit(0))).drop("_last")  # one row
    return a.unionByName(b, allowMissingColumns=True)


#: Text tables of a run: their columns in order.
FILES = {
    "histogram": ["locus", "param", "in50", "in95", "value", "count", "freq", "cumfreq", "prior"],
    "events": ["locus", "param", "bin", "age", "n_all", "n_mrca"],
    "skyline": ["locus", "param", "bin", "age", "mean", "sd", "weight"],
}


def write_table(d: DataFrame, path: str, kind: str) -> None:
    """A histogram, event or skyline table as tab-separated text with a header."""
    d.select(*FILES[kind]).write.option("sep", "\t").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    whole = {"locus", "param", "bin", "count", "n_all", "n_mrca"}
    schema = ", ".join(f"{c} {'boolean' if c.startswith('in') else 'long' if c in whole else 'double'}" for c in FILES[kind])
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
