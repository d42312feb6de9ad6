"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, skip: str | None = r"^\s*$") -> DataFrame:
    """(line, nr): the lines of a file in order, numbered from 0 without those that match ``skip``. Codecs go by extension.

    Lines are numbered within the file's splits, and the splits' sizes (one row each) summed, so no task needs all lines.
    """
    d = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_i"))
    d = d.withColumn("_p", F.shiftright("_i", 33))
    if skip:
        d = d.where(~F.col("line").rlike(skip))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy("_i")) - 1)
    sizes = d.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p")  # one row a split
    return d.select("line", (F.col("_before") + F.col("_n")).alias("nr"))


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")
