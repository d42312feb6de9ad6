from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def significant(c: Column | str, digits: int = 10) -> Column:
    """A double rounded to so many significant digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string(f"%.{digits - 1}e", c).cast("double")
