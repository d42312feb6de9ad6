"""Tables in the folder that a cluster shares, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, of ``spark.checkpoint.dir``. Without that setting only a local master,
    whose tasks run on the driver's machine, gets a temporary one; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="allelo-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: For each open ``made_here``, the innermost last, the folders of the tables written since.
_made: list[list[str]] = []
#: Names in the catalog of the tables in these folders.
_named: dict[str, str] = {}


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    for folders in _made:
        folders.append(path)
    return path


@contextmanager
def made_here() -> Iterator[list[str]]:
    """The folders of the tables that are stored inside, for ``remove`` when nothing reads them any more."""
    folders: list[str] = []
    _made.append(folders)
    try:
        yield folders
    finally:
        _made.pop()


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete stored tables and their names in the catalog; DataFrames that read them cannot be computed again."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    while folders:
        folder = folders.pop()
        if folder in _named:
            spark.sql(f"DROP TABLE IF EXISTS {_named.pop(folder)}")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, dealt by ``keys``, as a stored table that is bucketed and sorted by them: joins on the keys do not move it."""
    spark = df.sparkSession
    name = f"allelo_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _new_path(spark)
    _named[path] = name
    out = df.write.option("path", path).option("compression", "zstd")
    out.bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return spark.table(name)
