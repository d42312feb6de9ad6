"""What the operators of this subpackage share: word patterns, Arrow batches, training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from ..store import stored  # noqa: F401

#: White space and words as the contracts define them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a task holds at once when it works on a batch of documents.
SLICE_BYTES = 4 << 20


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names (dots included)."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def source_key(source: Column) -> Column:
    """A never-null key whose order is the order of sources by code point, null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Consecutive rows of the Arrow batches with their texts, of about ``limit`` bytes at most or else of one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start), col.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start), col.slice(start).to_pylist()


def map_slices(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with ``fn(batch, texts) -> pa.RecordBatch`` called on slices of bounded size."""

    def run(batches):
        for batch, texts in slices(batches):
            yield fn(batch, texts)

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` with this package's files at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def learn_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, max_bytes: int) -> tuple[list, float]:
    """At most ``rows`` labelled training texts as (label, text), half of each class where there are so many, chosen by a
    hash of the id; and the share of label 1 among all labelled training rows.

    Rows with crc32(doc_id as text) mod ``modulus`` = ``held``, without a 0/1 label or without text are not used. A text of
    over ``max_bytes`` bytes gives a piece of it. A document with contradicting labels counts with each of them.
    """
    y = labels.select(F.col("doc_id").alias("_lid"), F.col(label).cast("int").alias("_y"))
    y = y.where(F.col("_lid").isNotNull() & F.col("_y").isin(0, 1) & (F.crc32(F.col("_lid").cast("string")) % modulus != held)).distinct()
    count = {r["_y"]: r["n"] for r in y.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not count:
        return [], 0.5
    picked = [r for k in (0, 1) for r in y.where(F.col("_y") == k).orderBy(F.xxhash64("_lid"), "_lid").limit(rows // 2).collect()]
    ids = docs.sparkSession.createDataFrame(picked, y.schema)  # of at most ``rows`` rows, so it is broadcast
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.col("_text").isNotNull())
    width = max(1, max_bytes // 4)  # characters, of four bytes at most
    place = F.pmod(F.xxhash64("_id", F.lit("piece")), F.greatest(F.length("_text") - width, F.lit(0)) + 1).cast("int") + 1
    piece = F.when(F.octet_length("_text") > max_bytes, F.substring(F.col("_text"), place, F.lit(width))).otherwise(F.col("_text"))
    # repeated ids are rare but could be many: the first rows by hash, id, text and label, always the same ones
    found = d.join(F.broadcast(ids), F.col("_id") == F.col("_lid")).select("_y", piece.alias("_text"), "_id")
    got = found.orderBy(F.xxhash64("_id"), "_id", "_text", "_y").limit(2 * rows).collect()
    got.sort(key=lambda r: (r["_y"], r["_id"], r["_text"]))
    return [(r["_y"], r["_text"]) for r in got], count.get(1, 0) / sum(count.values())


def held_out(modulus: int, held: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``held``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))
