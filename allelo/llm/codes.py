"""Vector code compression: product quantisation in integers, nearest entries by segment-mean lower bounds.

Components become integers (``scale`` times, rounded down), vectors are cut into equal parts, and each part's codebook is
refined by rounds of assignment and mean. All arithmetic that decides is in integers, so results depend on no order of rows.

The nearest entry of a part is found coarse to fine. A part is cut into 1, 2, 4 and so on blocks; means over blocks and the
norm of what the means leave (the residual) bound a distance from below: by Pythagoras the means' part is exact, and the
residuals' difference is at least the difference of their norms. At each level the entries whose bound is above the smallest
exact distance known so far are dropped, with a margin for rounding, and the entry with the smallest bound is measured
exactly. The survivors of all levels get exact integer distances; the first of the nearest wins.

Spark scans the vectors once a round; a task sends, for each entry that it used, a count and a vector of sums, which Spark
adds up. What the driver and all tasks hold is the codebooks: ENTRIES times the length of a vector.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; equal vec_ids and null ones (last)
are rows of their own, ordered by vector where the first ones are picked; vectors of unequal length, or of one that
the parts do not divide, count as if filled up with zeros; fewer rows than entries give so many entries; extra columns are not
read; an empty table gives an empty result. Integers so large that a distance would not fit in 62 bits are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are compared with all entries at once.
ROWS = 1024


def _levels(width: int) -> list[np.ndarray]:
    """Starts of the blocks at each level, coarse to fine; the last still joins components."""
    return [np.unique(np.linspace(0, width, n, endpoint=False).astype(np.int64)) for n in (1 << i for i in range(width.bit_length())) if n < width]


class Segments:
    """Block means (times the root of a block's length) and residual norms of integer vectors, level by level."""

    def __init__(self, x: np.ndarray):
        self.means, self.rest = [], []
        y = x.astype(np.float64)
        for starts in _levels(x.shape[1]):
            lengths = np.diff([*starts, x.shape[1]])
            mean = np.add.reduceat(y, starts, axis=1) / lengths
            self.means.append(mean * np.sqrt(lengths))
            self.rest.append(np.sqrt(np.square(y - np.repeat(mean, lengths, axis=1)).sum(1)))
        self.largest = float(np.square(y).sum(1).max(initial=0))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.square(x - y).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and squared distance to the nearest row of ``book`` for each row of ``x`` (int64), ties to the lower index;
    and how many exact distances of survivors that took."""
    index, best, measured = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    entries = Segments(book)
    for begin in range(0, len(x), ROWS):
        part = x[begin : begin + ROWS]
        own = Segments(part)
        margin = 0.5 + 1e-9 * (own.largest + entries.largest)
        least = np.full(len(part), np.iinfo(np.int64).max)
        i, j = np.divmod(np.arange(len(part) * len(book)), len(book))
        for m, r, n, s in zip(own.means, own.rest, entries.means, entries.rest, strict=True):
            bound = np.square(r[i] - s[j])
            for c in range(m.shape[1]):
                bound += np.square(m[i, c] - n[j, c])
            dense = np.full((len(part), len(book)), np.inf)
            dense[i, j] = bound
            least = np.minimum(least, _exact(part, book[dense.argmin(1)]))
            keep = bound <= least[i] + margin
            i, j = i[keep], j[keep]
        exact = np.full((len(part), len(book)), np.iinfo(np.int64).max)
        exact[i, j] = _exact(part[i], book[j])
        measured += len(i)
        index[begin : begin + ROWS] = exact.argmin(1)
        best[begin : begin + ROWS] = exact.min(1)
    return index, best, measured


def integer_rows(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indices of the vectors that are whole and finite, and their integers."""
    values = pa.compute.cast(column.values, pa.float64()) if len(column.values) else pa.array([], pa.float64())
    bad = values.is_null().to_numpy(zero_copy_only=False)
    v = values.to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(np.where(bad, 0.0, v))
    starts, ends = (column.offsets.to_numpy()[a : a + len(column)] for a in (0, 1))
    wrong = np.concatenate([[0], np.cumsum(bad)])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[ends] == wrong[starts])
    v = np.floor(np.where(bad, 0.0, v) * float(scale))
    rows = np.flatnonzero(good)
    kept = [v[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
    most = max((float(np.abs(k).max(initial=0)) for k in kept), default=0.0)
    if most >= 1 << 30 or any(4 * most * most * len(k) >= 1 << 62 for k in kept):
        raise ValueError(f"components of {most / scale:g} are too large for integer distances")
    return rows, [k.astype(np.int64) for k in kept]


def _kept(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and the integers ``x`` of the vectors that take part."""
    slim = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    schema = slim.withColumn("x", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = integer_rows(batch.column(2), scale)
            whole = batch.select([0, 1]).take(pa.array(rows))
            x = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *kept]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*whole.columns, x], names=["vec_id", "label", "x"])

    return map_batches(slim, run, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = column.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


def _used(kept: DataFrame, books: np.ndarray) -> list:
    """(part, entry, n, sums) of the entries that some vector's part is nearest to."""
    shared = kept.sparkSession.sparkContext.broadcast(books)  # bounded: parts x entries x width
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                index = nearest(own, books[p])[0]
                np.add.at(count[p], index, 1)
                np.add.at(sums[p], index, own)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    partial = map_batches(kept.select("x"), run, "part int, entry int, n long, s array<long>")
    got = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    return got.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("s")).collect()


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Stored (vec_id, label, x) -> the codebooks as parts x entries x width; None without rows. The first ones are the parts
    of the vectors with the smallest ids; each round replaces an entry by the mean, rounded down, of the parts nearest to
    it; unused ones stay."""
    length = kept.agg(F.max(F.size("x"))).first()[0]
    if length is None:
        return None
    width = max(-(-length // parts), 1)
    first = kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    x = np.array([[*r["x"]] + [0] * (parts * width - len(r["x"])) for r in first], np.int64)
    books = np.ascontiguousarray(x.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        for r in _used(kept, books):
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["s"]]
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, x) -> vec_id, label, code (two hex digits a part), error (squared distance)."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape
    schema = kept.drop("x").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], shared.value[p])[:2] for p in range(parts)]
            index = np.column_stack([i for i, _ in found]).astype(np.uint8)
            code = pa.array([row.tobytes().hex() for row in index], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], code, pa.array(sum(d for _, d in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return map_batches(kept, run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """Stored vec_id, label, code, error of the vectors that take part, and the codebooks. ``entries`` may be 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a part's code is one byte")
    kept = stored(_kept(vectors, scale))
    books = train(kept, parts, entries, rounds)
    if books is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False)), None
    return stored(encode(kept, books)), books


def code_table(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (over equal labels, nulls together) and the codebooks' digest."""
    c, books = compress(vectors)
    # a row a label, stored, so that Spark sees its size and can split a label that very many vectors have
    labels = stored(c.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    named = c.join(labels, c["label"].eqNullSafe(labels["_label"]))
    return named.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else "").alias("codebooks_sha256"))
