"""Source divergence audit: how differently the sources of a language use its terms, by integer-dictionary encoding.

Tasks count terms as they read texts, so each text is read once; counts of (language, source, term) and the documents that hold
a term are added up by Spark. The terms that enough documents of a language hold are its dictionary: sorted by range, a
term's number is its place in UTF-8 order. The dictionary is cut into chunks of CHUNK consecutive terms. A chunk's task holds
its sorted terms, encodes the counts' terms by binary search and bins them to one dense vector for each source; shares,
their differences and the terms of greatest excess follow from these vectors. Sums over chunks give the distances of
sources; the first terms of each chunk hold the first ones of all, and equal values are in the order of the numbers.
Nothing of the dictionary is broadcast or collected; a language with most of the terms is many chunks.

Arithmetic is exact: a share is 1 + floor(10^9 (n + 5) / (N + 5 V)) by division in steps of three digits, in 64 bits while
N + 5 V is below 9 x 10^15.

Defined cases: null text, lang and source are empty strings; a group without terms takes part with counts of zero; a language
without kept terms has distances of zero and no terms; repeated rows are documents of their own; a very long text is read in
parts; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.chains import numbered
from ..ship import ship
from .common import map_batches, slices, stored

MIN_DOCS = 30
TOP = 50
SMOOTH = 5
#: Consecutive terms of a dictionary that one task holds for all sources.
CHUNK = 512
#: Different (group, term) counts that a task holds before it passes them on.
HELD = 400_000
#: Bytes of a text that are split into terms at once.
TEXT_BYTES = 4 << 20
#: Letters of ASCII, the upper ones lowered, and all bytes of longer characters stay; every other byte ends a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_parts(text: bytes, size: int = TEXT_BYTES) -> Iterator[list[bytes]]:
    """The terms of a text, of about ``size`` bytes of it at a time."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and _TERM[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_TERM).split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) -> counts (lang, source, term, n, docs); a row without term for each group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = [None, *n]
            same = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            ints = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*same, pa.array(terms, pa.binary()).cast(pa.string()), *ints], names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    held = 0
    for batch, texts in slices(batches):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in term_parts(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) - before
        if held > HELD:
            yield from rows()
            held = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """Stored counts (lang, source, term, n, docs); a row with null term for each group of lang and source."""
    named = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    slim = docs.select(*named, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    partial = map_batches(slim, _count, "lang string, source string, term string, n long, docs long")
    return stored(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 n / total), exactly, for totals below 9 x 10^15."""
    out, rest = np.zeros(np.broadcast(n, total).shape, np.int64), n
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + step
    return out + 1


def _chunk_rows(table: pa.Table) -> pa.Table:
    """A chunk's rows: groups (source, its total n, V; no term) and counts (source, term, n) -> distances of pairs of sources
    and each source's first terms over this chunk."""
    lang, source, term, n, kept = (table.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "source", "term", "n", "kept"))
    none = table.column("term").is_null().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, bool)
    order = np.flatnonzero(none)[np.argsort(source[none], kind="stable")]
    sources, totals, v = source[order], n[order].astype(np.int64), int(kept[none].max())
    words = np.unique(term[~none])
    ids = np.searchsorted(words, term[~none])
    which = np.searchsorted(sources, source[~none])
    weights = n[~none]
    count = np.zeros((len(sources), len(words)), np.int64)
    for s in np.unique(which):
        mine = which == s
        count[s] = np.bincount(ids[mine], weights[mine], len(words)).astype(np.int64)
    p = shares(count + SMOOTH, totals[:, None] + SMOOTH * v)
    q = shares(count.sum(0) + SMOOTH, totals.sum(keepdims=True) + SMOOTH * v)
    out = {k: [] for k in ("source", "part", "item", "value")}

    def add(s, part, items, values):
        out["source"] += [s] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += list(items)
        out["value"] += values.tolist()

    for s in range(len(sources)):
        add(sources[s], "pair", sources[s + 1 :], np.abs(p[s + 1 :] - p[s]).sum(1))
        over = np.flatnonzero((count[s] > 0) & (p[s] > q))
        over = over[np.argsort(q[over] - p[s, over], kind="stable")][:TOP]  # ids are in UTF-8 order, so ties are too
        add(sources[s], "term", words[over], p[s, over] - q[over])
    columns = {"lang": pa.array([lang[0]] * len(out["source"]), pa.string())} | {k: pa.array(x, pa.int64() if k == "value" else pa.string()) for k, x in out.items()}
    return pa.table(columns)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of lang and source the distances to the other sources of the
    language (part ``pair``) and the TOP terms that it uses most above the language's share (part ``term``)."""
    ship(docs.sparkSession)
    t = term_counts(docs)
    groups = t.where(F.col("term").isNull()).select("lang", "source")
    known = t.where(F.col("term").isNotNull())
    kept = known.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    ids = numbered(kept.select("lang", "term"), ["lang"], ["term"], "term")
    ids = ids.select("lang", "term", F.floor((F.col("_n") - 1) / CHUNK).alias("chunk"), F.col("_all").alias("kept"))
    counts = stored(known.select("lang", "source", "term", "n").join(ids, ["lang", "term"]))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    # each chunk gets a row for every source of its language, also for those that have none of its terms
    chunks = counts.select("lang", "chunk", "kept").distinct()
    heads = groups.join(totals, ["lang", "source"], "left").join(chunks, "lang")
    heads = heads.select("lang", "chunk", "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0)).alias("n"), "kept")
    rows = counts.select("lang", "chunk", "source", "term", "n", "kept").unionByName(heads)
    made = stored(rows.groupBy("lang", "chunk").applyInArrow(_chunk_rows, "lang string, source string, part string, item string, value long"))
    found = made.where(F.col("part") == "pair").groupBy("lang", F.col("source").alias("a"), F.col("item").alias("b")).agg(F.sum("value").alias("value"))
    pair = groups.join(groups.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    pair = pair.withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")}).join(found, ["lang", "a", "b"], "left")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    ranked = pair.unionByName(made.where(F.col("part") == "term"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return ranked.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")
