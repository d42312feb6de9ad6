"""Mixing sources to target weights along a time-varying curriculum (native DataFrame operations only).

Each source has a share of the mix and a schedule: how its weight changes while training runs from time 0 to 1. The
integral of the schedule is the source's cumulative word demand; a document that begins after so many words of its source
is trained on at the time when that demand is reached. The mix is the documents sorted by range on that time.

Defined cases: a null text has 0 words; rows with null source form a source of their own, the last; repeated rows are
rows of their own; a source without words has target 0; an empty table gives an empty mix; a very long text is one
document, of which the last copy may give a part. Extra columns of any name pass through ``curriculum_mix``; columns named like its own (``mix_copy``, ``mix_position``, ``mix_words``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, source_key, stored, whole_row

#: Relative weights, dealt to the sources in turn.
WEIGHTS = (3, 1, 2)
#: (time, weight) knots of piecewise linear schedules, dealt in turn: an early source, a late one, a steady one.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.25), (0.75, 1.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)))
#: Sub-ranges of a source's order are keyed by so many hex digits, so that no source is in one task.
_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """(k, source_size) -> with ``rank``, ``target``: weights share ``share`` times all words; no target is above
    ``max_repeat`` times its source; the excess goes to the others by weight (water filling in closed form).

    One row per source: the windows over all rows hold the list of sources, never documents.
    """
    rank = F.row_number().over(W.orderBy("k")) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "k")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    after = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("fill", F.row_number().over(by_fill)).withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("fill", "level"))
    t = t.withColumn("first_open", F.min(open_).over(everything))
    return t.select(
        "k",
        "source_size",
        "rank",
        F.when(F.col("first_open").isNull() | (F.col("fill") < F.col("first_open.fill")), F.col("cap"))
        .otherwise(F.col("first_open.level") * F.col("weight"))
        .alias("target"),
    )


def _schedules(schedules) -> Column:
    """Per schedule its segments: start time, demand before it (0 to 1), weight at its start, half its slope."""
    out = []
    for knots in schedules:
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        done, segments = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            w0, w1 = w0 / area, w1 / area
            segments.append(F.struct(F.lit(done).alias("c"), F.lit(t0).alias("t"), F.lit(w0).alias("b"), F.lit((w1 - w0) / (2 * (t1 - t0))).alias("a")))
            done += (t1 - t0) * (w0 + w1) / 2
        out.append(F.array(*segments))
    return F.array(*out)


def _inverse_demand(u: Column, rank: Column, schedules) -> Column:
    """The time at which the share ``u`` of a source's demand is reached."""
    mine = F.element_at(_schedules(schedules), (rank % len(schedules) + 1).cast("int"))
    s = F.element_at(F.filter(mine, lambda x: x["c"] <= u), -1)
    r = u - s["c"]
    root = s["b"] + F.sqrt(F.greatest(s["b"] * s["b"] + F.lit(4.0) * s["a"] * r, F.lit(0.0)))
    return F.least(s["t"] + F.when(r <= 0, F.lit(0.0)).otherwise(r * F.lit(2.0) / root), F.lit(1.0))


def assign(docs: DataFrame, size: Column, weights=WEIGHTS, share: float = 1.5, max_repeat: int = 2, schedules=SCHEDULES) -> DataFrame:
    """The rows of ``docs`` (doc_id and source needed) as struct ``_row`` with _size, _source_size, _target and _copies: for
    each copy that the mix takes its number, training time and words. A source's copies follow each other in the order of a
    hash; the copy at which the target is reached gives only the words still owed.
    """
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select(whole_row(docs).alias("_row"), size.alias("_size"), source_key(F.col("source")).alias("_k"), h.alias("_h"))
    d = d.withColumn("_b", F.substring("_h", 1, _DIGITS))
    cells = d.groupBy("_k", "_b").agg(F.sum("_size").alias("n"))
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sizes = source_targets(cells.groupBy(F.col("_k").alias("k")).agg(F.sum("n").alias("source_size")), weights, share, max_repeat)
    d = d.join(cells.join(sizes, cells["_k"] == sizes["k"]).drop("k"), ["_k", "_b"])
    upto = F.sum("_size").over(W.partitionBy("_k", "_b").orderBy("_h", "_size").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("_start", F.col("before") + upto - F.col("_size"))
    owed = F.floor(F.col("target") + 0.5)
    copies = []
    for e in range(max_repeat):
        begin = F.col("_start") + F.col("source_size") * e
        take = F.greatest(F.least(F.col("_size"), owed - begin), F.lit(0)).cast("long")
        time = _inverse_demand((begin + take / F.lit(2.0)) / F.col("target"), F.col("rank"), schedules)
        copies.append(F.when(take > 0, F.struct(F.lit(e).alias("copy"), time.alias("time"), take.alias("words"))))
    taken = F.filter(F.array(*copies), lambda c: c.isNotNull()).alias("_copies")
    return d.select("_row", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), taken)


def curriculum_mix(docs: DataFrame, **options) -> DataFrame:
    """The training order: a row for each copy of a document that the mix takes, with ``mix_copy``, ``mix_position`` (time
    from 0 to 1) and ``mix_words`` (words to take from it), sorted by range on the position."""
    keep = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_position", "mix_words")]
    d = assign(docs, n_words(F.col("text")), **options).select("_row", F.explode("_copies").alias("_c"))
    mine = [F.col("_c.copy").alias("mix_copy"), F.col("_c.time").alias("mix_position"), F.col("_c.words").alias("mix_words")]
    return d.select(*[F.col("_row")[c].alias(c) for c in keep], *mine).orderBy("mix_position", "doc_id", "mix_copy")


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """A row for each document with the words that the mix takes of it, in training order; text does not leave the scan."""
    slim = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("_size")))
    d = assign(slim, F.col("_size"), **options)
    taken = F.aggregate("_copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    first = F.floor(F.element_at(F.transform("_copies", lambda c: c["time"]), 1) * 1000000)
    d = d.select(
        "_row.doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        taken.alias("taken"),
        F.size("_copies").alias("copies"),
        F.when(F.size("_copies") > 0, first).alias("position"),
    )
    return d.orderBy(F.col("position").asc_nulls_last(), "doc_id")
