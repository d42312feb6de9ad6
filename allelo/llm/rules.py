"""Quality rules with thresholds learned from mergeable quantile sketches (native DataFrame operations only).

Every metric of every (language, source) is summarised by a histogram with bins of bounded relative width (32 bins to a
power of two over fixed-point values). Histograms merge by adding counts: those of the tasks are added up to the group's.
Every group, however small, is judged by its own. A document fails a rule if it lies beyond the outer fence of its group,
q75 + FENCE * max(q75 - q25, least spread); for the word length also below the lower fence. Fences replace fixed cutoffs;
they move with the group and do not cut a fixed share of a clean one.

Defined cases: a null text has no words and fails the base; null lang or source form groups of their own; equal rows get
equal verdicts; windows of words are compared by 64-bit hashes within one text; very long texts are read whole (their words
are one array); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import source_key, stored, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Groups up to which their fences, some 200 bytes each, are broadcast; more are joined by Spark's own choice.
MOST_BROADCAST = 100_000
FENCE = 3
#: Per metric: numerator, denominator (fixed point: thousandths), least spread, whether low values fail too.
METRICS = {
    "word_length": ("word_chars", "n_words", 500, True),
    "symbols": ("n_symbols", "n_words", 20, False),
    "dup_lines": ("n_dup_lines", "n_words", 10, False),
    "repeats": ("n_repeat_words", "n_words", 50, False),
}


def _repeat_words(ws):
    """Words in windows of WINDOW words that occur twice or more."""
    n = F.size(ws)
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(n >= WINDOW, hashes)


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every document."""
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("_t"))
    d = d.withColumn("_w", words(F.col("_t"))).withColumn("_h", _repeat_words(F.col("_w")))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.when(some, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_s", pairs)
    same = lambda x, i: (x["h"] == F.get(F.col("_s"), i - 1)["h"]) | (x["h"] == F.get(F.col("_s"), i + 1)["h"])
    found = F.filter("_s", lambda x, i: F.coalesce(same(x, i), (x["h"] == F.get(F.col("_s"), i + 1)["h"]), (x["h"] == F.get(F.col("_s"), i - 1)["h"]), F.lit(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(found, lambda x: x["i"])))
    steps = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    d = d.withColumn("_l", lines)
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )


def _bin(x):
    """Lower edge of the bin of a count: exact below 64, else its six leading binary digits."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(x / width).cast("long") * width


def _metrics(d: DataFrame):
    return F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.floor(F.col(a) * 1000 / F.col(b)).cast("long").alias("v"))
            for m, (a, b, _, _) in METRICS.items()
        ]
    )


def sketches(features: DataFrame) -> DataFrame:
    """Mergeable histograms: counts by language key, source key, metric and bin, over documents that pass the base."""
    d = features.where(~F.col("base_failed")).select(source_key(F.col("lang")).alias("lk"), source_key(F.col("source")).alias("sk"), F.explode(_metrics(features)).alias("m"))
    return d.groupBy("lk", "sk", F.col("m.metric").alias("metric"), _bin(F.col("m.v")).alias("bin")).agg(F.count("*").alias("n"))


def thresholds(hist: DataFrame) -> DataFrame:
    """Lower and upper fence of each (language key, source key, metric) from its sketch."""
    keys = ["lk", "sk", "metric"]
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    q = hist.withColumn("upto", upto).withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    first = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bin")))
    t = q.groupBy(*keys).agg(first(25).alias("q25"), first(75).alias("q75"))
    least = F.create_map(*[F.lit(x) for m, (_, _, s, _) in METRICS.items() for x in (m, s)])
    t = t.withColumn("spread", F.greatest(F.col("q75") - F.col("q25"), least[F.col("metric")]))
    return t.select(*keys, (F.col("q25") - FENCE * F.col("spread")).alias("low"), (F.col("q75") + FENCE * F.col("spread")).alias("high"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``kept`` and ``failed_rules`` (how many fences a document lies beyond)."""
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    d = stored(text_features(docs).withColumn("base_failed", base))
    t = stored(thresholds(sketches(d)).groupBy("lk", "sk").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("t")))
    t = F.broadcast(t) if t.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else t
    d = d.withColumn("_lk", source_key(F.col("lang"))).withColumn("_sk", source_key(F.col("source")))
    d = d.join(t, (d["_lk"] == t["lk"]) & (d["_sk"] == t["sk"]), "left")
    failed = F.lit(0)
    for m, (a, b, _, low) in METRICS.items():
        v = F.floor(F.col(a) * 1000 / F.col(b)).cast("long")
        beyond = v > F.col("t")[m]["high"]
        failed = failed + F.coalesce((beyond | (v < F.col("t")[m]["low"]) if low else beyond).cast("int"), F.lit(0))
    return d.withColumn("_f", F.when(~F.col("base_failed"), failed).otherwise(0)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("_f") == 0)).alias("kept"), F.col("_f").alias("failed_rules"),
    )
