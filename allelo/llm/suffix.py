"""Removal of repeated passages: every byte covered by a string of LENGTH bytes that also starts anywhere else.

1. Anchors. A window of LENGTH bytes is owned by the smallest hashed gram of GRAM bytes in it (the last of equals), so equal
   windows have equal owners at equal places in them. An anchor's context is the bytes of all windows that it owns.
2. Counts. Anchors are counted by gram and by (gram, context). A gram seen once owns no repeated window; a context seen
   twice has only repeated ones. What is left, different contexts around one gram, goes on, one of each.
3. Run-length index. The contexts of some grams are one text with a separator after each. Its Burrows-Wheeler transform is
   kept as runs, with samples at the run ends: where the first and the last suffix of a run begin, and how many bytes
   they share with the suffix before and after them in the order. The matching statistics of the text against all its other
   places are streamed from these samples alone: from one sampled place to the next they fall by one a byte. Where they reach
   LENGTH, the window that starts there occurs elsewhere.
4. Marks go back to the texts; bytes that marked windows cover are removed.

Different texts are one table, dealt and sorted by their hashes (bucketed), so that contexts are cut and marks applied
without moving a text again. Grams with over SHARD contexts are dealt to several indexes. Each tells the hashes of all its
windows, those it matched once; a window that it did not match is repeated if another index tells its hash too, so no group
has to fit in one task. Windows are compared by their bytes within an index. Contexts of one gram, and windows of one
divided gram, are told apart by 64 bits of hash beside the gram's 64, and texts by 128.

Defined cases: null is an empty text; texts under LENGTH bytes lose nothing; repeated rows lose every byte from LENGTH
bytes up; a very long text is one text of many anchors; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import bucketed
from .common import map_batches, slices, stored
from .decontaminate import suffix_array

LENGTH, GRAM = 200, 32
#: Contexts of one gram in one index at most, and contexts of small grams that share an index.
SHARD, TOGETHER = 32768, 8192
_LETTER = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(6)]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h = _LETTER[data]
    for i in range(GRAM.bit_length() - 1):
        h = h[: -(1 << i)] * _POWERS[i] + h[1 << i :]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes, and first and last start of the windows owned, of the anchors of a text."""
    if len(text) < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    h = _grams(np.frombuffer(text, np.uint8))
    width = LENGTH - GRAM + 1
    least = _sliding(np.minimum, h, width)
    # the last smallest gram of each window: owners do not go back, so look at each change
    n = len(least)
    at = np.flatnonzero(h == _sliding(np.maximum, np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width))
    owner = np.searchsorted(at, np.arange(n) + width, side="left") - 1  # last candidate within the window
    while (wrong := h[at[owner]] != least).any():
        owner[wrong] -= 1
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    own = at[owner[first]]
    return own, h[own], first, np.concatenate([first[1:], [n]]) - 1


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, c, _text) -> an anchor's t1, t2, c, pos, back and near (from its first and last window to it), gram, ctx."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch, texts in slices(batches, "_text", 1 << 20):
        out: list[list] = [[] for _ in range(5)]
        count = []
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            pos, gram, lo, hi = anchors(raw)
            # a context is told by its bytes and where the gram lies in it
            ctx = [digest(raw[a : b + LENGTH], p - a) for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            for column, v in zip(out, (pos, pos - lo, pos - hi, gram.view(np.int64), np.array(ctx, np.uint64).view(np.int64)), strict=True):
                column.append(v)
            count.append(len(pos))
        take = pa.array(np.repeat(np.arange(len(texts)), count))
        pos, back, near, gram, ctx = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k).take(take) for k in range(3)], pa.array(pos.astype(np.int32)), pa.array(back.astype(np.int16)), pa.array(near.astype(np.int16)), pa.array(gram), pa.array(ctx)],
            names=["t1", "t2", "c", "pos", "back", "near", "gram", "ctx"],
        )


_WANTED = {"gram": pa.int64(), "ctx": pa.int64(), "n": pa.int64(), "d": pa.int64(), "pos": pa.int32(), "back": pa.int16(), "near": pa.int16()}
_CONTEXTS = "t1 bigint, t2 bigint, gram bigint, ctx bigint, n bigint, d bigint, pos int, back smallint, near smallint, data binary"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text, wanted) -> the bytes of the wanted contexts."""
    for batch, texts in slices(batches, "_text", 1 << 20):
        count, data = [], []
        rows: dict[str, list] = {k: [] for k in _WANTED}
        for t, wanted in zip(texts, batch.column(3).to_pylist(), strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            count.append(len(wanted))
            for w in wanted:
                for k in _WANTED:
                    rows[k].append(w[k])
                data.append(raw[w["pos"] - w["back"] : w["pos"] - w["near"] + LENGTH])
        take = pa.array(np.repeat(np.arange(len(texts)), count))
        columns = [batch.column(i).take(take) for i in (0, 1)]
        columns += [pa.array(rows[k], kind) for k, kind in _WANTED.items()] + [pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", *_WANTED, "data"])


class RunIndex:
    """The Burrows-Wheeler transform of texts, by runs: the byte and length of each, and of its first and last suffix the
    place in the text and the bytes shared with the suffix before and after it. A run ends at a text's first byte."""

    def __init__(self, texts: list[bytes]):
        data = np.zeros(sum(map(len, texts)) + len(texts) + 8, np.uint16)
        at = 0
        self.starts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            data[at : at + len(t)] = np.frombuffer(t, np.uint8)
            data[at : at + len(t)] += 1
            self.starts[i] = at
            at += len(t) + 1
        self.size = at
        most = max(map(len, texts), default=0)
        sa = suffix_array(data[:at], 2 * most + 2)
        sa = sa[len(texts) :]  # separators come first
        before = data[sa - 1].astype(np.int64)
        before[sa == 0] = 0
        new = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(sa)) - 1
        self.symbol, self.length = before[first] - 1, last - first + 1
        self.first, self.last = sa[first], sa[last]
        ends = np.concatenate([first[1:], last[:-1] + 1])  # neighbours over the end of a run
        shared, back = np.unique(ends, return_inverse=True)
        shared = _shared(data, sa[shared - 1], sa[shared])[back] if len(ends) else ends
        self.shared_before = np.concatenate([[0], shared[: len(first) - 1]]) if len(first) else first
        self.shared_after = np.append(shared[len(first) - 1 :], 0) if len(first) else first

    def statistics(self) -> np.ndarray:
        """Of each place of the text the bytes from there that also occur at another place."""
        place = np.arange(self.size)
        best = np.zeros(self.size, np.int64)
        for sample, shared in ((self.first, self.shared_before), (self.last, self.shared_after)):
            value = np.zeros(self.size, np.int64)
            value[sample] = shared
            known = np.zeros(self.size, np.int64)
            known[sample] = sample
            np.maximum.accumulate(known, out=known)
            np.maximum(best, value[known] - (place - known), out=best)
        return best


def _shared(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes are equal from the places a and b, up to a separator."""
    out = np.zeros(len(a), np.int64)
    lanes = np.arange(len(a))
    four = np.lib.stride_tricks.sliding_window_view(data, 4).copy().view(np.uint64).ravel()  # four symbols as one number
    while len(lanes):
        x, y = four[a + out[lanes]], four[b + out[lanes]]
        # a separator differs from every other one
        ended = ((x - np.uint64(0x0001000100010001)) & ~x & np.uint64(0x8000800080008000)) != 0
        on = (x == y) & ~ended
        rest = np.flatnonzero(~on)
        step = np.zeros(len(rest), np.int64)
        still = np.ones(len(rest), bool)
        for _ in range(3):
            u, v = data[a[rest] + out[lanes[rest]] + step], data[b[rest] + out[lanes[rest]] + step]
            still &= (u == v) & (u > 0)
            step += still
        out[lanes[rest]] += step
        out[lanes[on]] += 4
        lanes, a, b = lanes[on], a[on], b[on]
    return out


def matched_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context which of its windows also occur elsewhere in the contexts."""
    index = RunIndex(contexts)
    found = index.statistics() >= length
    return [found[a : a + len(c) - length + 1] for a, c in zip(index.starts.tolist(), contexts, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


_MARKS = "t1 bigint, t2 bigint, gram bigint, marks array<struct<a:int,b:int>>, open array<struct<at:int,w:bigint>>, met array<bigint>"


def _indexer(shard: int):
    """Contexts sorted by gram and part -> marks: runs of matched windows. Of divided grams also
    ``open``: windows that their own index does not match, with their hashes; ``met``: hashes of those it does, each once."""
    mark_kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def index(rows: list[dict]) -> pa.RecordBatch:
        import xxhash

        digest = xxhash.xxh64_intdigest
        marks, at, hashes, met, n_open, n_met = [], [], [], [], [0], [0]
        got = matched_windows([r["data"] for r in rows]) if rows else []
        for r, flags in zip(rows, got, strict=True):
            start, data = r["pos"] - r["back"], r["data"]
            marks.append([{"a": a + start, "b": b + start} for a, b in _runs(flags)] if r["n"] < 2 else [])
            divided = r["d"] > shard
            rest = np.flatnonzero(~flags) if divided else np.zeros(0, np.int64)
            at.append(rest + start)
            hashes.append(np.array([digest(data[i : i + LENGTH], 1) for i in rest.tolist()], np.uint64))
            twins = np.flatnonzero(flags).tolist() if divided else []
            met.append(np.array([digest(data[i : i + LENGTH], 1) for i in twins], np.uint64))
            n_open.append(n_open[-1] + len(rest))
            n_met.append(n_met[-1] + len(twins))
        joined = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        windows = pa.StructArray.from_arrays([pa.array(joined(at, np.int64).astype(np.int32)), pa.array(joined(hashes, np.uint64).view(np.int64))], names=["at", "w"])
        left = pa.ListArray.from_arrays(pa.array(n_open, pa.int32()), windows)
        told = joined(met, np.uint64)
        once = np.sort(np.unique(told, return_index=True)[1])
        told = pa.ListArray.from_arrays(pa.array(np.searchsorted(once, n_met), pa.int32()), pa.array(told[once].view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in ("t1", "t2", "gram")] + [pa.array(marks, mark_kind), left, told],
            names=["t1", "t2", "gram", "marks", "open", "met"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= TOGETHER:
                last = (held[-1]["gram"], held[-1]["part"])
                cut = next((i for i in range(len(held) - 1, -1, -1) if (held[i]["gram"], held[i]["part"]) != last), -1) + 1
                if not cut:
                    break
                yield index(held[:cut])
                held = held[cut:]
        yield index(held)

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text, starts of repeated windows as (first, last)) -> what is left of the text."""
    for batch, texts in slices(batches, "_text"):
        removed, spans, digest = [], [], []
        for t, starts in zip(texts, batch.column(3).to_pylist(), strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            gone, n, kept, end = 0, 0, hashlib.sha256(), -1
            for a, b in sorted((s["a"], s["b"]) for s in starts or ()):
                if a > end:
                    kept.update(raw[max(end, 0) : a])
                    n += 1
                gone += b + LENGTH - max(a, end) if b + LENGTH > end else 0
                end = max(end, b + LENGTH)
            kept.update(raw[max(end, 0) :])
            for column, v in zip((removed, spans, digest), (gone, n, kept.hexdigest()), strict=True):
                column.append(v)
        columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "n_removed", "n_spans", "kept_sha256"])


def _text_id(df: DataFrame) -> DataFrame:
    return df.withColumn("t1", F.xxhash64("_text")).withColumn("t2", F.xxhash64(F.lit("second"), F.col("_text")))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(t1, t2, c, _text): the different texts of LENGTH bytes and more with the number of their rows, bucketed by t1, t2."""
    texts = _text_id(docs.select(F.col("text").alias("_text")).where(F.octet_length("text") >= LENGTH))
    return bucketed(texts.groupBy("t1", "t2").agg(F.count("*").alias("c"), F.first("_text").alias("_text")), "t1", "t2")


def repeated_windows(texts: DataFrame, shard: int = SHARD) -> DataFrame:
    """(t1, t2, _starts): of the different texts the (first, last) starts of their repeated windows."""
    rows = stored(map_batches(texts.select("t1", "t2", "c", "_text"), _anchor_rows, "t1 bigint, t2 bigint, c bigint, pos int, back smallint, near smallint, gram bigint, ctx bigint"))
    grams = rows.groupBy("gram").agg(F.sum("c").alias("_n")).where(F.col("_n") > 1).select("gram")
    grams = stored(grams)  # a table of its own, so that Spark can split a gram that very many anchors have
    again = stored(rows.join(grams, "gram"))  # the anchors whose gram is found again
    classes = again.groupBy("gram", "ctx").agg(F.sum("c").alias("n"), F.min(F.struct("t1", "t2", "pos", "back", "near")).alias("o"))
    classes = stored(classes)
    full = again.join(classes.where(F.col("n") > 1).select("gram", "ctx"), ["gram", "ctx"])
    full = full.select("t1", "t2", F.struct((F.col("pos") - F.col("back")).cast("int").alias("a"), (F.col("pos") - F.col("near")).cast("int").alias("b")).alias("m"))
    # one of each different context of a gram, cut from its text
    several = classes.groupBy("gram").agg(F.count("*").alias("d")).where(F.col("d") > 1)
    one = classes.join(several, "gram").select("o.t1", "o.t2", F.struct("gram", "ctx", "n", "d", "o.pos", "o.back", "o.near").alias("w"))
    wanted = one.groupBy("t1", "t2").agg(F.collect_list("w").alias("wanted"))
    cut = map_batches(texts.join(wanted, ["t1", "t2"]).select("t1", "t2", "_text", "wanted"), _cut_contexts, _CONTEXTS)
    cut = cut.withColumn("part", F.when(F.col("d") > shard, F.pmod("ctx", F.ceil(F.col("d") / shard))).otherwise(F.lit(0)).cast("long"))
    cut = cut.repartition("gram", "part").sortWithinPartitions("gram", "part", "ctx")
    indexed = stored(map_batches(cut, _indexer(shard), _MARKS))
    found = indexed.select("t1", "t2", F.explode("marks").alias("m"))
    rest = indexed.select("t1", "t2", "gram", F.explode("open").alias("o")).select("t1", "t2", "gram", "o.at", "o.w")
    told = rest.select("gram", "w").union(indexed.select("gram", F.explode("met").alias("w")))
    twice = told.groupBy("gram", "w").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gram", "w")
    rest = rest.join(twice, ["gram", "w"]).select("t1", "t2", F.struct(F.col("at").alias("a"), F.col("at").alias("b")).alias("m"))
    return full.union(found).union(rest).groupBy("t1", "t2").agg(F.collect_set("m").alias("_starts"))


def remove_repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that are left)."""
    texts = distinct_texts(docs)
    # what several rows have goes as a whole
    starts = F.when(F.col("c") > 1, F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("_text") - LENGTH).alias("b")))).otherwise(F.col("_starts"))
    marked = texts.join(repeated_windows(texts, shard), ["t1", "t2"], "left").select("t1", "t2", "_text", starts.alias("_starts"))
    left = stored(map_batches(marked, _apply, "t1 bigint, t2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
    n = F.coalesce(F.octet_length("_text"), F.lit(0))
    d = _text_id(docs.select("doc_id", F.col("text").alias("_text")))
    d = stored(d.select("doc_id", "t1", "t2", n.cast("long").alias("n_bytes"), F.when(n < LENGTH, F.sha2(F.coalesce("_text", F.lit("")), 256)).alias("short")))
    none = F.lit(0).cast("long")
    d = d.join(left, ["t1", "t2"], "left")
    return d.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("short", "kept_sha256").alias("kept_sha256"))
