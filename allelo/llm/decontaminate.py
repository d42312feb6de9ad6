"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is a slice of documents of some SLICE_BYTES of text. Its suffix array orders all word suffixes of those documents
(by their first DEPTH words; a separator after each document keeps matches within it), by prefix doubling; arrays are built
once and stored. Every suffix of the benchmark is then searched in every shard by bisection: the interval of the array
that begins with its first word is narrowed word by word. The interval after a whole window gives all places where the
window occurs, the last one that is not empty the suffix's longest verbatim match and where it is. Documents are
never shuffled for this; the benchmark comes to the shards in blocks of bounded size, one pass over the arrays for each.

Words are told apart by 64-bit hashes. Defined cases: null and empty texts have no words and no hits; a benchmark item
without words is never found; equal item ids count once, null ids as one item whose id is the empty text; an empty benchmark
leaves every document clean; repeated documents are judged alike; a very long text is a shard of its own; an empty table
gives an empty result; columns of any name pass through ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, stored, whole_row

WINDOW, DEPTH = 10, 1024
#: Bytes of benchmark text in a block that is sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Rows of a shard are large: Parquet is to look at its buffers after each.
_LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: A-Z in lower case, all other bytes outside words as blanks: words are runs of 0-9, a-z and of bytes from 0x80.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _folded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""


def fold_words(text: str | None) -> list[bytes]:
    return _folded(text).split()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, 0 after each text, and the number of words of each."""
    parts = [_folded(t) for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    edge = np.diff((data != 32).astype(np.int8), prepend=np.int8(0))
    start, length = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length -= start
    begin = np.cumsum(np.array([0] + [len(p) + 1 for p in parts]))
    count = np.diff(np.searchsorted(start, begin))
    out = np.zeros(len(start) + len(texts), np.uint64)
    if len(start):
        first = np.cumsum(length) - length
        power = np.multiply.accumulate(np.full(int(length.max()), _BASE))
        at = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(first, length).astype(np.int32)
        h = np.add.reduceat(_LETTER[data[data != 32]] * power[at], first)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        out[np.arange(len(start)) + np.repeat(np.arange(len(texts)), count)] = np.maximum(h, 1)
    return out, count


def suffix_array(ids: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The places of ``ids`` (0: a separator, different from all others) in the order of the suffixes there, which is settled
    by their first ``depth`` numbers."""
    n = len(ids)
    # as many numbers as fit in 62 bits at first; nothing counts after a separator
    base = int(ids.max(initial=0)) + 1
    k = max(1, int(62 / np.log2(max(base, 2))))
    padded = np.concatenate([ids, np.zeros(k, ids.dtype)])
    key, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        x = padded[i : i + n]
        ended |= x == 0
        key = key * base + np.where(ended, 0, x)
    sa = np.argsort(key)
    # which of equal ones that end comes first is told by their separators, so by their places
    slots, some = np.flatnonzero(ended[sa]), np.flatnonzero(ended)
    sa[slots] = some[np.argsort(key[some], kind="stable")]
    s = key[sa]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | ended[sa[1:]]]) if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(n + 1, -1)
    rank[sa] = group
    alone = new & np.append(new[1:], True) if n else new
    active = np.flatnonzero(~alone)
    while k < depth and len(active):
        p = sa[active]
        key = group[active] * (n + 2) + rank[np.minimum(p + k, n)] + 1
        o = np.argsort(key)
        p, key = p[o], key[o]
        sa[active] = p
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        rank[p] = group[active]
        active = active[~(new & np.append(new[1:], True))]
        k *= 2
    return sa


class Block:
    """A block of benchmark items: all words, and for each place its item, place in the item and words to the item's end."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        h, count = word_hashes([t for _, t in items])
        self.words, self.word = np.unique(h, return_inverse=True)
        self.names = sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        self.item = np.repeat(np.array([number[i] for i, _ in items], np.int64), count + 1)
        end = np.cumsum(count + 1) - 1
        self.left = np.repeat(end, count + 1) - np.arange(len(h))
        self.place = np.arange(len(h)) - np.repeat(end - count, count + 1)
        # a window is of so many words; only the first place of a shorter item begins one
        self.need = np.where(self.left >= window, window, np.where((self.place == 0) & (self.left > 0), self.left, 0))


def _narrow(ids: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each interval of suffixes that agree on ``depth`` words those whose next word is ``word``, by bisection."""
    bounds = []
    for after in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) >> 1
            w = ids[sa[mid] + depth]  # a match never ends the shard: a separator does
            less = w <= word[open_] if after else w < word[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        bounds.append(a)
    return bounds[0], bounds[1]


def search(block: Block, ids: np.ndarray, vocabulary: np.ndarray, sa: np.ndarray):
    """Every suffix of the block in a shard. For those whose window occurs: their place in the block, the interval of the
    window, the words of the longest match and its first place in the shard."""
    slot = np.minimum(np.searchsorted(vocabulary, block.words), len(vocabulary) - 1)
    word = np.where((vocabulary[slot] == block.words) & (block.words > 0), slot, -1)[block.word]
    bucket = np.searchsorted(ids[sa], np.arange(len(vocabulary) + 1))  # where the suffixes begin that start with a word
    q = np.flatnonzero((block.need > 0) & (word >= 0))
    lo, hi = bucket[word[q]], bucket[word[q] + 1]
    found: list[list] = [[], [], []]
    ends: list[list] = [[], [], []]
    depth = 1
    while len(q):
        whole = block.need[q] == depth
        for column, x in zip(found, (q, lo, hi), strict=True):
            column.append(x[whole])
        more = block.left[q] > depth
        a, b = lo.copy(), lo.copy()
        nxt = word[np.minimum(q + depth, len(word) - 1)]
        go = np.flatnonzero(more & (nxt >= 0) & (depth < DEPTH))
        a[go], b[go] = _narrow(ids, sa, lo[go], hi[go], depth, nxt[go])
        on = a < b
        over = ~on & (block.need[q] <= depth)  # here the longest match of the suffix ends
        for column, x in zip(ends, (q[over], np.full(int(over.sum()), depth), sa[lo[over]]), strict=True):
            column.append(x)
        q, lo, hi = q[on], a[on], b[on]
        depth += 1
    q, lo, hi = (np.concatenate([np.zeros(0, np.int64), *x]) for x in found)
    at, longest, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ends)
    o, e = np.argsort(q), np.argsort(at)
    return q[o], lo[o], hi[o], longest[e], place[e]


_SHARD = "n array<bigint>, ids binary, vocabulary binary, sa binary"


def build_shards(docs: DataFrame, key: Column) -> DataFrame:
    """Stored suffix arrays of ``docs``: a row for a shard, with the ``key`` of each of its documents."""
    d = docs.select(key.alias("key"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            h, count = word_hashes(texts)
            vocabulary, ids = np.unique(h, return_inverse=True)
            if len(vocabulary) and vocabulary[0]:
                vocabulary, ids = np.append(np.uint64(0), vocabulary), ids + 1
            bounds = pa.array([0, len(texts)], pa.int32())
            columns = [pa.ListArray.from_arrays(bounds, batch.column(0)), pa.ListArray.from_arrays(bounds, pa.array(count, pa.int64()))]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int32), vocabulary, suffix_array(ids).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "ids", "vocabulary", "sa"])

    kind = d.schema["key"].dataType.simpleString()
    rows = map_batches(d, run, f"key array<{kind}>, {_SHARD}")
    return stored(rows.withColumn("shard", F.monotonically_increasing_id()), _LARGE_ROWS)


_HITS = "shard bigint, at int, spans array<struct<a:bigint,b:bigint>>, items array<string>, matches array<struct<start:bigint,length:bigint,item_id:string,item_start:bigint>>"


def _search_block(shards: DataFrame, block) -> DataFrame:
    """Documents with hits, by shard and number in it: covered runs of words, items, and the longest matches that lie in it."""
    span_kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    match_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))

    def shard(b: Block, ids, vocabulary, sa, n) -> dict[int, tuple[list, set, list]]:
        q, lo, hi, longest, place = search(b, ids, vocabulary, sa)
        out: dict[int, tuple[list, set, list]] = {}
        if not len(q):
            return out
        begin = np.concatenate([[0], np.cumsum(np.array(n) + 1)])
        # equal windows of several places of the block have one interval: its occurrences are looked at once
        need = b.need[q]
        window, which = np.unique(np.stack([need, lo, hi], 1), axis=0, return_inverse=True)
        size = window[:, 2] - window[:, 1]
        of = np.repeat(np.arange(len(window)), size)
        at = sa[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + window[of, 1]]
        covered = np.cumsum(np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + window[of, 0], minlength=len(ids) + 1)) > 0
        edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0))
        docs = lambda x: np.searchsorted(begin, x, side="right") - 1
        for x, y, d in zip(edge[::2].tolist(), edge[1::2].tolist(), docs(edge[::2]).tolist(), strict=True):
            out.setdefault(d, ([], set(), []))[0].append({"a": x - int(begin[d]), "b": y - int(begin[d])})
        # windows with the same items are one set, so a passage of many items meets a document once
        pairs = np.unique(np.stack([which.ravel(), b.item[q]], 1), axis=0)
        cut = np.searchsorted(pairs[:, 0], np.arange(len(window) + 1))
        numbers: dict[bytes, int] = {}
        kinds = np.array([numbers.setdefault(pairs[x:y, 1].tobytes(), len(numbers)) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
        sets = [[b.names[i] for i in np.frombuffer(k, np.int64).tolist()] for k in numbers]
        for d, k in np.unique(np.stack([docs(at), kinds[of]], 1), axis=0).tolist():
            out[d][1].update(sets[k])
        item = b.item[q].tolist()
        rows = zip(docs(place).tolist(), (place - begin[docs(place)]).tolist(), longest.tolist(), item, b.place[q].tolist(), strict=True)
        for d, start, length, i, item_start in rows:
            out[d][2].append({"start": start, "length": length, "item_id": b.names[i], "item_start": item_start})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, n, ids, vocabulary, sa = (batch.column(k)[i].as_py() for k in range(5))
                got = shard(block.value, np.frombuffer(ids, np.int32), np.frombuffer(vocabulary, np.uint64), np.frombuffer(sa, np.int32), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(got), pa.int64()),
                        pa.array(list(got), pa.int32()),
                        pa.array([x[0] for x in got.values()], span_kind),
                        pa.array([sorted(x[1]) for x in got.values()], pa.list_(pa.string())),
                        pa.array([x[2] for x in got.values()], match_kind),
                    ],
                    names=["shard", "at", "spans", "items", "matches"],
                )

    return map_batches(shards.select("shard", "n", "ids", "vocabulary", "sa"), run, _HITS)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded bytes (an item over the bound alone), read one at a time; equal items come once."""
    block, held = [], 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where(F.col("t").isNotNull()).distinct()
    for r in items.orderBy("i", "t").toLocalIterator():
        if held and held + len(r["t"]) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r["i"], r["t"]))
        held += len(r["t"])
    if block:
        yield block


def find(shards: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored (shard, at, spans, items, matches) of the documents in which a window of an item occurs."""
    spark = shards.sparkSession
    hits = spark.createDataFrame([], _HITS)
    for items in _blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(Block(items, window))  # some 50 bytes a word of a block of bounded size
        hits = hits.union(stored(_search_block(shards, sent)))
        sent.unpersist()
    flat = lambda c: F.flatten(F.collect_list(c))
    return stored(hits.groupBy("shard", "at").agg(flat("spans").alias("spans"), F.array_distinct(flat("items")).alias("items"), flat("matches").alias("matches")))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, items, digest = [], [], []
        for spans, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            n = upto = 0
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                n += max(0, b - max(a, upto))
                upto = max(upto, b)
            hit.append(n)
            items.append(len(names or ()))
            digest.append(hashlib.sha256(",".join(sorted(names or ())).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _documents(shards: DataFrame) -> DataFrame:
    """(shard, at, key, n) of every document."""
    return shards.select("shard", F.posexplode(F.arrays_zip("key", "n"))).select("shard", F.col("pos").alias("at"), "col.key", "col.n")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words in occurrences of windows), n_items, items_sha256, contaminated."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = build_shards(docs, F.col("doc_id"))
    found = _documents(shards).join(find(shards, benchmark, **options), ["shard", "at"], "left").select(F.col("key").alias("doc_id"), "n", "spans", "items")
    return map_batches(found, _summary, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def longest_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(item_id, item_start, length, doc_id, start): for each suffix of an item its longest verbatim match over all documents,
    if of a window or more, in words, and a place of it."""
    shards = build_shards(docs, F.col("doc_id"))
    m = find(shards, benchmark, **options).select("shard", "at", F.explode("matches").alias("m")).join(_documents(shards), ["shard", "at"])
    best = m.groupBy("m.item_id", "m.item_start").agg(F.max(F.struct("m.length", F.col("key").alias("doc_id"), "m.start")).alias("b"))
    return best.select("item_id", "item_start", "b.length", "b.doc_id", "b.start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with their columns. Affected texts are told by 128 bits
    of hash; only these are compared with the documents, which are not shuffled where the affected ones are few."""
    t1, t2 = F.xxhash64("text"), F.xxhash64(F.lit("second"), F.col("text"))
    shards = build_shards(docs, F.struct(t1.alias("t1"), t2.alias("t2")))
    hit = find(shards, benchmark, **options).select("shard", "at").join(_documents(shards), ["shard", "at"]).select("key.t1", "key.t2").distinct()
    return docs.select(whole_row(docs).alias("_row"), t1.alias("t1"), t2.alias("t2")).join(stored(hit), ["t1", "t2"], "left_anti").select("_row.*")
