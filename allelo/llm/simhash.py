"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming distances, connected components.

Fingerprints that differ in at most ``distance`` bits agree on ``BLOCKS - distance`` of BLOCKS blocks of bits, so for each
choice of so many blocks the distinct fingerprints are dealt by their bits there, and pairs are verified within a bucket.
Equal fingerprints are one row from the start, so exact copies cost nothing. A bucket gives a spanning forest of its
links, never all its pairs. A bucket of over HOT fingerprints is dealt anew, as several buckets, by blocks of the bits that
are not in its key yet (2^16 different fingerprints at most are then left in one); within a task, buckets of over SPLIT_AT
are compared by finer blocks still (agreement on all but 12 bits), so work does not grow with the square of their size.

Defined cases: null and empty texts have fingerprint zero and link like any other; a row with null doc_id takes part, its
component is named by the smallest non-null doc_id, null if there is none; repeated rows share a component; very long texts
are read whole; columns of any name pass; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import bucketed
from .common import map_batches, map_slices, slices, stored, whole_row
from .components import connected_components
from .components import smallest_roots as _roots

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
SEED = 42
#: Buckets above this many fingerprints are compared by finer blocks; above HOT they are dealt anew.
SPLIT_AT, HOT = 2048, 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64 values."""
    import xxhash

    ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []  # bytes.split() cuts at exactly \\x20 \\x09-\\x0D
    if not ws:
        return 0
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(ws) - shingle + 1].tolist()
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    return set_fingerprint(h)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column ``text``) plus ``_fp``, the fingerprint as a signed long."""
    schema = docs.withColumn("_fp", F.lit(0).cast("long")).schema

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        fps = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, "_fp"])

    return map_slices(docs, run, schema)


def _masks(blocks: int, agree: int, within: int = (1 << 64) - 1) -> list[int]:
    """Masks of ``agree`` of the blocks into which the bits of ``within`` are cut."""
    bits = [b for b in range(64) if within >> b & 1]
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, agree)]


@lru_cache
def _fine_masks(distance: int) -> np.ndarray:
    return np.array(_masks(16, 16 - distance), np.uint64)


def _close_pairs(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal group (sorted) within the distance, as a spanning forest; ``fps`` has a row or a number each."""
    left, right = [], []
    at = np.arange(len(fps) - 1)
    for shift in range(1, len(fps)):
        at = at[at + shift < len(fps)]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        differ = np.bitwise_count(fps[at] ^ fps[at + shift])
        near = at[(differ if differ.ndim == 1 else differ.sum(1, dtype=np.int64)) <= distance]
        left.append(near)
        right.append(near + shift)
        if sum(map(len, left)) > 1 << 20:
            left, right = _forest(len(fps), left, right)
    return tuple(x[0] for x in _forest(len(fps), left, right))


def _forest(n: int, left: list, right: list) -> tuple[list, list]:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    root = _roots(n, a, b)
    member = np.flatnonzero(root != np.arange(n))
    return [root[member]], [member]


def bucket_links(group: np.ndarray, fps: np.ndarray, distance: int = DISTANCE, split_at: int = SPLIT_AT) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of fingerprints) that connect, within each group, exactly what pairs within the distance connect."""
    _, first, size = np.unique(group, return_index=True, return_counts=True)
    small = np.repeat((size > 1) & (size <= split_at), size)
    g, f = group[small], fps[small]
    a, b = _close_pairs(g, f, distance)
    out = [(f[a], f[b])]
    for start, n in zip(first[size > split_at].tolist(), size[size > split_at].tolist(), strict=True):
        f = fps[start : start + n]
        left, right = [], []
        for mask in _fine_masks(distance):
            key = f & mask
            o = np.argsort(key, kind="stable")
            a, b = _close_pairs(key[o], f[o], distance)
            left.append(o[a])
            right.append(o[b])
            left, right = _forest(n, left, right)
        out.append((f[left[0]], f[right[0]]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _link_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp) sorted by t and key -> links; a bucket may go over several batches."""
    held = [np.zeros(0, np.int64)] * 3

    def links(t, key, fp):
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]) if len(t) else np.zeros(0, bool)
        a, b = bucket_links(np.cumsum(new), fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    for batch in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
        t, key, fp = held
        if len(t) and len(t) >= 2 * SPLIT_AT:
            last = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield links(t[:done], key[:done], fp[:done])
                held = [h[done:] for h in held]
    yield links(*held)


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect what pairs within the distance connect."""
    masks = _masks(BLOCKS, BLOCKS - distance)
    key = lambda m: F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long"))
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), key(m).alias("key")) for i, m in enumerate(masks)])).alias("k"))
    dealt = dealt.select("k.t", "k.key", "fp")
    large = stored(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("t", "key", F.lit(True).alias("large")))
    dealt = dealt.join(large, ["t", "key"], "left")
    # each large bucket by blocks of the bits that its key has not
    anew, number = None, len(masks)
    for i, m in enumerate(masks):
        finer = _masks(BLOCKS, BLOCKS - distance, ((1 << 64) - 1) ^ m)
        keys = F.array(*[F.struct(F.lit(number + j).alias("t"), key(m | x).alias("key")) for j, x in enumerate(finer)])
        anew, number = F.when(F.col("t") == i, keys) if anew is None else anew.when(F.col("t") == i, keys), number + len(finer)
    again = dealt.where("large").select("fp", F.explode(anew).alias("k")).select("k.t", "k.key", "fp")
    dealt = dealt.where(F.col("large").isNull()).select("t", "key", "fp").union(again)
    dealt = dealt.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return map_batches(dealt, _link_partition, "u bigint, v bigint").distinct()


def components(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Materialised (doc_id, _fp) -> (fp, component_id), a row for each distinct fingerprint."""
    reps = stored(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("rep")))
    roots = connected_components(fingerprint_links(reps.select("fp"), distance))
    named = roots.join(reps, roots["node"] == reps["fp"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    r, k = reps.alias("r"), linked.alias("k")
    component = F.coalesce(F.col("k.component_id"), F.col("r.rep")).alias("component_id")
    # a table of its own, so that Spark can split a fingerprint that very many documents have when it is joined to them
    return stored(r.join(k, F.col("r.fp") == F.col("k.fp"), "left").select(F.col("r.fp").alias("fp"), component))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links)."""
    rows = stored(with_fingerprints(docs.select("doc_id", "text")).drop("text"))
    c = components(rows, distance)
    return rows.join(c, rows["_fp"] == c["fp"]).select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- documents that are similar as sets of shingles: fingerprints, then prefix filtering; exact similarity -------------

#: Documents that tell which shingles are common; from so many of them a shingle counts as common; so many, the most common
#: ones, have a rank (12 bytes each in every task: ranks change the order of work only, never the result).
SAMPLE, COMMON, RANKED = 10000, 3, 1 << 20
#: Rows of a shingle in one block; of a shingle with more, pairs of blocks are tasks of their own.
BLOCK = 512
#: Shingles of the sets in one block, whose numbers a task holds.
HELD = 1 << 22
#: Shingles before each one of a set that its postings carry, to tell whether a pair has met already.
BEFORE = 8
#: Times as many pairs of two components that a round compares as the one before it.
TRIED = 16
#: Words of a set's bits of parity, and the least and most of the folded ones that its postings carry.
PARITY, CARRIED = 8, (8, 64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: max(len(ws) - shingle + 1, 1)].tolist()
    stops = ends[min(shingle, len(ws)) - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64))


def parity(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set fall on each of some places, at least twice as many as the set has members: where two
    sets differ here, they do so in at least one hash of the place, so they have at least as many hashes apart as bits."""
    places = max(64 * PARITY, 1 << int(2 * len(h)).bit_length())
    count = np.bincount((h >> np.uint64(34)).astype(np.int64) % places, minlength=places)
    return np.packbits((count & 1).astype(bool), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bits of parity for fewer places."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def fold_levels(bits: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Bits of parity of several lengths -> the words of each, and by number of words a matrix of all that have so many or
    more, folded to it, with the row that each has there."""
    words = np.array([len(b) // 8 for b in bits], np.int64)
    levels = {}
    for n in np.unique(words).tolist():
        rows = np.cumsum(words >= n) - 1
        matrix = np.zeros((int((words >= n).sum()), n), np.uint64)
        for m in np.unique(words[words >= n]).tolist():
            which = np.flatnonzero(words == m)
            block = np.frombuffer(b"".join([bits[i] for i in which.tolist()]), np.uint64).reshape(-1, m)
            while block.shape[1] > n:
                block = block[:, : block.shape[1] // 2] ^ block[:, block.shape[1] // 2 :]
            matrix[rows[which]] = block
        levels[n] = rows, matrix
    return words, levels


def set_fingerprint(h: np.ndarray) -> int:
    """Bits set in over half of a set's hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have this Jaccard similarity or more; two empty ones have."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) < similarity * len(large) - 1e-9:
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _prefix(h: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's shingles, rare ones first: two sets of the similarity share one of them."""
    words, seen = common
    rank = np.zeros(len(h), np.int64)
    if len(words) and len(h):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        rank = np.where(words[at] == h, seen[at], 0)
    n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
    return h[np.argsort(rank, kind="stable")][:n]


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a bounded sample of texts hold, with their counts. They give the order of the shingles, on
    which the amount of work depends and the result does not."""
    n = docs.count()
    grid = 1 << 30
    some = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit("shingles")), F.lit(grid)) < min(grid, SAMPLE * grid // max(n, 1))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            h = np.concatenate([np.zeros(0, np.uint64), *map(shingle_set, texts)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["w"])

    n = map_batches(some, run, "w bigint").groupBy("w").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= COMMON)
    got = n.orderBy(F.col("n").desc(), "w").limit(RANKED).toArrow()
    words, seen = got.column("w").to_numpy().view(np.uint64), got.column("n").to_numpy()
    o = np.argsort(words)
    return words[o], seen[o]


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of up to BEFORE numbers as rows of a matrix, and how many each holds."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), BEFORE), np.int64)
    out[np.arange(BEFORE) < size[:, None]] = lists.flatten().to_numpy()
    return out, size


def _met(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Whether row k of ``x`` (its first ``xs[k]`` numbers) and row k of ``y`` share a number."""
    k = np.arange(BEFORE)
    return ((x[:, :, None] == y[:, None, :]) & (k < xs[:, None])[:, :, None] & (k < ys[:, None])[:, None, :]).any((1, 2))


def _pairs(similarity: float, cells: bool = False):
    """Rows (w, i, j, block, id, root, n, bits, before) sorted by w, i, j -> pairs of ids, in blocks i and j of shingle w and
    not yet connected, that can have the similarity by their sizes and their bits of parity. With ``cells``, rows (w, i, j, id,
    root, others) of the ids that are in such a pair, each pair among the others of one of its ids: as many rows as came at
    most, whatever the number of pairs.

    ``before`` holds the last BEFORE shingles under w, in the order of hashes, at which the set has rows too. A pair that shares
    one of them meets there as well, under the same conditions, so it is left out here: most pairs are passed on once, at the
    smallest shingle that they share, and none is lost."""

    def pairs(w, i, j, block, ids, root, n, bits, before, held) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(w) else np.zeros(0, bool)
        group = np.cumsum(new)
        words, levels = fold_levels(bits)
        at, found = np.arange(len(w)), []
        for shift in range(1, len(w)):
            at = at[at + shift < len(w)]
            at = at[group[at] == group[at + shift]]
            if not len(at):
                break
            to = at + shift
            ok = (root[at] != root[to]) & ((i[at] == j[at]) | (block[at] != block[to]))
            ok &= np.minimum(n[at], n[to]) >= similarity * np.maximum(n[at], n[to]) - 1e-6
            left, right = at[ok], to[ok]
            apart, both = np.zeros(len(left), np.int64), np.minimum(words[left], words[right])
            for k in np.unique(both).tolist():
                rows, matrix = levels[k]
                mine = both == k
                apart[mine] = np.bitwise_count(matrix[rows[left[mine]]] ^ matrix[rows[right[mine]]]).sum(1, dtype=np.int64)
            ok = apart <= (1 - similarity) / (1 + similarity) * (n[left] + n[right]) + 1e-6
            left, right = left[ok], right[ok]
            new = ~_met(before[left], held[left], before[right], held[right])
            if new.any() and cells:
                found.append((left[new], right[new]))
            elif new.any():
                yield pa.RecordBatch.from_arrays([pa.array(f(ids[left[new]], ids[right[new]])) for f in (np.minimum, np.maximum)], names=["u", "v"])
        if found:
            left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            o = np.argsort(left, kind="stable")
            member = np.union1d(left, right)
            ends = np.searchsorted(left[o], member, "right")
            others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids[right[o]]))
            yield pa.RecordBatch.from_arrays([pa.array(w[member]), pa.array(i[member], pa.int32()), pa.array(j[member], pa.int32()), pa.array(ids[member]), pa.array(root[member]), others], names=["w", "i", "j", "id", "root", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 7 + [[], np.zeros((0, BEFORE), np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:7]]
            columns += [batch.column(7).to_pylist(), *_matrix(batch.column(8))]
            held = [h + c if isinstance(h, list) else np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            w, i, j = held[:3]
            last = np.flatnonzero((w != w[-1]) | (i != i[-1]) | (j != j[-1])) if len(w) else []
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield from pairs(*[h[:done] for h in held])
                held = [h[done:] for h in held]
        yield from pairs(*held)

    return run


def _beside(pairs: DataFrame, side: str, other: str, of: DataFrame, block: int = BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """``pairs`` joined to the rows of ``of`` (bucketed by ``side``). The row of an id with over ``block`` pairs is copied for
    parts of these, which are tasks of their own: adaptive execution cannot split a join whose other side is not moved.
    ``counted`` are the same pairs before they were joined to anything."""
    n = (pairs if counted is None else counted).groupBy(side).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    hot = stored(n.select(side, F.ceil(F.col("_n") / block).cast("int").alias("_parts")))
    if hot.isEmpty():
        return pairs.join(of, side)
    copies = of.join(hot, side).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    split = pairs.join(hot, side).withColumn("_part", F.pmod(F.xxhash64(other), F.col("_parts")).cast("int")).drop("_parts")
    split = split.join(copies, [side, "_part"]).drop("_part")
    return pairs.join(hot, side, "left_anti").join(of, side).unionByName(split)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """The stored pairs (u, v) whose texts have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            keep = []
            for u, v, tu, tv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for k, t in ((u, tu), (v, tv)):
                    if k not in sets:
                        sets[k] = shingle_set(t)
                keep.append(similar(sets[u], sets[v], similarity))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    bare = pairs
    for side, other in (("v", "u"), ("u", "v")):
        pairs = _beside(pairs, side, other, texts.select(F.col("id").alias(side), F.col("text").alias(f"t{side}")), block, bare)
    return map_batches(pairs.select("u", "v", "tu", "tv"), run, "u bigint, v bigint")


def _possible(pairs: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """The pairs (u, v) that are not connected yet and can have the similarity by their sizes and bits of parity."""
    of, bare = sets.join(roots, "id", "left").select("id", "n", "parity", F.coalesce("root", "id").alias("root")), pairs
    for side, other in (("u", "v"), ("v", "u")):
        pairs = _beside(pairs, side, other, of.select(F.col("id").alias(side), *[F.col(c).alias(c + side) for c in ("n", "parity", "root")]), block, bare)
    n, m = F.col("nu"), F.col("nv")
    pairs = pairs.where((F.col("rootu") != F.col("rootv")) & (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6)).select("u", "v", "nu", "nv", "parityu", "parityv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*[[np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (4, 5)], strict=True)
            words = lambda x, y: min(len(x), len(y))
            apart = np.array([int(np.bitwise_count(folded(x, words(x, y)) ^ folded(y, words(x, y))).sum(dtype=np.int64)) for x, y in both], np.int64)
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(apart <= (1 - similarity) / (1 + similarity) * n + 1e-6))

    return map_batches(pairs, run, "u bigint, v bigint")


def _cell_links(similarity: float):
    """Rows (w, i, j, id, root, others, text) sorted by w, i, j -> links (u, v) between different roots that connect what all similar
    pairs of an id and its others connect. A pair whose ends are connected by then is not compared; all others are."""

    def links(cell: list[tuple]) -> Iterator[tuple]:
        root, sets, up = {k: r for k, r, *_ in cell}, {k: h for k, *_, h in cell}, {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for k, r, others, h in cell:
            for o in others:
                a, b = top(r), top(root[o])
                if a != b and similar(h, sets[o], similarity):
                    up[b] = a
                    yield min(k, o), max(k, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, found = None, [], []
        for batch, texts in slices(batches):
            for *at, k, r, others, t in zip(*[c.to_pylist() for c in batch.columns[:6]], texts, strict=True):
                if at != key:
                    found += links(cell)
                    key, cell = at, []
                cell.append((k, r, others, shingle_set(t)))
            yield link_batch(found)
            found = []
        yield link_batch([*links(cell)])

    def link_batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[e] for x in found], pa.int64()) for e in (0, 1)], names=["u", "v"])

    return run


def _links_in_cells(rows: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Rows for ``_pairs`` -> links that connect what all similar pairs connect. A pair never is a row: the ids of a cell (w, i, j)
    that are in candidate pairs meet again with their texts, once each, and the pairs are compared there."""
    rows = rows.repartition("w", "i", "j").sortWithinPartitions("w", "i", "j")
    members = stored(map_batches(rows, _pairs(similarity, True), "w bigint, i int, j int, id bigint, root bigint, others array<bigint>"))
    cells = _beside(members, "id", "w", texts, block).select("w", "i", "j", "id", "root", "others", "text")
    return map_batches(cells.repartition("w", "i", "j").sortWithinPartitions("w", "i", "j"), _cell_links(similarity), "u bigint, v bigint")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("id"), "root")


def _fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets that connect what fingerprints within DISTANCE bits connect."""
    first = stored(sets.groupBy("fp").agg(F.min("id").alias("first")))
    equal = sets.join(first, "fp").where(F.col("id") != F.col("first")).select(F.col("first").alias("u"), F.col("id").alias("v"))
    close = fingerprint_links(first.select("fp"))
    for side in "uv":
        close = close.withColumnRenamed(side, "fp").join(first.withColumnRenamed("first", f"id{side}"), "fp").drop("fp")
    return equal.union(close.select(F.least("idu", "idv"), F.greatest("idu", "idv"))).distinct()


def _links_between(pairs: DataFrame, sets: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, block: int = BLOCK) -> list[DataFrame]:
    """Stored pairs (u, v, a, b) of sets in the components a < b -> links that connect what all similar pairs connect; for pairs that
    are a table already (``similar_components`` makes none, see ``_links_in_cells``).

    One pair of each two components is compared at first, then up to TRIED times as many a round. Between rounds components
    grow together by the links found, and pairs inside one need no comparison any more; all others are compared."""
    links, tries = [], 1
    while not pairs.isEmpty():
        slot = F.pmod(F.xxhash64("u", "v", F.lit(tries)), F.lit(tries))
        some = pairs.groupBy("a", "b", slot.alias("_s")).agg(F.min(F.struct("u", "v")).alias("p")).select("p.u", "p.v", "a", "b")
        some = stored(some)
        good = stored(_verified(stored(_possible(some.select("u", "v"), sets, roots, similarity, block)), texts, similarity, block))
        links.append(good)
        met = _components(good.join(some, ["u", "v"]).select(F.col("a").alias("u"), F.col("b").alias("v")))
        # the components' new names by pair of components, of which there are far fewer than pairs of sets
        names = pairs.select("a", "b").distinct()
        for k in "ab":
            names = names.join(met.select(F.col("id").alias(k), F.col("root").alias(f"_{k}")), k, "left").withColumn(f"_{k}", F.coalesce(f"_{k}", k))
        names = stored(names.where(F.col("_a") != F.col("_b")).select("a", "b", F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")))
        rest = pairs.join(names, ["a", "b"]).join(some.select("u", "v"), ["u", "v"], "left_anti")
        pairs, tries = stored(rest.select("u", "v", F.col("_a").alias("a"), F.col("_b").alias("b"))), tries * TRIED
    return links


def similar_components(sets: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Different sets as (id, n, fp, prefix, bits, parity) and their texts (id, text) -> (id, root) of those that are linked to another.

    Fingerprints within DISTANCE bits are candidates at first, found by pigeonhole blocks. Sets of the similarity also share
    a shingle of their prefixes, so next every set is compared with the one of the smallest id at each of these, which
    connects most of a large group by few comparisons; then the sets at a shingle meet with their texts and are compared there
    until all of them are connected or known not to be similar. Only exact similarities make links, so this gives the components of all pairs.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *lists])), pa.array(ids)], names=["w", "id"])

    close = stored(_verified(stored(_fingerprint_pairs(sets)), texts, similarity, block))
    roots = _components(close)
    posts = map_batches(sets.select("id", "prefix"), post, "w bigint, id bigint")
    several = stored(posts.groupBy("w").agg(F.count("*").alias("c"), F.min("id").alias("first")).where(F.col("c") > 1).select("w", "first"))
    posts = stored(posts.join(several, "w"))
    star = stored(posts.where(F.col("id") != F.col("first")).select(F.col("first").alias("u"), F.col("id").alias("v")).distinct())
    star = stored(_possible(star, sets, roots, similarity, block))
    links = stored(close.union(_verified(star, texts, similarity, block)))
    roots = _components(links)
    rest = posts.select("w", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rest = stored(rest.join(sets.select("id", "n"), "id"))
    mixed = rest.groupBy("w").agg(F.count("*").alias("c"), F.sum("n").alias("held"), F.min("root").alias("a"), F.max("root").alias("b")).where(F.col("a") != F.col("b"))
    rest = rest.join(mixed.select("w", F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("held") / HELD)).cast("int").alias("_of")), "w")
    rest = rest.withColumn("before", F.collect_list("w").over(W.partitionBy("id").orderBy("w").rowsBetween(-BEFORE, -1)))  # an id's rows are its own shingles
    rest = rest.join(sets.select("id", "bits"), "id")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id", "w"), F.col("_of")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    rest = rest.select("w", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "id", "root", "n", "bits", "before")
    return _components(links.union(_links_in_cells(rest, texts, similarity, block)))


def _set_rows(similarity: float, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch, texts in slices(batches):
            ids, n, fps, prefix, bits, full = [], [], [], [], [], []
            for t in texts:
                h = shingle_set(t)
                ids.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                n.append(len(h))
                fps.append(set_fingerprint(h))
                prefix.append(_prefix(h, similarity, common.value).tobytes())
                full.append(parity(h))
                least, most = CARRIED
                bits.append(folded(full[-1], min(max(len(full[-1]), least), most)).tobytes())
            more = [pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary()), pa.array([x.tobytes() for x in full], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["_row", "_id", "_n", "_fp", "_prefix", "_bits", "_parity"])

    return run


def keep_one_similar(docs: DataFrame, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """One document, the one with the smallest doc_id (of repeated rows any), of each group of documents whose sets of
    5-word shingles have a Jaccard similarity of ``similarity`` or more, linked over each other; with its columns.

    Candidates come from fingerprints by pigeonhole blocks, and from shared shingles where those do not find them. Every
    such pair is decided by the sets themselves (of 64-bit hashes). A text under five words is one shingle;
    empty and null texts are copies of each other.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs))  # bounded by the sample
    packed = docs.select(whole_row(docs).alias("_row"), F.col("text"))
    schema = packed.drop("text").withColumns({"_id": F.lit(0).cast("long"), "_n": F.lit(0), "_fp": F.lit(0).cast("long"), "_prefix": F.lit(b""), "_bits": F.lit(b""), "_parity": F.lit(b"")}).schema
    rows = map_batches(packed, _set_rows(similarity, common), schema)
    # of each different set the document that would stay, in a table that no join moves again
    doc = F.col("_row")["doc_id"]
    one = F.struct("_row", *[F.col(f"_{c}").alias(c) for c in ("n", "fp", "prefix", "bits", "parity")])
    best = rows.groupBy(F.col("_id").alias("id")).agg(F.min_by(one, F.struct(doc.isNull().alias("n"), doc.alias("d"))).alias("b"))
    best = bucketed(best.select("id", "b.*"), "id")
    roots = similar_components(best.select("id", "n", "fp", "prefix", "bits", "parity"), best.select("id", F.col("_row")["text"].alias("text")), similarity, block)
    named = best.select("id", doc.alias("d")).join(roots, "id", "left").select("id", "d", F.coalesce("root", "id").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("n"), "d", "id")).alias("m")).select("m.id")
    return best.join(first, "id", "left_semi").select("_row.*")
