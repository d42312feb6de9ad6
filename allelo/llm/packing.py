"""Packing of documents into training windows by multiway differencing (Karmarkar and Karp).

A document's ids and one end id are cut into pieces: as many whole windows as it fills, which need no packing, and a rest in
pieces of at most PIECE ids. The pieces of a block of documents are partitioned over k windows: every piece begins as a
partial partition that has it in one window and nothing in the others, and the two partitions with the largest imbalance
(largest minus smallest window) are merged again and again, the fullest windows of one with the emptiest of the other, until
one is left. k is first the number of windows that the ids need at least; where a window then is above the capacity, k rises
and the block is partitioned anew. A partition's empty windows are not stored, so merging costs what the two partitions hold.

Each task packs what it reads, in blocks of BLOCK ids, so nothing is shuffled and a block's windows differ from those of an
equal partition by the differencing's imbalance only; a task's last block leaves a part of a window empty. Sequence numbers
hold the task's number and a count, so tasks that are run again give the same numbers for the same input partitions.

Ids are those of the vocabulary file of the ``tokenizers`` library, of the byte-level kind, as that library gives them without
added special tokens (special strings in a text are their ids). They are computed by the faster ``tiktoken`` from the same
file; a test compares both over all code points. A text of over CUT characters is encoded in parts, cut before a single blank
between two letters or digits of ASCII, where no token can lie across; without such a place it is encoded whole.

Defined cases: null and empty texts are the end id alone; repeated rows and null ids are documents of their own; a very long
document has many windows of its own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

CAPACITY = 1024
PIECE = 256
BLOCK = 1 << 20
END_ID = 0
CUT = 1 << 18
#: How a byte-level vocabulary divides texts before merging (a fixed value of that format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLACE = re.compile(r"[A-Za-z0-9]( )[A-Za-z0-9]")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding of a byte-level BPE file of the ``tokenizers`` library, as a ``tiktoken`` encoding."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, the others follow 255
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def text_parts(text: str, cut: int = CUT) -> Iterator[str]:
    """Parts of a text whose encodings joined are the text's."""
    start = 0
    while len(text) - start > cut and (place := _PLACE.search(text, start + cut - 2)):
        yield text[start : place.start(1)]
        start = place.start(1)
    yield text[start:]


def document_ids(text: str | None, path: str, end_id: int = END_ID) -> np.ndarray:
    """A text's ids and the end id."""
    encode = encoder(path).encode_to_numpy
    parts = [encode(p, allowed_special="all") for p in text_parts(text)] if text else []
    return np.concatenate([*parts, [end_id]]).astype("<u4")


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of ``k``, of each item, by multiway differencing."""
    # a partition: minus its imbalance, a number that makes ties definite, the filled windows' sizes (descending, the emptiest
    # window's size taken off where all k are filled) and their items as lists of first and last item
    after = np.full(len(sizes), -1, np.int64)
    open_ = [(-int(n), i, np.array([n], np.int64), np.array([i]), np.array([i])) for i, n in enumerate(sizes)]
    heapq.heapify(open_)
    number = len(sizes)
    while len(open_) > 1:
        _, _, a, first, last = heapq.heappop(open_)
        _, _, b, b_first, b_last = heapq.heappop(open_)
        both = max(len(a) + len(b) - k, 0)  # windows that are filled in both: the emptiest of a get the fullest there of b
        b, b_first, b_last = b[::-1], b_first[::-1], b_last[::-1]
        at = len(a) - both
        after[last[at:]] = b_first[:both]
        size = np.concatenate([a[:at], a[at:] + b[:both], b[both:]])
        order = np.argsort(-size, kind="stable")
        first = np.concatenate([first, b_first[both:]])[order]
        last = np.concatenate([last[:at], b_last])[order]
        size = size[order] - (size[order[-1]] if len(size) == k else 0)
        heapq.heappush(open_, (-int(size[0]), number, size, first, last))
        number += 1
    window = np.zeros(len(sizes), np.int64)
    for w, i in enumerate(open_[0][3].tolist() if open_ else []):
        while i >= 0:
            window[i] = w
            i = after[i]
    return window


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item, from 0, so that none is above the capacity (no item may be); the number of windows rises
    until that holds."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = -(-int(sizes.sum()) // capacity)
    while True:
        window = differencing(sizes, k)
        most = int(np.bincount(window, sizes, k).max())
        if most <= capacity:
            return window
        k += max(1, k * (most - capacity) // (2 * capacity))


def block_pieces(lengths: list[int], capacity: int = CAPACITY, piece: int = PIECE) -> np.ndarray:
    """Documents of these lengths -> rows (document, start, length, window, offset)."""
    whole, rest = [], []
    for i, n in enumerate(lengths):
        full = n - n % capacity
        whole += [(i, at, capacity) for at in range(0, full, capacity)]
        rest += [(i, at, min(piece, n - at)) for at in range(full, n, piece)]
    whole, rest = (np.array(x, np.int64).reshape(-1, 3) for x in (whole, rest))
    window = windows(rest[:, 2], capacity)
    order = np.argsort(window, kind="stable")
    window, rest = window[order], rest[order]
    offset = np.cumsum(rest[:, 2]) - rest[:, 2]
    new = np.concatenate([[True], window[1:] != window[:-1]]) if len(window) else np.zeros(0, bool)
    offset -= np.repeat(offset[new], np.diff([*np.flatnonzero(new), len(window)]))
    number = np.cumsum(new) - 1 + len(whole)
    one = np.column_stack([whole, np.arange(len(whole)), np.zeros(len(whole), np.int64)])
    return np.concatenate([one, np.column_stack([rest, number, offset])])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    if not 0 < piece <= capacity:
        raise ValueError("a piece must fit in a window")
    slim = docs.select("doc_id", "text")
    of = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {of}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        kind, names, ids, held = pa.int64(), [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            rows = block_pieces([len(x) for x in ids], capacity, piece)
            pieces = [ids[i][a : a + n].tobytes() for i, a, n in rows[:, :3].tolist()]
            ints = [pa.array(x, pa.int64()) for x in (rows[:, 1], rows[:, 2], np.array([len(ids[i]) for i in rows[:, 0]]), rows[:, 3] + number, rows[:, 4])]
            number += int(rows[:, 3].max()) + 1
            of = pa.array([names[i] for i in rows[:, 0].tolist()], kind)
            return pa.RecordBatch.from_arrays([of, *ints[:2], pa.array(pieces, pa.binary()), *ints[2:]], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch, texts in slices(batches):
            kind = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                names.append(name)
                ids.append(document_ids(text, path, end_id))
                held += len(ids[-1])
                if held >= block:
                    yield packed()
                    names, ids, held = [], [], 0
        if ids:
            yield packed()

    return map_batches(slim, run, schema)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """``pack`` with a digest of the ids in their place."""
    p = pack(docs, path)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
