"""Packing, vector codes and the source audit against brute force and SQL, on awkward rows and empty tables."""

import heapq
import zlib
from itertools import count

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, SCHEMA, same_as_sql

from allelo.llm import codes, divergence, oracles, packing


PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# --- packing


def whole_vectors(sizes, k):
    """Differencing with all k windows written out."""
    number = count()
    heap = [(-n, next(number), [(n, [i])] + [(0, [])] * (k - 1)) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, b[::-1], strict=True)), key=lambda w: -w[0])
        c = [(n - c[-1][0], items) for n, items in c]
        heapq.heappush(heap, (-c[0][0], next(number), c))
    return heap[0][2]


@pytest.mark.parametrize("seed", range(6))
def test_differencing_is_that_of_whole_vectors(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 257, rng.integers(1, 90))
    k = int(rng.integers(1, 20))
    got = np.bincount(packing.differencing(sizes, k), sizes, k)
    want = [sum(int(sizes[i]) for i in items) for _, items in whole_vectors(sizes.tolist(), k)]
    assert sorted(got.tolist()) == sorted(want)


def test_windows_are_near_equal_and_rise():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 257, 4000)
    fill = np.bincount(packing.windows(sizes), sizes)
    assert fill.max() <= 1024 and fill.sum() == sizes.sum() and fill.min() > 1000
    assert len(np.unique(packing.windows(np.full(5, 600)))) == 5  # two windows more than the ids need
    assert len(packing.windows(np.zeros(0, np.int64))) == 0


def pieces_hold(rows, ids_of):
    """rows of ``pieces``, ids of each document in the order of the table -> padding."""
    want, fill = {}, {}
    for name, ids in ids_of:
        want.setdefault((name, len(ids)), []).append(ids)
    starts = {}
    for r in rows:
        assert 0 < r["length"] <= 1024
        ok = [x for x in want[r["doc_id"], r["doc_tokens"]] if zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]]
        assert ok
        starts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, docs in want.items():
        held = sum(n for _, n in starts[k])
        assert held == k[1] * len(docs)
        if len(docs) == 1:
            at = 0
            for s, n in sorted(starts[k]):
                assert s == at
                at += n
    assert len(starts) == len(want)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    return 1 - sum(n for p in fill.values() for _, n in p) / (1024 * len(fill))


def test_pieces(spark, library):
    odd = ["<|endoftext|> inside <|endoftext|>", "wörd " * 900 + "漢字" * 3000, "x" * 30_000, " \n\n  ", "a b" * 200_000]
    rows = ROWS + [(100 + i, t, None, None, 1, "f", "s", "r") for i, t in enumerate(odd)]
    got = packing.pieces(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    pieces_hold(got, [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in rows])


def test_little_padding(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    ids = library.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    assert pieces_hold(packing.pieces(docs, PATH).collect(), [(r["doc_id"], [*e.ids, 0]) for r, e in zip(rows, ids, strict=True)]) < 0.01


def test_sequences_of_blocks_do_not_meet(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), (F.col("id") % 90).cast("int")).alias("text"))
    got = packing.pack(docs.coalesce(1), PATH, block=2000).collect()
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(x)[-1][0] + sorted(x)[-1][1] == sum(n for _, n in x) <= 1024 for x in fill.values()) and len(fill) > 10


def test_parts_of_long_texts_and_all_code_points(library):
    e = packing.encoder(PATH)
    text = "it's a b c,  d e 12 3 'll <|endoftext|> x" * 40
    assert "".join(packing.text_parts(text, 7)) == text and max(map(len, packing.text_parts(text, 7))) < 40
    assert [i for p in packing.text_parts(text, 7) for i in e.encode(p, allowed_special="all")] == library.encode(text, add_special_tokens=False).ids
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"a{c} b{c}1 {c}{c} x {c} ." for c in points[at : at + 50_000]]
        assert [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)] == [e.encode(t, allowed_special="all") for t in texts]


def test_pack_of_nothing(spark):
    assert packing.pieces(spark.createDataFrame([], SCHEMA), PATH).collect() == []


# --- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, x string, code string"


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(float(np.float32(x)) * 1024)) for x in r[1]] for r in kept]
    w = -(-max(map(len, whole)) // parts)
    whole = [x + [0] * (parts * w - len(x)) for x in whole]
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for x in whole[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for x in whole:
                mine.setdefault(near(cut(x, p), books[p])[1], []).append(cut(x, p))
            for j, xs in mine.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for r, x in zip(kept, whole, strict=True):
        d = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{j:02x}" for _, j in d), sum(e for e, _ in d), r[2]))
    labels = {}
    for o in out:
        labels[o[3]] = labels.get(o[3], 0) + o[2]
    return [(i, c, e, labels[k]) for i, c, e, k in out], codes.digest(np.array(books))


def vector_rows(seed, n, length=8):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(0, 0.02, (n, length)) + rng.integers(0, 3, (n, 1)), 2).astype(np.float32)
    rows = [(i, v[i].tolist(), (None, 1, 2)[i % 3], "x", "c") for i in range(n)]
    rows += [(n, None, 1, "x", "c"), (n + 1, [None] + [0.5] * (length - 1), 1, "x", "c"), (n + 2, [float("nan")] + [0.0] * (length - 1), 2, "x", "c"), (n + 3, [float("inf")] * length, 2, "x", "c")]
    return rows + [rows[5], rows[5], (None, rows[7][1], None, "x", "c"), (3, rows[9][1], 2, "x", "c")]


@pytest.mark.parametrize("length", [8, 5, 64])
def test_codes_are_those_by_hand(spark, length):
    rows = vector_rows(length, 90, length) + [(-5, [0.25] * (length - 1), 1, "x", "c")]
    got = codes.code_table(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want, digest = codes_by_hand(rows)
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_are_those_of_sql(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    embeddings = pd.DataFrame(v.toPandas())  # noqa: F841
    want = duckdb.sql(oracles.ORACLES["op12_vector_codes"])
    got = codes.code_table(v).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("width", [1, 2, 7, 16])
def test_nearest_is_exact(width):
    rng = np.random.default_rng(width)
    centres = rng.integers(-3000, 3000, (12, width))
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-40, 40, (3000, width))).astype(np.int64)
    book = np.concatenate([x[:200], x[:20], centres]).astype(np.int64)
    d = np.square(x[:, None, :] - book).sum(2)
    index, best, measured = codes.nearest(x, book)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert width < 7 or measured < d.size / 4  # the bounds drop most entries of a clustered table


def test_too_large_components_are_an_error():
    import pyarrow as pa

    with pytest.raises(ValueError):
        codes.integer_rows(pa.array([[3e38, 1.0]], pa.list_(pa.float64())))


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1, "x", "c"), (2, [float("nan")], None, "x", "c")]):
        got = codes.code_table(spark.createDataFrame(rows, VECTORS))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.collect() == []


# --- source audit


def test_divergence_is_that_of_sql(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "HELD", 50)
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Été", "été", "漢", "aé", "ab", "\U0001f600"]
    rows = list(ROWS)
    for i in range(400):
        t = " ".join(rng.choice(words[: 20 + i % 13], rng.integers(0, 30)))
        rows.append((i, t, ("en", "de", None, "", "fr")[i % 5] if i < 390 else "xx", ("s1", "s2", None, "é", "z")[i % 4 + (i % 7 == 0)], 1, "f", "s", "r"))
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3))
    same_as_sql(got, oracles.ORACLES["op13_source_divergence"], rows)
    assert got.where("part = 'term'").count() > 20 and got.where("part = 'pair' and value = 0").count() > 0


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact_and_long_texts_are_read_in_parts():
    rng = np.random.default_rng(1)
    total = rng.integers(1 << 40, 9 * 10**15, 200)
    n = (total * rng.random(200)).astype(np.int64)
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]
    text = ("Ab é漢c, D1 " * 3000).encode()
    assert [t for p in divergence.term_parts(text, 64) for t in p] == text.translate(divergence._TERM).split()
