"""Language identification by a bidirectional gated recurrent network over bytes, trained and run in numpy.

Each position of a text is labelled: a forward and a backward recurrence read a segment of SEGMENT bytes, and their two
states at a byte give its language probabilities. A document's probabilities are the mean over all its positions. The
network learns by backpropagation through time on segments of a bounded sample of documents with a known language.

Defined cases: a text that is null or has no letter is ``und`` with score 0; null languages are not learned, nor such as
only held-out documents have; without any
known language everything is ``und``; repeated rows are labelled alike, whatever rows are beside them (scores have five
digits); very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_slices

SEGMENT, HIDDEN = 64, 8
#: Bounds of the training sample: documents of a language, bytes of one, and languages that have so many documents each;
#: of more languages all are learned, each from fewer documents.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_LANGUAGES = 300, 16384, 64
STEPS, BATCH, RATE, TRAIN_SEGMENT = 300, 128, 0.02, 48
_LANES = 4096


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Recurrence:
    """One direction: input rows (256, 3H) for gates z, r and candidate n, recurrent weights (H, 3H)."""

    def __init__(self, rng):
        h = HIDDEN
        self.w = rng.normal(0, 0.4, (256, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)

    def forward(self, steps: np.ndarray, keep: bool):
        """steps (T, N) of bytes -> states (T, N, H); with ``keep`` what the backward pass needs."""
        h = HIDDEN
        state = np.zeros((steps.shape[1], h), np.float32)
        out = np.empty((*steps.shape, h), np.float32)
        kept = []
        for t, byte in enumerate(steps):
            g = state @ self.u
            x = self.w[byte]
            zr = x[:, : 2 * h] + g[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (state - n)
            if keep:
                kept.append((state, z, r, n, g[:, 2 * h :]))
            out[t] = state = new
        return out, kept

    def backward(self, steps: np.ndarray, dout: np.ndarray, kept: list):
        h = HIDDEN
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        carry = np.zeros(dout.shape[1:], np.float32)
        gates = np.empty((*steps.shape, 3 * h), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            state, z, r, n, gn = kept[t]
            d = dout[t] + carry
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.hstack([dz, dr, dn * r])
            du += state.T @ dg
            carry = d * z + dg @ self.u.T
            gates[t] = np.hstack([dz, dr, dn])
        flat = gates.reshape(-1, 3 * h)
        for k in range(3 * h):
            dw[:, k] = np.bincount(steps.ravel(), flat[:, k], 256)
        return dw, du


class Labeller:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Recurrence(rng), Recurrence(rng)
        self.v = rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def _params(self):
        return [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.v, self.c]

    def gradients(self, steps: np.ndarray, y: np.ndarray):
        f, kf = self.ahead.forward(steps, True)
        b, kb = self.back.forward(steps[::-1], True)
        both = np.concatenate([f, b[::-1]], 2)
        z = both @ self.v + self.c
        p = np.exp(z - z.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p /= steps.size
        flat = both.reshape(-1, 2 * HIDDEN)
        dboth = p @ self.v.T
        dfw, dfu = self.ahead.backward(steps, dboth[:, :, :HIDDEN], kf)
        dbw, dbu = self.back.backward(steps[::-1], dboth[::-1, :, HIDDEN:], kb)
        return [dfw, dfu, dbw, dbu, flat.T @ p.reshape(-1, p.shape[2]), p.sum((0, 1))]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean language probabilities over the positions of each text (all zero for an empty one)."""
        count = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(t + bytes(-len(t) % SEGMENT) for t in texts), np.uint8).reshape(-1, SEGMENT)
        used = np.minimum(SEGMENT, np.repeat(size, count) - SEGMENT * (np.arange(len(data)) - np.repeat(np.cumsum(count) - count, count)))
        sums = np.zeros((len(data), len(self.languages)), np.float32)
        for i in range(0, len(data), _LANES):
            steps = np.ascontiguousarray(data[i : i + _LANES].T)
            f, _ = self.ahead.forward(steps, False)
            b, _ = self.back.forward(steps[::-1], False)
            z = f @ self.v[:HIDDEN]
            z += b[::-1] @ self.v[HIDDEN:]
            z += self.c
            np.exp(np.clip(z, -30, 30, out=z), out=z)
            z /= z.sum(2, keepdims=True)
            z *= (np.arange(SEGMENT)[:, None] < used[i : i + _LANES])[:, :, None]
            sums[i : i + _LANES] = z.sum(0)
        # each text's own segments are added up, so that no other text has a part in the last digits
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(count)
        if len(some):
            out[some] = np.add.reduceat(sums.astype(np.float64), np.cumsum(count[some]) - count[some], axis=0)
        return np.clip(np.round(out / np.maximum(size, 1)[:, None], 5), 0, 1)


def train(sample: list[tuple[str, str]], steps: int = STEPS, seed: int = 11) -> Labeller | None:
    """(language, text) pairs -> a trained network, or None without any."""
    texts: dict[str, list[np.ndarray]] = {}
    for lang, t in sample:
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        if len(raw):
            texts.setdefault(lang, []).append(raw if len(raw) >= TRAIN_SEGMENT else np.pad(raw, (0, TRAIN_SEGMENT - len(raw))))
    if not texts:
        return None
    net = Labeller(sorted(texts), seed)
    rng = np.random.default_rng(seed)
    params = net._params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(net.languages), BATCH)
        rows = []
        for k in y:
            mine = texts[net.languages[k]]
            raw = mine[rng.integers(len(mine))]
            at = rng.integers(len(raw) - TRAIN_SEGMENT + 1)
            rows.append(raw[at : at + TRAIN_SEGMENT])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, net.gradients(np.ascontiguousarray(np.stack(rows, 1)), y), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _sample(docs: DataFrame, modulus: int, held: int, rows: int, max_bytes: int, languages: int) -> list[tuple[str, str]]:
    """At most ``rows`` documents of each language, the first by a hash of the id, in one scan; of a language without texts of
    up to ``max_bytes`` bytes pieces of longer ones. Of over ``languages`` languages each has fewer documents."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % modulus != held))
    known = known.where(F.octet_length("text") > 0).withColumn("_long", F.octet_length("text") > max_bytes)
    counts = known.groupBy("lang").agg(F.sum((~F.col("_long")).cast("long")).alias("short"), F.count("*").alias("n")).collect()
    if not counts:
        return []
    each = max(1, min(rows, rows * languages // len(counts)))
    grid = 1 << 30
    # of many usable documents a share is ranked, far more than are needed
    shares = [(r["lang"], r["short"] == 0, min(grid, (2 * each + 50) * grid // (r["short"] or r["n"]))) for r in counts]
    wanted = docs.sparkSession.createDataFrame(shares, "lang string, _long boolean, _share long")  # a row a language
    nr = F.xxhash64("doc_id", F.lit("language"))
    fine = known.join(F.broadcast(wanted), ["lang", "_long"]).where(F.pmod(nr, F.lit(grid)) < F.col("_share"))
    width = max(1, max_bytes // 4)  # characters
    place = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - width, F.lit(0)) + 1).cast("int") + 1
    piece = F.when(F.col("_long"), F.substring(F.col("text"), place, F.lit(width))).otherwise(F.col("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(nr, "doc_id", F.xxhash64("text")))
    got = fine.select("lang", piece.alias("text"), "doc_id", rank.alias("_k")).where(F.col("_k") <= each).collect()
    got.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    return [(r["lang"], r["text"]) for r in got]


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, languages: int = SAMPLE_LANGUAGES):
    sample = _sample(docs, modulus, held, rows, max_bytes, languages)
    return train(sample, STEPS * max(1, -(-len({lang for lang, _ in sample}) // languages)))


def label_texts(model: Labeller | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    spoken = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    if model is None or not any(spoken):
        return ["und"] * len(texts), np.zeros(len(texts))
    p = model.probabilities([t.encode("utf-8", "surrogatepass") if s else b"" for t, s in zip(texts, spoken, strict=True)])
    best = p.argmax(1)
    return [model.languages[k] if s else "und" for k, s in zip(best, spoken, strict=True)], np.where(spoken, p.max(1), 0.0)


def languages(docs: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the language's probability)."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # some 12,000 numbers and 50 for a language
    d = docs.select("doc_id", held_out(4, 2).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        lang, score = label_texts(sent.value, texts)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_slices(d, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
