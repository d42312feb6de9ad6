"""Document quality by a byte-level convolutional network, trained and run in numpy.

Bytes are embedded; learned filters over WIDTH bytes slide by STRIDE over overlapping chunks of CHUNK bytes that cover the
whole document; each filter's maximum over a chunk is taken, and over a document the greatest and the mean chunk maximum of
every filter go into one logistic output. The network learns by gradient descent (Adam) on a bounded sample of labelled
rows; its output is shifted to the share of good documents among all labelled rows.

Defined cases: null and empty texts are scored as an empty document; without labels of both kinds every score is the share
of label 1 (0.5 without labels); a score depends on the document's text alone, whatever rows are beside it; very long texts
are scored whole; an empty table gives an empty result; columns of any name pass through ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learn_sample, map_slices, whole_row

CHUNK, WIDTH, STRIDE, EMBED, FILTERS = 256, 8, 2, 6, 16
#: Bounds of the training sample: labelled documents, and bytes of one (of longer ones a piece at a hashed place).
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8192
EPOCHS, BATCH, RATE = 8, 32, 0.01


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each padded with zeros to whole chunks; chunks of each. WIDTH zeros begin a text, so the
    last windows of the text before it read zeros and no window reads bytes of two texts."""
    chunks = np.array([-(-(len(t) + WIDTH) // CHUNK) for t in texts], np.int64)
    out = bytearray()
    for t, n in zip(texts, chunks.tolist(), strict=True):
        out += bytes(WIDTH)
        out += t
        out += bytes(n * CHUNK - WIDTH - len(t))
    out += bytes(WIDTH)
    return np.frombuffer(bytes(out), np.uint8), chunks


class Network:
    """embed (256, EMBED), filters (WIDTH * EMBED, FILTERS), bias, out (2 * FILTERS), offset."""

    def __init__(self, seed: int = 7, offset: float = 0.0):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0
        self.offset = offset

    def chunk_maxima(self, data: np.ndarray, where: bool = False):
        """Maximum of each filter over each chunk before the bias; with ``where`` also the byte at which it begins."""
        n = (len(data) - WIDTH) // CHUNK
        x = self.p["embed"][data].ravel()
        best, at = None, None
        for r in range(0, WIDTH, STRIDE):
            view = x[r * EMBED : (r + n * CHUNK) * EMBED].reshape(-1, WIDTH * EMBED)  # windows of one phase lie side by side
            y = (view @ self.p["filters"]).reshape(n, CHUNK // WIDTH, FILTERS)
            m = y.max(1)
            if where:
                a = y.argmax(1) * WIDTH + r
                at = a if best is None else np.where(m > best, a, at)
            best = m if best is None else np.maximum(best, m)
        return (best, at + np.arange(n)[:, None] * CHUNK) if where else best

    def _pool(self, maxima: np.ndarray, chunks: np.ndarray):
        a = np.maximum(maxima + self.p["bias"], 0)
        starts = np.cumsum(chunks) - chunks
        top = np.maximum.reduceat(a, starts)
        mean = np.add.reduceat(a, starts) / chunks[:, None].astype(np.float32)
        return a, np.hstack([top, mean])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        data, chunks = _layout(texts)
        maxima = np.concatenate([self.chunk_maxima(data[i : i + (CHUNK << 10) + WIDTH]) for i in range(0, len(data) - WIDTH, CHUNK << 10)])
        z = self._pool(maxima, chunks)[1] @ self.p["out"] + self.p["out_bias"][0] + self.offset
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        data, chunks = _layout(texts)
        maxima, at = self.chunk_maxima(data, where=True)
        a, pooled = self._pool(maxima, chunks)
        z = pooled @ self.p["out"] + self.p["out_bias"][0]
        dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        doc = np.repeat(np.arange(len(chunks)), chunks)
        dtop, dmean = np.hsplit(dz[:, None] * self.p["out"], 2)
        da = (dmean / chunks[:, None])[doc] + np.where(a == pooled[doc, :FILTERS], dtop[doc], 0)
        da = np.where(a > 0, da, 0).astype(np.float32)
        window = data[at[..., None] + np.arange(WIDTH)]  # chunk, filter, byte: where each maximum was
        x = self.p["embed"][window].reshape(*window.shape[:2], -1)
        dx = (da[..., None] * self.p["filters"].T).reshape(-1, EMBED)
        flat = window.reshape(-1)
        de = np.stack([np.bincount(flat, dx[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
        de[0] = 0
        return {"embed": de, "filters": np.einsum("cf,cfx->xf", da, x), "bias": da.sum(0), "out": pooled.T @ dz, "out_bias": dz.sum(keepdims=True)}


def train(sample: list[tuple[int, str]], share: float, epochs: int = EPOCHS, seed: int = 7) -> Network | float:
    """A network, or the constant score where one class is missing."""
    y = np.array([k for k, _ in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return share
    texts = [t.encode("utf-8", "surrogatepass") for _, t in sample]
    seen = y.mean()
    net = Network(seed, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)) - np.log(seen / (1 - seen))))
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    step, total = 0, max(epochs * -(-len(y) // BATCH), 400)  # small samples get as many steps as large ones
    while step < total:
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            b = order[i : i + BATCH]
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (total + 1)))
            for k, g in net.gradients([texts[j] for j in b], y[b]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if step >= total:
                break
    return net


def score_texts(model: Network | float, texts: list[str | None]) -> np.ndarray:
    if not isinstance(model, Network):
        return np.full(len(texts), float(model))
    return model.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES):
    return train(*learn_sample(docs, labels, "quality", modulus, held, rows, max_bytes))


def with_scores(docs: DataFrame, model) -> DataFrame:
    """``docs`` (with a column ``text``) plus ``_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # about 3,000 numbers

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(sent.value, texts), pa.float64())], names=[*batch.schema.names, "_score"])

    return map_slices(docs, run, docs.withColumn("_score", F.lit(0.0)).schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (likelihood of label 1), predicted."""
    d = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return d.select("doc_id", held_out(3, 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    d = docs.select(whole_row(docs).alias("_row"), F.col("text"))
    return with_scores(d, fit(docs, labels)).where(F.col("_score") >= threshold).select("_row.*")
