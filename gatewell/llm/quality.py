"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover every byte. In each chunk, learned filters slide over WIDTH
bytes at a time (a filter is a table of one weight per offset and byte value), their responses are max-pooled over
the chunk, and a small tanh layer turns the pooled responses and the chunk's length into a logit. The mean logit over
all chunks gives the document's probability. Training is plain minibatch Adam on a bounded balanced sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.llm import common

WIDTH, CHUNK, STRIDE, FILTERS, HIDDEN = 4, 256, 192, 24, 16
PAD = 0xFF  # never occurs in UTF-8; the filters give it no weight
BATCH = 2048  # chunks scored at once, which bounds the temporaries
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


@dataclass
class Network:
    conv: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray  # (FILTERS + 1, HIDDEN); the last input is the chunk's share of CHUNK
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filter responses of byte chunks (n, CHUNK) and where the maxima stand."""
        span = chunks.shape[1] - WIDTH + 1
        response = np.take(self.conv[0], chunks[:, :span], axis=0)
        for j in range(1, WIDTH):
            response += np.take(self.conv[j], chunks[:, j : j + span], axis=0)
        at = response.argmax(axis=1)
        return np.take_along_axis(response, at[:, None, :], axis=1)[:, 0, :] + self.bias, at

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        span = chunks.shape[1] - WIDTH + 1
        best = np.full((len(chunks), FILTERS), -np.inf, np.float32)
        for lo in range(0, span, 64):  # a few positions at a time stay in the cache
            hi = min(span, lo + 64)
            response = np.take(self.conv[0], chunks[:, lo:hi], axis=0)
            for j in range(1, WIDTH):
                response += np.take(self.conv[j], chunks[:, lo + j : hi + j], axis=0)
            np.maximum(best, response.max(axis=1), out=best)
        return self._head(best + self.bias, chunks)[0]

    def _head(self, pooled: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        share = (chunks != PAD).mean(axis=1, dtype=np.float32)[:, None]
        inputs = np.concatenate([np.maximum(pooled, 0), share], axis=1)
        hidden = np.tanh(inputs @ self.dense + self.dense_bias)
        return hidden @ self.out + self.out_bias, hidden, inputs


def cut(text: str | None) -> np.ndarray:
    """All chunks of a text: (n, CHUNK) bytes, each byte in at least one. An empty text is one chunk of padding."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = 1 + max(0, -(-(len(data) - CHUNK) // STRIDE))
    padded = np.full((n - 1) * STRIDE + CHUNK, PAD, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def train(samples: list[tuple[int, str]], steps: int = 600, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network | None:
    """Fit to (label 0 or 1, text); None unless both labels occur. Classes are drawn equally often."""
    by_label = [[cut(t) for y, t in samples if y == label] for label in (0, 1)]
    if not all(by_label):
        return None
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 0.3, HIDDEN).astype(np.float32), 0.0)
    net.conv[:, PAD] = 0
    names = ("conv", "bias", "dense", "dense_bias", "out", "out_bias")
    mean = {k: np.zeros_like(getattr(net, k), dtype=np.float32) for k in names}
    square = {k: np.zeros_like(getattr(net, k), dtype=np.float32) for k in names}
    for step in range(1, steps + 1):
        labels = np.arange(batch) % 2
        chunks = np.stack([(d := by_label[y][rng.integers(len(by_label[y]))])[rng.integers(len(d))] for y in labels])
        for k in np.flatnonzero(rng.random(batch) < 0.3):  # short texts are rare: some chunks are shortened
            chunks[k, rng.integers(4, CHUNK) :] = PAD
        pooled, at = net.pooled(chunks)
        logit, hidden, inputs = net._head(pooled, chunks)
        error = ((1 / (1 + np.exp(-logit)) - labels) / batch).astype(np.float32)
        back = error[:, None] * net.out * (1 - hidden**2)
        to_pooled = (back @ net.dense.T)[:, :FILTERS] * (pooled > 0)
        conv = np.zeros_like(net.conv)
        rows, filters = np.arange(batch)[:, None], np.broadcast_to(np.arange(FILTERS), at.shape)
        for j in range(WIDTH):
            np.add.at(conv[j], (chunks[rows, at + j], filters), to_pooled)
        conv[:, PAD] = 0
        grads = {"conv": conv, "bias": to_pooled.sum(0), "dense": inputs.T @ back, "dense_bias": back.sum(0), "out": hidden.T @ error, "out_bias": np.float32(error.sum())}
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in names:
            decay = 1e-4 if k in ("conv", "dense") else 0
            g = grads[k] + decay * getattr(net, k)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            setattr(net, k, getattr(net, k) - pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6))
    net.conv = np.ascontiguousarray(net.conv, np.float32)
    return net


def score_texts(net: Network | None, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each whole text; 0.5 without a network."""
    if net is None:
        return np.full(len(texts), 0.5)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    waiting: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            who = np.concatenate(owner)
            total[:] += np.bincount(who, net.logits(np.concatenate(waiting)), len(texts))
            count[:] += np.bincount(who, minlength=len(texts))
            waiting.clear()
            owner.clear()
            held = 0

    for k, t in enumerate(texts):
        chunks = cut(t)
        for lo in range(0, len(chunks), BATCH):
            waiting.append(chunks[lo : lo + BATCH])
            owner.append(np.full(len(waiting[-1]), k))
            held += len(waiting[-1])
            if held >= BATCH:
                flush()
    flush()
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1), -500, 500)))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 300, max_chars: int = 50_000) -> list[tuple[int, str]]:
    """At most per_label whole texts of each label, none longer than max_chars: the bound of what training sees.

    The sample is drawn from the labels first, so documents are joined with a few hundred ids only. Of an id's texts
    beyond four times as many in all, those with the least hashes are taken.
    """
    narrow = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label in (0, 1)")
    chosen = {r["id"]: r["label"] for r in sorted(common.sample_by_label(narrow, "label", ["id"], per_label))}
    if not chosen:
        return []
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isin(list(chosen))).filter(F.length("text") <= max_chars)
    rows = texts.orderBy(F.xxhash64("id", "text"), "id", "text").limit(8 * per_label).collect()
    return [(chosen[r["id"]], r["text"]) for r in sorted(rows)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", modulus: int = 3, hold: int = 1) -> Network | None:
    """Train on labels outside the held-out fold."""
    return train(training_sample(docs, labels.filter(~common.held_out(id_col, modulus, hold)), id_col))


def classify(docs: DataFrame, net: Network | None, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with a struct column `out` (score, predicted); a column of that name is replaced.

    Every row is kept, repeated rows included. Null counts as the empty text, which gets a score like any other. Long
    texts are scored whole, some thousand chunks at a time; an empty table stays empty; a score of exactly 0.5, as all
    rows get where there was nothing to learn from, is predicted 1.
    """
    shared = common.broadcast(docs.sparkSession, net)

    @F.arrow_udf(RESULT)
    def scored(texts: pa.Array) -> pa.Array:
        scores = score_texts(shared.value, texts.to_pylist())
        common.tidy()
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["score", "predicted"])

    return docs.withColumn(out, scored(F.col(text_col)))
