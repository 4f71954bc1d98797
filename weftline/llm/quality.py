"""Quality classifier: a byte-level convolutional network in numpy (operator 3).

Bytes are embedded, learned filters slide over them, and the filters' values are max-pooled over overlapping chunks that
cover the whole text. A hidden layer reads each chunk, its units are max-pooled over the chunks, and a logistic unit
combines them into one probability. A unit with negative weights answers to what a chunk lacks, such as variety.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.arrows import slices
from weftline.llm.common import bounded_batches, crc_mod, free_name, table

#: Bytes a filter sees (WIDTH) and moves on by (STRIDE), and the bytes of half a chunk; chunks overlap by half.
WIDTH, STRIDE, HALF = 8, 4, 256
EMBED, FILTERS, HIDDEN = 8, 32, 24
#: About how many labelled documents are learned from at most, and about how many bytes they have in all; each is whole.
SAMPLE, SAMPLE_BYTES = 6_000, 16_000_000
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.006, 5
#: The half chunks that are worked on at a time.
BLOCK = 1024


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each filled up with zeros to whole half chunks and at least one zero window, and their halves."""
    halves = np.array([(len(x) + STRIDE) // HALF + 1 for x in texts], dtype=np.int64)
    flat = b"".join(x.ljust(k * HALF, b"\0") for x, k in zip(texts, halves.tolist(), strict=True))
    return np.frombuffer(flat, dtype=np.uint8), halves


@dataclass
class Network:
    """The weights: ``embed`` (256 x E), ``conv`` (WIDTH * E x FILTERS) with ``bias``, ``hidden``, ``out``."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda *s, scale: draw.normal(0, scale, s).astype(np.float32)
        return cls(normal(256, EMBED, scale=0.5), normal(WIDTH * EMBED, FILTERS, scale=0.25), np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN, scale=0.25), np.full(HIDDEN, 0.1, np.float32), normal(HIDDEN, scale=0.3), np.zeros(1, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def half_maxima(self, data: np.ndarray, halves: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's highest value in each half chunk before the activation and, if asked for, the window that has it.

        A text's last window sees zero bytes beyond its end. The work goes on in blocks, so that a very long text takes
        little more memory than its own bytes.
        """
        n, per = len(data) // HALF, HALF // STRIDE
        low, high = self.conv[: STRIDE * EMBED], self.conv[STRIDE * EMBED :]
        beyond = np.tile(self.embed[0], STRIDE) @ high
        ends = last_windows(halves)
        best, won = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if places else None
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            steps = self.embed[data[a * HALF : b * HALF + STRIDE]].reshape(-1, STRIDE * EMBED)
            if b == n:
                steps = np.concatenate([steps, np.zeros((1, STRIDE * EMBED), np.float32)])
            values, after = steps[:-1] @ low + self.bias, steps[1:] @ high
            after[ends[np.searchsorted(ends, a * per) : np.searchsorted(ends, b * per)] - a * per] = beyond
            values = (values + after).reshape(-1, per, FILTERS)
            if places:
                at = values.argmax(axis=1)
                best[a:b] = np.take_along_axis(values, at[:, None, :], axis=1)[:, 0, :]
                won[a:b] = at + np.arange(a, b)[:, None] * per
            else:
                best[a:b] = values.max(axis=1)
        return best, won

    def chunks(self, data: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled filters of each chunk, the number of chunks of each text, and the windows that won."""
        best, won = self.half_maxima(data, halves, True)
        first, second, count = chunk_halves(halves)
        right = best[second] > best[first]
        return np.maximum(np.where(right, best[second], best[first]), 0), count, np.where(right, won[second], won[first])

    def predict(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        data, halves = padded(texts)
        best, _ = self.half_maxima(data, halves)
        first, second, count = chunk_halves(halves)
        units = np.maximum(np.maximum(np.maximum(best[first], best[second]), 0) @ self.hidden + self.hidden_bias, 0)
        pooled = np.maximum.reduceat(units, np.cumsum(count) - count)
        return 1 / (1 + np.exp(-(pooled @ self.out + self.out_bias).astype(np.float64)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss; max-pooling sends them to the winning chunks and windows only."""
        data, halves = padded(texts)
        feats, count, won = self.chunks(data, halves)
        raw = feats @ self.hidden + self.hidden_bias
        starts = np.cumsum(count) - count
        pooled, place = np.empty((len(texts), HIDDEN), np.float32), np.empty((len(texts), HIDDEN), np.int64)
        for i, (a, k) in enumerate(zip(starts.tolist(), count.tolist(), strict=True)):
            place[i] = raw[a : a + k].argmax(axis=0) + a
            pooled[i] = raw[place[i], np.arange(HIDDEN)]
        active = np.maximum(pooled, 0)
        miss = (1 / (1 + np.exp(-(active @ self.out + self.out_bias))) - labels).astype(np.float32) / len(texts)
        back = miss[:, None] * self.out * (pooled > 0)
        d_raw = np.zeros_like(raw)
        np.add.at(d_raw, (place, np.arange(HIDDEN)[None, :]), back)
        d_feats = (d_raw @ self.hidden.T) * (feats > 0)
        rows, cols = np.nonzero(d_feats)
        g, at = d_feats[rows, cols], won[rows, cols]
        seen = np.append(data, np.zeros(STRIDE, np.uint8))[at[:, None] * STRIDE + np.arange(WIDTH)]
        seen[np.isin(at, last_windows(halves)), STRIDE:] = 0
        inputs = self.embed[seen].reshape(len(at), -1)
        d_conv = np.zeros_like(self.conv)
        d_embed = np.zeros_like(self.embed)
        for f in range(FILTERS):
            own = cols == f
            d_conv[:, f] = g[own] @ inputs[own]
        spread = (g[:, None] * self.conv.T[cols]).reshape(-1, EMBED)
        for e in range(EMBED):
            d_embed[:, e] = np.bincount(seen.ravel(), spread[:, e], minlength=256)
        return [d_embed, d_conv, np.bincount(cols, g, minlength=FILTERS).astype(np.float32), feats.T @ d_raw, d_raw.sum(axis=0), active.T @ miss, miss.sum(keepdims=True)]


def last_windows(halves: np.ndarray) -> np.ndarray:
    """The last window of each text."""
    return np.cumsum(halves) * (HALF // STRIDE) - 1


def chunk_halves(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and second half of each chunk, and the chunks of each text: a text of one half is one chunk."""
    count = np.maximum(halves - 1, 1)
    begins = np.repeat(np.cumsum(halves) - halves - np.cumsum(count) + count, count)
    first = np.arange(int(count.sum())) + begins
    return first, first + np.repeat((halves > 1).astype(np.int64), count), count


def fit(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> Network:
    """Adam over mini-batches of whole texts. Without rows the network stays as drawn."""
    net, draw = Network.fresh(seed), np.random.default_rng(seed)
    if not texts:
        return net
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    net.out_bias[0] = np.log(share / (1 - share))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step = 0
    total = EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = draw.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for w, d, (m, v) in zip(net.weights(), net.gradients([texts[j] for j in own], labels[own]), moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(w.dtype)
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """A network fitted on rows of ``labels`` (doc_id, quality), drawn by a hash, with their whole texts.

    About ``sample`` rows are drawn, or fewer, so that about ``sample_bytes`` of text come together; that bounds what the
    driver learns from at any size of the corpus. Null labels and texts are left out, repeated rows count as often as
    they occur, and without rows the network stays as drawn.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull())
    # what is learned from is counted alone, not texts without labels or of other folds
    sizes = texts.select("doc_id", F.length("text").cast("long").alias("size")).join(known, "doc_id")
    n, size = sizes.agg(F.count("*"), F.sum("size")).first()
    share = min(1.0, sample / n, sample_bytes / max(size, 1)) if n else 0.0
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < share * 1_000_000
    drawn = texts.where(draw).join(known.where(draw), "doc_id")
    rows = drawn.select(F.xxhash64("text").alias("place"), "quality", "text").collect()
    rows.sort(key=lambda r: (r["place"], r["quality"]))
    return fit([bytes(r["text"]) for r in rows], np.array([float(r["quality"] > 0) for r in rows], dtype=np.float32))


def score(docs: DataFrame, net: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (the probability of label 1) and ``predicted`` (1 if the score reaches ``threshold``).

    Every byte of every text counts; a null text scores as an empty one; equal texts score alike in whatever rows; an
    empty table gives no rows. Where ``docs`` has columns of those names, the new ones' names get an underscore more.
    """
    bounded_batches(docs.sparkSession)
    at, width = docs.columns.index(text_col), len(docs.columns)
    slim = docs.toDF(*(f"c{k}" for k in range(width)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1_000_000):
            p = net.predict(pc.fill_null(batch.column(at).cast(pa.large_binary()), b"").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    scored = slim.mapInArrow(work, slim.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
    return scored.toDF(*docs.columns, free_name("score", docs.columns), free_name("predicted", docs.columns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    scored = score(docs.withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0), learn(docs, labels))
    return scored.select("doc_id", "held_out", "score", "predicted")
