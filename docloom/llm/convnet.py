"""Text quality by a convolutional network over bytes, in numpy.

A text's UTF-8 bytes lie in overlapping chunks, so that no filter misses a place. Bytes are embedded, filters slide
over each chunk and are max-pooled in it; the chunks' maxima are combined by their maximum, mean and minimum into one
probability (a passage that says one thing over and over shows in the minimum). The network is fitted on a bounded sample of labelled rows in the driver, where the gradient of a maximum
goes to the window that gave it, and applied to every whole text in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import pieces

#: Bytes of a chunk, bytes from one chunk to the next, bytes under a filter; the byte that fills up the last chunk.
CHUNK, STEP, WIDTH, PAD = 512, 448, 7, 256
#: Chunks that are scored at a time: windows of 64 chunks take 7 MB.
AT_ONCE = 64
POSITIONS = CHUNK - WIDTH + 1


def chunks_of(text: bytes) -> np.ndarray:
    """The overlapping chunks that cover a text, the last one up to its end; only a text below one chunk is filled up."""
    flat = np.full(max(len(text), CHUNK), PAD, np.int16)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    last = len(flat) - CHUNK
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[[*range(0, last, STEP), last]]


@dataclass
class Network:
    """embed (257 x e), filters (WIDTH * e x f), bias (f), out (3 f + 1: maxima, means, minima, constant)."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray

    @classmethod
    def fresh(cls, seed: int, embed: int = 8, filters: int = 32) -> Network:
        rng = np.random.default_rng(seed)
        start = rng.normal(0, 0.5, (257, embed))
        start[PAD] = 0
        return cls(*[a.astype("f4") for a in (start, rng.normal(0, (WIDTH * embed) ** -0.5, (WIDTH * embed, filters)), np.zeros(filters), rng.normal(0, 0.1, 3 * filters + 1))])

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each chunk's maximum of every filter (at least 0), and where it lies."""
        best, at = np.empty((len(chunks), len(self.bias)), "f4"), np.empty((len(chunks), len(self.bias)), np.int64)
        for i in range(0, len(chunks), AT_ONCE):
            x = self.embed[chunks[i : i + AT_ONCE]]
            windows = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), WIDTH * x.shape[2], axis=1)[:, :: x.shape[2]]
            y = (windows.reshape(-1, windows.shape[2]) @ self.filters).reshape(len(x), POSITIONS, -1)
            at[i : i + AT_ONCE] = y.argmax(1)
            best[i : i + AT_ONCE] = y.max(1)
        return np.maximum(best + self.bias, 0), at

    def maxima(self, chunks: np.ndarray) -> np.ndarray:
        best = np.empty((len(chunks), len(self.bias)), "f4")
        for i in range(0, len(chunks), AT_ONCE):
            x = self.embed[chunks[i : i + AT_ONCE]]
            windows = np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), WIDTH * x.shape[2], axis=1)[:, :: x.shape[2]]
            best[i : i + AT_ONCE] = (windows.reshape(-1, windows.shape[2]) @ self.filters).reshape(len(x), POSITIONS, -1).max(1)
        return np.maximum(best + self.bias, 0)

    def probabilities(self, best: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One probability a text from its chunks' maxima; text i has the chunks from starts[i] on."""
        counts = np.diff(np.append(starts, len(best)))[:, None]
        features = np.hstack([np.maximum.reduceat(best, starts), np.add.reduceat(best, starts) / counts, np.minimum.reduceat(best, starts)])
        return 1 / (1 + np.exp(-np.clip(features @ self.out[:-1] + self.out[-1], -30, 30).astype("f8")))


def _first_of(found: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The first row of each text that is marked, by column."""
    earlier = np.cumsum(found, 0) - found
    return found & (earlier == earlier[starts][owner])


def trained(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 4e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """A network fitted by Adam on the logistic loss of whole texts."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    e, f = net.embed.shape[1], len(net.bias)
    params = [net.embed, net.filters, net.bias, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    net.out[-1] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    parts = [chunks_of(t) for t in texts]
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            chunks = np.concatenate([parts[i] for i in rows])
            counts = np.array([len(parts[i]) for i in rows])
            starts = np.cumsum(counts) - counts
            best, at = net.pooled(chunks)
            owner = np.repeat(np.arange(len(rows)), counts)
            top, low = np.maximum.reduceat(best, starts), np.minimum.reduceat(best, starts)
            features = np.hstack([top, np.add.reduceat(best, starts) / counts[:, None], low, np.ones((len(rows), 1), "f4")])
            error = (1 / (1 + np.exp(-np.clip(features @ net.out, -30, 30))) - labels[rows]) / len(rows)
            # a maximum or minimum passes its error on to the chunk that gave it, a mean to all
            is_top, is_low = _first_of(best == top[owner], starts, owner), _first_of(best == low[owner], starts, owner)
            back = error[owner, None] * (is_top * net.out[:f] + net.out[f : 2 * f] / counts[owner, None] + is_low * net.out[2 * f : 3 * f])
            back = (back * (best > 0)).astype("f4")
            g_filters, g_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            number = np.arange(len(chunks))[:, None]
            for j in range(WIDTH):
                codes = chunks[number, at + j]  # the byte under place j of each filter's best window
                here = net.embed[codes]
                g_filters[j * e : (j + 1) * e] = np.einsum("nf,nfe->ef", back, here)
                flow = back[:, :, None] * net.filters[j * e : (j + 1) * e].T[None]
                for k in range(e):
                    g_embed[:, k] += np.bincount(codes.ravel(), flow[:, :, k].ravel(), 257)
            g_embed[PAD] = 0
            grads = [g_embed, g_filters, back.sum(0), features.T @ error]
            step += 1
            now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return net


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are never learnt from: crc32 of the decimal id divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = 2_000, most_bytes: int = 8_000_000) -> list[tuple[bytes, int]]:
    """Texts and labels to learn from: at most `most_rows` rows and `most_bytes` bytes of text.

    Of the labelled ids that aren't held out, `most_rows` are drawn by a hash; then rows in hash order while their texts
    add up to at most `most_bytes`, so a single text beyond that is not learnt from. Ids labelled both ways, null
    labels and null texts are left out; rows of one id count one by one.
    """
    names = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    names = names.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    names = names.select("doc_id", F.col("high").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").withColumn("size", F.octet_length("text"))
    texts = texts.filter(F.col("size") <= most_bytes).join(F.broadcast(names), "doc_id").withColumn("turn", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    drawn = texts.orderBy("turn").limit(most_rows).withColumn("upto", F.sum("size").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    return [(r.text.encode(), r.label) for r in drawn.filter(F.col("upto") <= most_bytes).select("text", "label").collect()]


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 2_000, most_bytes: int = 8_000_000, passes: int = 24_000) -> Network:
    """A network learnt from `sample`; few rows are seen more often, `passes` texts in all but 4 to 40 times each."""
    rows = sample(docs, labels, most_rows, most_bytes)
    if not rows:
        return Network.fresh(7)
    return trained([t for t, _ in rows], np.array([y for _, y in rows], "f4"), epochs=int(np.clip(passes // len(rows), 4, 40)))


def quality(docs: DataFrame, network: Network, keep_from: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 from `keep_from` on) for every whole text.

    A null text counts as empty; an empty text is a chunk of padding and gets a score too. Equal texts get equal
    scores up to rounding. Rows without an id aren't held out, as no label names them. Other columns are not read.
    """
    spread = docs.sparkSession.sparkContext.broadcast(network)  # a few kilobytes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = spread.value
        for batch in pieces(batches, "text", 1_000_000, 1_000):
            parts = [chunks_of((t or "").encode()) for t in batch.column("text").to_pylist()]
            counts = np.array([len(p) for p in parts])
            found = net.probabilities(net.maxima(np.concatenate(parts)), np.cumsum(counts) - counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= keep_from).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
