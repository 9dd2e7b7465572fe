"""The byte network against a plain evaluation, its gradient against differences, and its accuracy on rows it never saw."""

import math
import random
import zlib

import numpy as np
import pytest
import support

from docloom.llm import convnet
from docloom.llm.convnet import CHUNK, PAD, STEP, WIDTH, Network


def plain_score(net, text):
    """Place by place, filter by filter."""
    data = list(text) + [PAD] * (CHUNK - len(text))
    starts = sorted({*range(0, len(data) - CHUNK, STEP), len(data) - CHUNK})
    maxima = [[max(0.0, max(sum(float(net.embed[data[s + t + j]] @ net.filters[j * net.embed.shape[1] : (j + 1) * net.embed.shape[1], f]) for j in range(WIDTH)) for t in range(CHUNK - WIDTH + 1)) + float(net.bias[f])) for f in range(len(net.bias))] for s in starts]
    columns = list(zip(*maxima, strict=True))
    features = [max(c) for c in columns] + [sum(c) / len(c) for c in columns] + [min(c) for c in columns]
    return 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(features, net.out, strict=False)) - float(net.out[-1])))


def scores(net, texts):
    parts = [convnet.chunks_of(t) for t in texts]
    counts = np.array([len(p) for p in parts])
    return net.probabilities(net.maxima(np.concatenate(parts)), np.cumsum(counts) - counts)


@pytest.mark.parametrize("n", [0, 1, WIDTH, CHUNK - 1, CHUNK, CHUNK + 1, STEP + CHUNK, 3 * CHUNK])
def test_against_a_plain_evaluation(n):
    net = Network.fresh(3, embed=4, filters=3)
    text = bytes(random.Random(n).choices(range(256), k=n))
    assert scores(net, [b"other", text, b""])[1] == pytest.approx(plain_score(net, text), abs=1e-5)


def test_chunks_cover_every_window():
    for n in (CHUNK, CHUNK + 1, 5 * STEP + 17, 5_000):
        places = convnet.chunks_of(bytes(i % 251 for i in range(n)))
        flat = np.array([i % 251 for i in range(n)])
        windows = {tuple(w) for c in places for w in np.lib.stride_tricks.sliding_window_view(c, WIDTH)}
        assert windows == {tuple(w) for w in np.lib.stride_tricks.sliding_window_view(flat, WIDTH)}
        assert (places[-1][-5:] == flat[-5:]).all()


def test_learns_what_stands_anywhere():
    """A mark at any place of a long text decides; only the mark tells the classes apart."""
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        body = bytearray(rnd.choices(b"abcdefgh ", k=rnd.randint(5, 3_000)))
        if i % 2:
            at = rnd.randrange(len(body))
            body[at:at] = b"#!#!"
        rows.append((bytes(body), i % 2))
    net = convnet.trained([t for t, _ in rows[:200]], np.array([y for _, y in rows[:200]], "f4"), epochs=25)
    found = scores(net, [t for t, _ in rows[200:]])
    assert np.mean((found >= 0.5) == np.array([y for _, y in rows[200:]])) >= 0.95
    long = bytes(rnd.choices(b"abcdefgh ", k=200_000))
    without, marked = scores(net, [long, long + b"#!#!"])
    assert without < 0.5 and marked > without + 0.05  # the last bytes of a long text count


def test_held_out_quality(spark):
    sf = str(support.DATA / "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = convnet.fit(docs, labels)
    rows = convnet.quality(docs, net).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(rows) > 60 and np.mean([g > b for g in good for b in bad]) > 0.93
    assert np.mean([g >= 0.3 for g in good]) > 0.97
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, None, 0), (None, 1, 0), (8, 0, 1), (8, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = convnet.quality(awkward, convnet.fit(awkward, labels)).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    same = [r.score for r in rows if r.doc_id in (2, 3)]
    assert same[0] == pytest.approx(same[1])
    assert convnet.quality(awkward.limit(0), Network.fresh(1)).collect() == []


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i} " * 50) for i in range(2_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    rows = convnet.sample(docs, labels, most_rows=100, most_bytes=20_000)
    assert 0 < len(rows) <= 100 and 10_000 < sum(len(t) for t, _ in rows) <= 20_000
    assert all(zlib.crc32(str(int(t.split()[1]) % 50).encode()) % 5 for t, _ in rows)
