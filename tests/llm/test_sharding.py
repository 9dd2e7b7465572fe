import hashlib
import zlib
from collections import defaultdict

import pytest

from docloom.llm import sharding


def laws(rows, texts, shards):
    """Sizes, checksums, gapless slots, and shares that miss the even one by at most a record."""
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s, members in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / shards) <= 2 * largest
    assert len(rows) == len(texts)


def test_documents(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = sharding.shard_by_bytes(documents, shards=24).collect()
    laws(rows, texts, 24)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)


@pytest.mark.parametrize("partitions", [1, 7])
def test_hot_text_and_any_partitioning(spark, partitions):
    docs = [(i, "hot " * 50 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(3000)]
    rows = sharding.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions), shards=10, ranges_per_shard=4).collect()
    laws(rows, docs, 10)
    test_hot_text_and_any_partitioning.seen = getattr(test_hot_text_and_any_partitioning, "seen", None) or sorted((r.doc_id, r.shard, r.slot) for r in rows)
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == test_hot_text_and_any_partitioning.seen


def test_splitters_find_ranges():
    import numpy as np

    s = sharding.Splitters().plus(np.array([5, 5, 9]), np.array([1, 7, 0]))
    assert s.find(np.array([4, 5, 5, 5, 5, 9, 9]), np.array([9, 0, 1, 7, 8, -1, 0])).tolist() == [0, 0, 1, 2, 2, 2, 3]


def test_awkward_rows(spark, awkward):
    rows = sharding.shard_by_bytes(awkward, shards=3).collect()
    assert len(rows) == awkward.count() and {r.size for r in rows if r.doc_id in (2, 3)} == {8}
    assert sharding.shard_by_bytes(awkward.limit(0)).count() == 0


def placed_plainly(docs, shards):
    """doc -> (shard, slot) by sorting all keys on one line of bytes."""
    keys = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), i, len((t or "").encode()) + 8) for i, t in docs)
    total, before, slots, out = sum(k[2] for k in keys), 0, [0] * shards, {}
    for _, i, size in keys:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        out[i] = (shard, slots[shard])
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_against_a_plain_placement(spark, shards):
    docs = [(i, None if i % 50 == 7 else "hot " * 50 if i % 3 == 0 else f"text {i % 700} " * (1 + i % 40)) for i in range(2000)]
    rows = sharding.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), shards=shards).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == placed_plainly(docs, shards)


def test_many_rows_without_an_id(spark):
    docs = [(None, "same text")] * 1500 + [(i, f"t{i}") for i in range(500)]
    rows = sharding.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), shards=6).collect()
    laws(rows, docs, 6)
