import random
import re
from itertools import combinations

import numpy as np
import pytest

from docloom.llm import neardup
from docloom.llm.common import Scratch
from docloom.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(docs, n):
    """doc_id -> least doc_id reached, by all pairs."""
    sets = {k: shingles(t, n) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {k: find(k) for k in docs}, {k: len(s) for k, s in sets.items()}


def group_of_copies(seed, copies, words=120, edits=9):
    """A text, copies of it with a few words changed, and texts that share a long passage."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    docs = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(1, edits)):
            at = rng.randrange(len(text))
            kind = rng.random()
            text[at : at + 1] = [] if kind < 0.3 else [f"x{rng.randint(0, 12)}"] if kind < 0.8 else [text[at], "y"]
        docs.append(" ".join(text))
    passage = [f"p{rng.randint(0, 99)}" for _ in range(60)]
    docs += [" ".join(passage + [f"z{rng.randint(0, 9999)}" for _ in range(rng.randint(3, 40))]) for _ in range(copies // 2)]
    return docs


@pytest.mark.parametrize(("seed", "block_rows"), [(1, 1024), (2, 7), (3, 3)])
def test_matches_all_pairs(spark, seed, block_rows):
    texts = group_of_copies(seed, 70) + group_of_copies(seed + 50, 6) + ["a b", "A  b", "", None, "only"]
    docs = dict(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), words=4, block_rows=block_rows).collect()
    want, sizes = brute(docs, 4)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_documents(spark, documents):
    docs = {r.doc_id: r.text for r in documents.collect()}
    got = neardup.near_duplicates(documents, words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(docs, 4)[0]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        both, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (150, 25, 25))
        elements = np.concatenate([both, left, both, right])
        rows = neardup.super_minhash(elements, np.repeat([0, 1], 175), 2, 96)
        assert np.isfinite(rows).all()
        errors.append((rows[0] == rows[1]).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.05 * np.sqrt(0.75 * 0.25 / 96) + 0.005


def test_signature_of_few_elements():
    rows = neardup.super_minhash(np.array([5], np.uint64), np.array([0]), 1, 96)
    assert np.isfinite(rows).all() and len(np.unique(np.floor(rows))) == 96


def test_awkward_rows(spark, awkward):
    got = {(r.doc_id, r.n_shingles): r for r in neardup.near_duplicates(awkward).collect()}
    assert got[None, 1].component_id == 1 and not got[None, 1].kept and got[1, 1].kept
    assert got[2, 0].kept and got[3, 0].kept and got[4, 0].component_id == 4
    six = next(r for k, r in got.items() if k[0] == 6)
    assert six.component_id == 5 and not six.kept
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 1, 2, 3, 4, 5, 8]


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_shared_counts():
    rng = np.random.default_rng(4)
    for size, values in ((90, 40), (90, 4000), (3, 5)):
        left, right = ([np.unique(rng.integers(0, values, rng.integers(0, 60))).astype(np.uint64) for _ in range(size)] for _ in range(2))
        want = [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
        assert neardup.shared_counts(left, right).tolist() == want


def test_pairs_at_the_bound_meet_in_a_band():
    """Of 6,000 pairs with a similarity of 0.80 to 0.82 none is missed (4e-6 expected of each)."""
    rng = np.random.default_rng(5)
    for common, each in ((16, 2), (80, 10), (82, 9), (400, 50), (410, 45)):
        for _ in range(6):
            pairs = 200
            both, left, right = (rng.integers(0, 2**63, (pairs, n)).astype(np.uint64) for n in (common, each, each))
            sides = [neardup.super_minhash(np.concatenate([both, x], axis=1).ravel(), np.repeat(np.arange(pairs), common + each), pairs, neardup.BANDS * neardup.ROWS) for x in (left, right)]
            keys = [neardup.band_keys(x, neardup.BANDS, neardup.ROWS) for x in sides]
            assert (keys[0] == keys[1]).any(axis=1).all()


def test_many_null_ids(spark):
    """Rows without an id are told apart by their texts."""
    texts = [f"text number {i // 2} of the rows without any id at all {i // 2}" for i in range(60)] + ["one two three four five six seven"] * 3
    got = neardup.near_duplicates(spark.createDataFrame([(None, t) for t in texts] + [(7, texts[-1])], "doc_id long, text string")).collect()
    assert len(got) == 64 and sorted(r.component_id for r in got if r.component_id is not None) == [7] * 4


def test_repeated_rows(spark):
    """One row many times is one node; ids that repeat with other texts count by their texts."""
    rows = [(1, "a b c d e f g h i j")] * 50 + [(1, "k l m n o p q r s t"), (2, "K l m n o p q r s t"), (0, "a b c d e f g h i j")]
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0)] + [(1, 0)] * 50 + [(1, 1), (2, 1)]


def test_large_group_of_near_copies(spark):
    """A group whose copies differ from their text by about the bound, in few places: links run beside the text."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(base)]
    for _ in range(400):
        text = list(base)
        for p in rng.sample(range(0, 100, 5), rng.randint(4, 8)):
            text[p] = rng.choice(["", f"q{rng.randint(0, 3)}"])
        texts.append(" ".join(text))
    docs = dict(enumerate(texts))
    want, _ = brute(docs, 4)
    for block_rows in (1024, 50):
        got = neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), words=4, block_rows=block_rows).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    assert 1 < len(set(want.values())) < 400
