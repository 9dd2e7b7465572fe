"""The burst trie against a plain dictionary of prefixes."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from docloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows, rebuild):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], text))
    plain = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    if not rebuild:
        return plain
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in plain}
    return {c: plain.get(c - c % 20, [])[: h[c]] + turns[h[c] :] for c, turns in plain.items()}


def trie(rows, rebuild=True):
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in sequences(rows, rebuild).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    children, subtree = defaultdict(set), defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].add(node)
        for d in range(len(node) + 1):
            subtree[node[:d]].append(node)

    def cost(node):
        return (len(members[node]) - 1) * len(re.findall(tries.WORD, node[-1][1])) if node else 0

    return {
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[x] for x in subtree[n]), sum(map(cost, subtree[n])), sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, m in members.items()
    }


def drawn(seed, convs=60, texts=3, turns=6):
    rnd = random.Random(seed)
    rows = [(c, t if rnd.random() > 0.1 else None, rnd.choice(["user", "assistant", None, ""]), rnd.choice([None, "", "a b c", "a  b\tc", "é x"][: texts + 2])) for c in rnd.sample(range(0, 200), convs) for t in range(rnd.randint(1, turns))]
    return rows + rnd.sample(rows, 5)


@pytest.mark.parametrize(("seed", "most", "most_turns"), [(1, 512, 65_536), (2, 2, 65_536), (3, 40, 12)])
def test_rebuilt_against_prefixes(spark, seed, most, most_turns):
    rows = drawn(seed)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "turn as pos", "role as tid", "text as head")
    got = [tuple(r) for r in tries.rebuilt_trie(frame, most, most_turns).select(*NODE).collect()]
    assert len(got) == len(set(got)) and set(got) == trie(rows)


def test_copies_long_ones_and_missing_families(spark):
    rows = [(c, t, "user", f"w{t} w") for c in range(40, 75) for t in range(4)]  # many of one family, all the same
    rows += [(c, t, "user", f"long {t % 7}") for c in (100, 130) for t in range(150)]  # more than two chunks
    rows += [(c, 0, "user", "short") for c in range(201, 215)]  # no conversation 200: some are left without turns
    rows += [(None, 0, "user", "nobody's"), (-7, 0, None, None), (10**15, 1, "user", "x" * 200_000)]
    got = [tuple(r) for r in tries.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), most=8).select(*NODE).collect()]
    assert len(got) == len(set(got)) and set(got) == trie(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 35 + 2 + 14 + 2 and root[7] != tries.NO_ENDS


def test_as_they_are(spark):
    rows = drawn(4, convs=30)
    got = [tuple(r) for r in tries.prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(*NODE).collect()]
    assert len(got) == len(set(got)) and set(got) == trie(rows, rebuild=False)


def test_empty(spark):
    assert tries.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sweep_alone():
    a, b, c = b"a", b"b", b"c"
    nodes, total = tries.sweep([([a, b], [2, 3], 5, 2, "ab"), ([c], [1], 1, 1, "c"), ([a], [2], 7, 1, "a")], 1, 4)
    assert total == (2, 2, 2 * 2 + 3) and (5, 5, 1, 3, 1, 1, 7, "a") in nodes and (5, 6, 5, 2, 0, 1, 3, "ab") in nodes and (1, 5, 1, 1, 0, 1, 0, "c") in nodes
