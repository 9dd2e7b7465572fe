"""The manifest against a plain tree, rebuilt as a whole for every tampered leaf."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from docloom.llm import merkle

NAMES = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    while len(nodes) > 1:
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0]


def beside(nodes, at):
    found = ""
    while len(nodes) > 1:
        start = at - at % 16
        found += "".join(nodes[start:at]) + "".join(nodes[at + 1 : start + 16])
        nodes, at = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], at // 16
    return found


def plain(rows, rebuilt=None):
    """Expected rows; `rebuilt` names the ids whose tampered root is made from scratch (all, if None)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: [x[2] for x in sorted(groups[g], key=lambda x: x[:3])] for g in order}
    tops = [climb(leaves[g]) for g in order]
    root, out = climb(tops), []
    for at_group, g in enumerate(order):
        for at, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            folded = root
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None and (rebuilt is None or row[0] in rebuilt):
                changed = list(leaves[g])
                changed[at] = leaf((*row[:4], row[4].translate(low)))
                folded = climb([*tops[:at_group], climb(changed), *tops[at_group + 1 :]])
            out.append((row[0], own, tops[at_group], root, H(beside(leaves[g], at) + beside(tops, at_group)), folded, folded == root))
    return out


def got(spark, rows):
    found = merkle.digests(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id as pos", "source as grp", "text as digest"))
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_sizes(spark, n):
    rows = [(i, f"s{i % 3}" if n > 17 else "s", "en", i, f"Text {i}") for i in range(n)]
    assert sorted(got(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None, None), (1, None, None, None, None), (None, None, "en", 3, "ABC"), (None, "", "en", 0, ""),
        (10, "", "en", 3, "ABC"), (10, "", "en", 3, "ABC"), (10, "é", "fr", 4, "Éa"), (-5, "z", "de", 7, "Z" * 100_000), (20, "Z", "de", 1, "A"),
        *[(i, "many", "en", 1, "Same Text") for i in range(40)], *[(7, "ties", "en", i, "T") for i in range(20)],
    ]
    assert sorted(got(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_many_sources(spark):
    rows = [(i, f"source {i}", "en", i, f"T{i}") for i in range(300)]
    assert sorted(got(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_more_than_a_block_in_one_source(spark):
    rows = [(i, "hot" if i % 50 else "cold", "en", i, f"Text {i}") for i in range(4300)]
    some = {5, 4099, *range(4200, 4300)}
    expected = {r[0]: r for r in plain(rows, some)}
    for row in got(spark, rows):
        if row[0] in some or zlib.crc32(str(row[0]).encode()) % 5:
            assert row == expected[row[0]]
        else:
            assert row[:5] == expected[row[0]][:5] and not row[6]


def test_versions_copy_only_ancestors(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs, merkle.tampered_fifth(docs.doc_id)).collect()
    for r in found:
        assert (r.path is None) == bool(zlib.crc32(str(r.doc_id).encode()) % 5)
        assert r.path is None or (len(r.path) == 3 and r.path[-1] == r.folded_root)
        assert r.n_siblings in (15 + 15 + 1, 15 + 2 + 1, 11 + 2 + 1)


def test_empty(spark):
    assert got(spark, []) == []
