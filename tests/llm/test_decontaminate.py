import random

import numpy as np
import pytest

from docloom.llm import decontaminate as dc


def distance_inside(pattern, text):
    """The least edit distance of pattern to a substring of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def edited(text, k, rng):
    out = list(text)
    for _ in range(k):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdefghij ")]
    return "".join(out)


def passages(rng, n, words=30):
    return [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(words)) for _ in range(n)]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(60):
        k = rng.randint(1, 4)
        patterns = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 14))) for _ in range(7)]
        longest = max(map(len, patterns))
        texts = ["".join(rng.choice("abc") for _ in range(k)) + edited(p, rng.randint(0, k), rng) + "".join(rng.choice("abc") for _ in range(30)) for p in patterns]
        rows = np.full((7, longest), -2)
        for i, p in enumerate(patterns):
            rows[i, : len(p)] = [ord(c) for c in p]
        around = np.array([[ord(c) for c in t[: longest + 2 * k]] for t in texts])
        got = dc.edits_near(rows, np.array([len(p) for p in patterns]), around, k)
        for p, t, g in zip(patterns, texts, got.tolist(), strict=True):
            near, far = distance_inside(p, t[: len(p) + 2 * k]), distance_inside(p, t)
            assert far <= g and (g <= near or near > k)


def test_recall_against_brute_force(spark):
    rng = random.Random(4)
    items = passages(rng, 12)
    docs, planted = [], []
    for i in range(150):
        body = passages(rng, 2, 40)
        if i % 2:
            item = rng.randrange(len(items))
            k = rng.choice([0, 0, 3, 6, 10, int(0.1 * len(items[item]))])
            body.insert(1, edited(items[item], k, rng))
            planted.append((i, item))
        docs.append((i, " \n".join(body).upper() if i % 5 == 1 else " ".join(body)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.contaminated(frame, bench).collect()}
    clean = {k: dc.normalized(t) for k, t in docs}
    want = {}
    for d, i in planted:
        e = distance_inside(dc.normalized(items[i]), clean[d])
        if e <= int(0.1 * len(dc.normalized(items[i]))):
            want[d, i] = e
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and all(k in got for k, e in want.items() if e == 0)
    kept = {r.doc_id for r in dc.drop_contaminated(frame, bench).collect()}
    assert kept == {k for k, _ in docs} - {d for d, _ in got}


def test_documents_have_all_exact_items(spark, documents):
    import support

    items = spark.read.parquet(f"{support.SMALL}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.contaminated(documents, items).collect()}
    texts = {r.doc_id: dc.normalized(r.text) for r in documents.collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if dc.normalized(r.text) in t}
    assert exact and all(got.get(k) == 0 for k in exact)


def test_awkward_rows(spark, awkward):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "Alpha  beta\ngamma delta epsilon"), (4, "alpha beta gamma delta epsilon"), (5, "zz"), (None, "word1 word2 word3 word4 word5 word6 word7")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.edits) for r in dc.contaminated(awkward, items).collect())
    assert got == sorted([(0, 3, 0), (0, 4, 0), *[(1, 3, 0), (1, 4, 0)] * 2, (5, 0, 0), (6, 0, 0)])
    assert dc.contaminated(awkward.limit(0), items).count() == 0
    assert dc.contaminated(awkward, items.limit(0)).count() == 0
    assert dc.drop_contaminated(awkward, items).columns == awkward.columns


def test_each_length_keeps_its_recall():
    """Short items don't hide that walks of long ones drift apart."""
    rng = random.Random(5)
    items = [p[:n].strip() for n, count in ((100, 40), (390, 20), (3_000, 12)) for p in passages(rng, count, n // 3)]
    plan = dc.Plan.of(list(enumerate(items)), 0.1, 0.98)
    for n in (100, 390, 3_000):
        mine = [i for i, t in enumerate(items) if n - 5 <= len(t) <= n]
        texts = [passages(rng, 1, 40)[0] + " " + edited(items[i], len(items[i]) // 10, rng) + " " + passages(rng, 1, 40)[0] for i in mine]
        found = {(t, i) for t, i, _ in plan.find(texts)}
        assert sum((t, i) in found for t, i in enumerate(mine)) >= 0.9 * len(mine), n


def test_one_unchanged_piece_is_enough():
    """Evenly spread edits that leave one of ten pieces alone are within the bound."""
    rng = random.Random(6)
    items = [p[:98] + "x" for p in passages(rng, 40, 40)]
    plan = dc.Plan.of(list(enumerate(items)), 0.1, 0.98)
    texts = []
    for t in items:
        changed = list(t)
        for at in range(9, 90, 10):
            changed[at] = "#"
        texts.append("before it " + "".join(changed) + " after it")
    found = [(t, i, e) for t, i, e in plan.find(texts) if t == i]
    assert len(found) >= 0.9 * len(items) and all(e == 9 for _, _, e in found)


def test_edits_at_both_ends_and_long_items():
    """Edits of the first and last characters, and items of thousands of characters beside short ones."""
    rng = random.Random(7)
    short, long = passages(rng, 20, 40), [p[:20_000] for p in passages(rng, 2, 4_000)]
    items = [dc.normalized(t) for t in [*short, *long]]
    plan = dc.Plan.of(list(enumerate(items)), 0.1, 0.98)
    texts = []
    for t in items:
        k = max(1, len(t) // 40)
        texts.append(dc.normalized(f"{passages(rng, 1, 30)[0]} {'#' * k}{t[k:-k]}{'%' * k} {passages(rng, 1, 30)[0]}"))
    found = {(t, i): e for t, i, e in plan.find(texts)}
    hits = [n for n in range(len(items)) if (n, n) in found]
    assert len(hits) >= 0.9 * len(items) and {20, 21} <= set(hits)
    assert all(found[n, n] == 2 * max(1, len(items[n]) // 40) for n in hits)
    assert plan.grams.nbytes <= 600 * len(items)


def test_the_gram_count_loses_nothing():
    """Every window that holds a passage within the bound has the q-grams that it must have."""
    rng = random.Random(8)
    items = [dc.normalized(p) for n in (8, 20, 60) for p in passages(rng, 25, n)]
    plan = dc.Plan.of(list(enumerate(items)), 0.1, 0.98)
    texts = [dc.normalized(edited(t, len(t) // 10, rng)) for t in items]
    codes = dc._codes("\uffff".join([*texts, ""]))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    at = np.arange(len(items))
    assert plan._may_hold(dc._filter_codes(codes), bounds, at, at, bounds[:-1]).all()


def table_distance(item, text):
    """Least edits of item to a substring of text, by the plain table, a row at a time."""
    row = np.zeros(len(text) + 1, int)
    letters, steps = np.array(list(text)), np.arange(len(text) + 1)
    for n, c in enumerate(item, 1):
        new = np.concatenate([[n], np.minimum(row[1:] + 1, row[:-1] + (letters != c))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


@pytest.mark.parametrize("kind", ["insert", "delete", "replace"])
def test_an_edit_of_one_kind_in_every_piece_but_one(kind):
    """All items of the supplied benchmark with exactly the allowed edits, spread so that walks drift apart: none is lost."""
    import duckdb
    import support

    rng = random.Random(len(kind))
    items = [dc.normalized(t) for (t,) in duckdb.sql(f"SELECT text FROM '{support.DATA}/sf0.1/benchmark.parquet' WHERE text IS NOT NULL ORDER BY item_id").fetchall()]
    plan, texts = dc.Plan.of(list(enumerate(items)), 0.1, 0.98), []
    for t in items:
        k = len(t) // 10
        size, spared, changed = len(t) // (k + 1), rng.randrange(k + 1), list(t)
        for p in reversed([p for p in range(k + 1) if p != spared]):
            at = p * size + rng.randrange(1, size - 1) if size > 2 else p * size
            changed[at : at + (kind != "insert")] = [] if kind == "delete" else ["#"]
        texts.append(f"{passages(rng, 1, 30)[0]} {''.join(changed)} {passages(rng, 1, 30)[0]}")
    found = {(t, i): e for t, i, e in plan.find(texts)}
    assert any(plan.tables.values())
    lost = [i for i in range(len(items)) if (i, i) not in found]
    assert all(table_distance(items[i], dc.normalized(texts[i])) > len(items[i]) // 10 for i in lost), lost
    assert len(lost) <= (20 if kind == "delete" else 0)
    some = rng.sample([i for i in range(len(items)) if (i, i) in found], 10)
    assert all(found[i, i] == table_distance(items[i], dc.normalized(texts[i])) for i in some)


def test_rows_are_dropped_by_their_own_text(spark):
    """A leak without an id goes; a clean document with a leak's id stays."""
    rng = random.Random(9)
    leak, clean = passages(rng, 2, 40)
    docs = spark.createDataFrame([(None, f"x {leak} y"), (1, leak), (1, clean), (None, clean), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, leak), (2, passages(rng, 1, 40)[0])], "item_id long, text string")
    for most in (2_000_000, 300):  # one block, or a block for each item
        assert sorted(str(tuple(r)) for r in dc.drop_contaminated(docs, items, most_chars=most).collect()) == sorted(str(x) for x in [(1, clean), (None, clean), (2, None)])
        assert sorted((r.doc_id or 0, r.item_id) for r in dc.contaminated(docs, items, most_chars=most).collect()) == [(0, 1), (1, 1)]
