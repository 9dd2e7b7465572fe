"""Pruned search against scoring everything."""

import random

import pytest

from docloom.operators import search


def drawn(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    sets = [(f"c{rnd.randrange(3)}", f"b{i:03}", sorted(set(rnd.choices(words, weights, k=rnd.randint(1, 9))))) for i in range(300)]
    forms, asked = [], []
    for q in range(12):
        every = set()
        for g in range(1, rnd.randint(2, 5)):
            for f in range(1, rnd.randint(2, 3)):
                form = set(rnd.choices([*words, "unknown"], [*weights, 0.05], k=rnd.choice([1, 1, 2, 3, 6])))
                forms += [(q, g, f, len(form), w) for w in form]
                every |= form
        asked += [(q, len(every), w) for w in every]
    return (
        spark.createDataFrame(sets, "corpus string, block string, words array<string>"),
        spark.createDataFrame(forms, "question long, group int, form int, form_size int, token string"),
        spark.createDataFrame(asked, "question long, question_size int, token string"),
    )


@pytest.mark.parametrize(("seed", "most", "first", "growth"), [(1, 5, 10, 3), (2, 20, 500, 8), (3, 1, 2, 2)])
def test_ranked_is_best_of_all(spark, seed, most, first, growth):
    sets, forms, asked = drawn(spark, seed)
    tokens = sets.selectExpr("corpus", "block", "size(words) n_tokens", "explode(words) token")
    expected = search.best(search.scores(tokens, forms, asked), most)
    got = search.ranked(sets, forms, asked, most, first, growth)
    assert sorted(tuple(r) for r in got.select(expected.columns).collect()) == sorted(tuple(r) for r in expected.collect())


def test_nothing_asked_or_held(spark):
    sets, forms, asked = drawn(spark, 4)
    assert search.ranked(sets.limit(0), forms, asked, 5).count() == 0
    assert search.ranked(sets, forms.limit(0), asked.limit(0), 5).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_overlapping(spark, share):
    sets, _, asked = drawn(spark, 5)
    held = {(r.corpus, r.block): set(r.words) for r in sets.collect()}
    wanted: dict = {}
    for r in asked.collect():
        wanted.setdefault(r.question, set()).add(r.token)
    expected = {(q, *k, len(w & s), len(w)) for q, w in wanted.items() for k, s in held.items() if len(w & s) >= max(1, -(-len(w) * share // 1))}
    got = {tuple(r) for r in search.overlapping(sets, asked.select("question", "token"), ["corpus", "block"], "question", share).collect()}
    assert got == expected


def test_next_alike_within_documents(spark):
    rnd = random.Random(6)
    texts = ["\n".join(" ".join(rnd.choices("abcdef", k=rnd.choice([0, 1, 3, 5]))) for _ in range(rnd.randint(1, 15))) for _ in range(80)]
    texts += ["", "\n\n", " \na b\r\n\n\n\na B", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = set()
    for d, text in enumerate(texts):
        words = [set(x.lower().split()) for x in (text or "").split("\n")]
        for i, a in enumerate(words):
            met = [(-round(len(a & b) / len(a | b), 9), k) for k, b in enumerate(words[i + 1 : i + 6], i + 2) if a and b]
            expected |= {(d, i + 1, k, -s, n) for n, (s, k) in enumerate(sorted(x for x in met if x[0] <= -0.2)[:3], 1)}
    got = search.next_alike(frame, 5, 0.2, 3)
    assert {tuple(r) for r in got.collect()} == expected
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_r14_shuffles_no_lines(spark):
    """The lines of a document meet where they lie; at most its row is dealt out to the cores."""
    import support

    from docloom.plans.catalog import QUERIES

    plan = QUERIES["r14_limiting_clauses"](spark, support.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_calls_are_answered_out_of_one_pass(spark, monkeypatch):
    from docloom.operators import calls
    from docloom.scratch import Rounds

    kept, keep = [], Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, frame: kept.append(frame.columns) or keep(self, frame))
    asked = spark.createDataFrame([(1, "search", "b"), (2, "definitions", "b"), (3, "definitions", "c"), (4, "search", "x"), (5, "definitions", None), (6, "open", "n"), (7, "dig", "b")], "call long, tool string, arg string")
    nodes = spark.createDataFrame([("n", None)], "node_id string, parent_id string")
    blocks = spark.createDataFrame([(4, "n", 2), (5, "n", 1)], "block_id long, node_id string, ord long")
    lines = spark.createDataFrame([("l1", ["a", "b"]), ("l2", ["b", "c"]), ("l3", ["b"])], "line string, words array<string>")
    got = {tuple(r) for r in calls.answered(asked, nodes, blocks, lines).select("call", "ok", "n", "first", "error").collect()}
    assert got == {(1, True, 3, "l1", None), (2, True, 2, "l2", None), (3, True, 0, None, None), (4, True, 0, None, None), (5, False, None, None, "empty word"), (6, True, 2, "5", None), (7, False, None, None, "unknown tool")}
    assert [c for c in kept if "n_heads" in c] == [["arg", "n", "first", "n_heads", "first_head"]]


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_overlapping_by_broadcast_and_by_shuffles(spark, share):
    sets, _, asked = drawn(spark, 7)
    found = [search.overlapping(sets, asked.select("question", "token"), ["corpus", "block"], "question", share, most) for most in (0, 1_000_000)]
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect()))
    # what is asked goes to the sets, which stay where they are
    assert "hashpartitioning(corpus" not in found[1]._jdf.queryExecution().executedPlan().toString()


def test_term_hits_of_repeated_words(spark, monkeypatch):
    """Words of texts needn't be told apart first; those that contain a term are found once and kept."""
    from docloom.scratch import Rounds

    kept, keep = [], Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, frame: kept.append(frame.columns) or keep(self, frame))
    held = spark.createDataFrame([(1, "contract", False), (1, "contract", True), (1, "subcontracts", False), (2, "contra", False), (3, "contracts", False)], "key long, token string, head boolean")
    terms = spark.createDataFrame([("contract",), ("absent",)], "term string")
    assert {tuple(r) for r in search.term_hits(held, terms).collect()} == {("contract", 1, True), ("contract", 3, False)}
    assert kept == [["term", "token"]]
