"""Quotes of any script against a plain search."""

import pytest

from docloom.functions import text as tx
from docloom.plans import evidence_q

TEXTS = {
    1: "Страховщик возмещает ущерб, причинённый имуществу застрахованного лица при пожаре.",
    2: "Η ασφάλιση καλύπτει τις ζημιές από πυρκαγιά και έκρηξη στο ακίνητο.",
    3: "保险公司赔偿因火灾造成的财产损失，但不包括故意行为。",
    4: "The insurer pays for damage by fire. ?!? -- ?!?",
    5: "Страховщик возмещает ущерб. 保险公司赔偿 the insurer",
    6: None, 7: "", 8: "تغطي الوثيقة أضرار الحريق",
}
QUOTES = {
    1: "возмещает ущерб, причинённый имуществу", 2: "ζημιές από πυρκαγιά", 3: "火灾造成的财产损失", 4: "?!? -- ?!?", 5: "возмещает ущерб", 6: "保险", 7: "保", 8: "insurer pays for damage",
    9: "нет такого места в тексте", 10: "", 11: "أضرار", 12: "причинён", 13: "赔偿 the", 14: "!", 15: "damage by fire. ?", 16: "страховщик", 17: ", причинённый иму",
}


@pytest.fixture(scope="module")
def places(spark):
    items = spark.createDataFrame(list(QUOTES.items()), "item_id long, text string")
    return evidence_q.quote_places(items, spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")).cache()


def test_every_script(spark, places):
    norm = {name: {k: v for k, v in spark.createDataFrame(list(rows.items()), "k long, text string").select("k", tx.normalize("text")).collect()} for name, rows in (("q", QUOTES), ("t", TEXTS))}
    expected = {(i, d, t.index(q) + 1) for i, q in norm["q"].items() for d, t in norm["t"].items() if q and t and q in t}
    assert {(r.item_id, r.doc_id, r.start) for r in places.collect()} == expected
    assert {i for i, _, _ in expected} == set(QUOTES) - {9, 10}


def test_word_edges(places):
    found = {(r.item_id, r.doc_id): (r.first, r.last) for r in evidence_q.word_edges(places).collect()}
    for r in places.collect():
        first, last = r.start - 1, r.start - 1 + r.length
        while r.norm[r.start - 1].isalnum() and first and r.norm[first - 1].isalnum():
            first -= 1
        while r.norm[r.start + r.length - 2].isalnum() and last < len(r.norm) and r.norm[last].isalnum():
            last += 1
        assert found[r.item_id, r.doc_id] == (first + 1, last)
    assert found[12, 1] == (found[12, 1][0], found[12, 1][0] + len("причиненный") - 1)


def test_texts_are_normalised_once_for_all_joins(spark):
    """What texts hold is kept; only the candidates' texts are read again."""
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    found = evidence_q.quote_places(items, spark.createDataFrame([(1, "zero one two three four five")], "doc_id long, text string"))
    assert [(r.item_id, r.doc_id, r.start) for r in found.collect()] == [(1, 1, 6)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [doc_id") == 1


def test_breaks_are_searched_once_a_pair(spark):
    import support

    from docloom.plans.catalog import QUERIES

    plan = QUERIES["v3_across_line_breaks"](spark, support.SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<!") == 1


def test_v10_needs_no_shuffle(spark):
    """A text's fragments are told apart in its row."""
    import support

    from docloom.plans.catalog import QUERIES

    plan = QUERIES["v10_denied_qualities"](spark, support.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
