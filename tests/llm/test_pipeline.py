import corpus_pipeline
import pytest
import support
from test_lines import brute as line_cuts
from test_neardup import brute as groups

from docloom.llm import langid
from docloom.llm.common import Scratch
from docloom.llm.decontaminate import normalized


@pytest.fixture(scope="module")
def tables(spark):
    """What each stage got and gave."""
    docs = spark.read.parquet(f"{support.SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, " 12 34 ", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(extra)
    scratch, out = Scratch(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.keep(stage(spark, docs, support.SMALL), name)
        out.append((docs, after))
        docs = after
    return out


def test_stages_are_the_dealt_ones(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "encoding"]
    for before, after in tables[:-1]:
        assert after.columns == before.columns


def test_language_id_drops_what_has_no_letters_or_stays_doubtful(tables):
    before, after = tables[0]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    scores = {r.doc_id: r.score for r in langid.identify(before, langid.fit(before)).collect()}
    assert {10**6, 10**6 + 1} <= gone == {k for k, x in scores.items() if x < 0.5} and len(gone) < 0.03 * len(scores)


def test_line_dedup(tables):
    before, after = tables[1]
    docs = {r.doc_id: r.text for r in before.collect()}
    cuts = line_cuts(docs, 5)
    want = {k: "\n".join(s for i, s in enumerate(t.split("\n")) if i not in cuts[k]) for k, t in docs.items()}
    got = {r.doc_id: r.text for r in after.collect()}
    assert got == {k: t for k, t in want.items() if t.strip() or not cuts[k]}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_dedup(tables):
    before, after = tables[2]
    root, _ = groups({r.doc_id: r.text for r in before.collect()}, 5)
    assert {r.doc_id for r in after.collect()} == set(root.values())


def test_decontamination(tables, spark):
    before, after = tables[3]
    items = [normalized(r.text) for r in spark.read.parquet(f"{support.SMALL}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in before.collect() if any(i in normalized(r.text) for i in items)}
    kept = {r.doc_id for r in after.collect()}
    assert leaks and not leaks & kept and len(kept) >= before.count() - len(leaks) - 1


def test_encoding_and_run(tables, spark):
    before, after = tables[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    whole = corpus_pipeline.run(spark, support.SMALL)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in after.collect())
