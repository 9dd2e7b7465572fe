import zlib

import numpy as np

from docloom.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs, langid.fit(docs)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_only_the_text_decides(spark, documents):
    model = langid.fit(documents)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(documents, model).collect()}
    other = documents.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(other, model).collect()} == plain


def test_families_are_hierarchical(spark, documents):
    model = langid.fit(documents)
    assert model.families.classes == ["germanic", "romance"]
    assert model.within["germanic"].classes == ["de", "en"] and len(model.within["romance"].pairs) == 1
    assert langid.family_of("xx") == "xx"


def test_awkward_rows(spark, awkward, documents):
    model = langid.fit(documents)
    got = {r.doc_id: r for r in langid.identify(awkward, model).collect()}
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0.0
    assert got[8].lang_pred != "und" and not got[None].held_out
    kept = langid.keep_identified(awkward, model, min_score=0.0)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 5, 6, 8]


def test_only_letters_make_a_language(spark, documents):
    """Digits of any kind, number forms and signs aren't letters; letters of any script are."""
    model = langid.fit(documents)
    rows = [(1, "½ ² ①"), (2, "12 345 Ⅷ ٣"), (3, "…—!"), (4, "漢"), (5, "½a"), (6, "ª")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred == "und" for k in range(1, 7)] == [True, True, True, False, False, False]


def test_capitals_with_accents_count_as_small_ones(spark, documents):
    model = langid.fit(documents)
    rows = [(1, "über die straße für études"), (2, "ÜBER DIE STRAßE FÜR ÉTUDES")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == got[2]


def test_rejected_are_the_doubtful_ones(spark):
    """The stage's bound drops what identify scores below it, and nearly nothing of clean documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    scores = {r.doc_id: r.score for r in langid.identify(docs, model).collect()}
    kept = {r.doc_id for r in langid.keep_identified(docs, model).collect()}
    assert kept == {k for k, x in scores.items() if x >= 0.5} and len(kept) >= 0.99 * len(scores)
    mixed = spark.createDataFrame([(1, "a"), (2, "the und les")], docs.select("doc_id", "text").schema)
    strict = langid.keep_identified(mixed, model, min_score=0.999)
    assert strict.count() == 0


def test_pairwise_votes_against_plain_loops():
    """One-versus-one by hand: most pairs won, then the margins; the score is the least logistic margin."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    labels = np.array(["a", "b", "c", "d"])[(x[:, :4] + 0.3 * rng.normal(size=(300, 4))).argmax(axis=1)]
    model = langid.Pairwise.fit(x, labels)
    best, sure = model.predict(x)
    for row, k, s in zip(x, best, sure, strict=True):
        votes, least = dict.fromkeys(range(4), 0.0), dict.fromkeys(range(4), 1.0)
        for n, (i, j) in enumerate(model.pairs):
            m = float(row @ model.weights[:, n] + model.biases[n])
            won, lost = (i, j) if m >= 0 else (j, i)
            votes[won] += 1 + 1e-3 * np.tanh(abs(m))
            votes[lost] -= 1e-3 * np.tanh(abs(m))
            p = 1 / (1 + np.exp(-3 * m))
            least[i], least[j] = min(least[i], p), min(least[j], 1 - p)
        assert votes[k] >= max(votes.values()) - 1e-6 and abs(least[k] - s) < 1e-4
    assert (np.array(model.classes)[best] == labels).mean() > 0.85


def test_nothing_to_learn_from(spark, documents):
    empty = documents.limit(0)
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0
    assert {r.lang_pred for r in langid.identify(documents.limit(3), None).collect()} == {"und"}
    one = documents.filter("lang = 'en'")
    assert {r.lang_pred for r in langid.identify(documents.filter("text is not null").limit(5), langid.fit(one)).collect()} == {"en"}


def test_sample_keeps_its_bound(spark):
    """An id or a row that is repeated many times is neither in nor out with all its rows."""
    rows = [(7, f"one id {i % 40}", "en") for i in range(4_000)] + [(i, f"other {i}", "en") for i in range(100, 200)] + [(i, f"des {i}", "fr") for i in range(300, 340)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(docs, 60).collect()
    assert sum(r.lang == "en" for r in got) == 60
    assert sum(r.lang == "fr" for r in got) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(300, 340))
    assert langid.training_rows(docs.filter("doc_id = 7 and text = 'one id 1'"), 60).count() == (60 if zlib.crc32(b"7") % 4 != 2 else 0)
