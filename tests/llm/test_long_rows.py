"""One word or line of a megabyte, and URLs of thousands of characters, in the operators that read texts piece by piece."""

import random

import numpy as np

from docloom.llm import convnet, langid, toxicity, tries, urls

LONG = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))


def test_language_id(spark, documents):
    rows = langid.identify(spark.createDataFrame([(1, LONG), (2, "ü" * 500_000), (3, "1" * 1_000_000)], "doc_id long, text string"), langid.fit(documents)).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in rows} == {1: False, 2: False, 3: True}


def test_toxicity(spark):
    model = toxicity.OrdinalModel({"slur": 4.0}, np.array([2.0]))
    rows = toxicity.severity(spark.createDataFrame([(1, LONG), (2, f"{LONG} slur")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.toxic for r in rows} == {1: False, 2: True}


def test_urls(spark):
    pages = [(i, f"https://example.com/en/{i}", "") for i in range(60)] + [(100, f"https://example.org/{LONG[:9000]}", ""), (101, f"https://{LONG[:9000]}", None), (102, f"https://a.net/de/{LONG[:9000]}", None), (103, LONG[:9000], None)]
    found = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(found) == 64 and found[102].rule == "net/de/" and found[102].verdict == "allow"
    assert found[101].host == LONG[:9000] and found[100].path == f"/{LONG[:9000]}" and found[103].host == ""


def test_quality(spark):
    rows = convnet.quality(spark.createDataFrame([(1, LONG), (2, "")], "doc_id long, text string"), convnet.Network.fresh(1)).collect()
    assert len(rows) == 2 and all(0 <= r.score <= 1 for r in rows)


def test_turns(spark):
    rows = [(c, 0, "user", LONG) for c in (1, 2)] + [(2, 1, "user", f"{LONG} {LONG}")]
    found = {(r.conv_id, r.depth): r for r in tries.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1, 1].n_convs == 2 and found[1, 1].saved_tokens == 1 and found[2, 2].parent_conv_id == 1
