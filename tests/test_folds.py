"""Folds that SQL doesn't express, against plain loops and hand-computed rows."""

import pytest
import support
from pyspark.sql import functions as F

from docloom.operators import folds
from docloom.plans.catalog import QUERIES
from docloom.streaming.quota import quota_stream


def test_admission_skips_and_goes_on(spark):
    units = spark.createDataFrame(
        [(1, 1, 1.0, [1, 2], [10, 10]), (1, 2, 2.0, [3], [90]), (1, 3, 3.0, [2, 4], [99, 5]), (1, 4, 3.0, [5], [1]), (2, 1, 1.0, [], [])],
        "question long, unit long, ord double, blocks array<long>, tokens array<int>",
    )
    got = {(r.question, r.unit): (r.admitted, r.reason) for r in folds.greedy_admission(units, 3, 50).collect()}
    assert got == {(1, 1): (True, None), (1, 2): (False, "tokens"), (1, 3): (True, None), (1, 4): (False, "blocks"), (2, 1): (True, None)}


def test_chunks(spark):
    rows = [(1, i, n) for i, n in enumerate([5, 5, 5, 30, 4, 4, 4, 4])]
    got = {r.seq: r.chunk for r in folds.greedy_chunks(spark.createDataFrame(rows, "doc_id long, seq int, chars int"), 3, 12).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: -1, 4: 1, 5: 2, 6: 2, 7: 2}


def requests(n=200):
    return [(i % 3, i, float(i * 7 % 601) + 1000 * (i % 4)) for i in range(n)]


def plain_quota(rows, minute, day):
    out, state = {}, {}
    for c, r, at in sorted(rows, key=lambda x: (x[2], x[1])):
        s = state.setdefault(c, [None, 0, None, 0])
        for k, span in ((0, 60), (2, 86400)):
            if s[k] is None or at - s[k] >= span:
                s[k], s[k + 1] = at, 0
            s[k + 1] += 1
        out[r] = "minute" if s[1] > minute else "day" if s[3] > day else "served"
    return out


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_quota_windows(spark, partitions):
    frame = spark.createDataFrame(requests(), "client long, request long, at double").repartition(partitions)
    got = {r.request: r.verdict for r in folds.quota_decisions(frame, 2, 40).collect()}
    assert got == plain_quota(requests(), 2, 40) and set(got.values()) == {"minute", "day", "served"}


def test_quota_stream(spark, tmp_path):
    frame = spark.createDataFrame(requests(), "client long, request long, at double")
    ordered = frame.orderBy("at", "request").collect()
    for k in range(2):
        spark.createDataFrame(ordered[k * 100 : (k + 1) * 100], frame.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = quota_stream(stream, 2, 40).writeStream.format("memory").queryName("quota").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r.request: r.verdict for r in spark.table("quota").collect()} == plain_quota(requests(), 2, 40)


def test_absorption(spark):
    rows = [(1, 1, "fire", ["fire"]), (1, 2, "fire at home", ["fire", "home"]), (1, 3, "home", ["home"]), (1, 4, "water", ["water"]), (1, 5, "note", []), (1, 6, "note", [])]
    got = {(r.label, r.variants) for r in folds.absorb(spark.createDataFrame(rows, "group long, ord long, label string, roots array<string>")).collect()}
    assert got == {("fire at home", 3), ("water", 1), ("note", 1)}


def test_search_is_the_same_under_any_partitioning(spark):
    import support

    from docloom.operators import search
    from docloom.plans.base import Tables
    from docloom.plans.search_q import asked, index

    t = Tables(spark, support.SMALL)
    forms, words = asked(t)
    runs = []
    for n in (1, 16):
        scored = search.scores(index(t).repartition(n), forms.repartition(n), words.orderBy(F.rand(n)))
        runs.append(sorted(tuple(r) for r in search.best(scored, 5).collect()))
    assert runs[0] == runs[1]


@pytest.mark.parametrize("name, key", [("r13_greedy_admission", "question"), ("r15_targeted_extension", "question"), ("d7_fact_absorption", "group")])
def test_every_order_is_folded(spark, name, key):
    orders = spark.read.parquet(f"{support.SMALL}/lineitem.parquet").select("l_orderkey").distinct()
    got = QUERIES[name](spark, support.SMALL).select(key).distinct()
    assert orders.count() == got.count() and orders.subtract(got).count() == 0
