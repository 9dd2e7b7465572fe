"""Greedy segments against plain loops, over sequences cut into many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.segments import greedy_segments, running
from docloom.plans.shapes_q import planned_segments, rotated
from docloom.scratch import Rounds


def plain(sizes, most_rows, most_size, long_alone):
    """Segments of one sequence, row by row."""
    out, count, rows, total = [], 0, 0, 0
    for size in sizes:
        if size > most_size:
            count += bool(rows) + long_alone
            out.append(count - 1 if long_alone else -1)
            rows = total = 0
            continue
        if rows and (rows == most_rows or total + size > most_size):
            count, rows, total = count + 1, 0, 0
        rows, total = rows + 1, total + size
        out.append(count)
    return out


def sequences(seed):
    """Of all lengths, with empty and over-long rows; one has most of the rows, one has no key."""
    rng = random.Random(seed)
    lengths = {"long": 1200, "short": 7, "one": 1, None: 200, "even": 160}
    return {k: [5 if k == "even" else rng.choice([0, 1, 2, 3, 8, 13, 20, 21, 50]) for _ in range(n)] for k, n in lengths.items()}


@pytest.mark.parametrize("most_rows, most_size, long_alone, width", [(4, 20, True, 25), (4, 20, False, 60), (1000, 20, True, 1021), (1, 20, False, 22), (3, 20, False, None)])
def test_segments_of_many_blocks(spark, most_rows, most_size, long_alone, width):
    found = sequences(most_rows)
    rows = [(k, i, n) for k, sizes in found.items() for i, n in enumerate(sizes)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, i long, n long").repartition(5)
    got = {(r.k, r.i): r.segment for r in greedy_segments(frame, "k", ["i"], "n", most_rows, most_size, long_alone, width).collect()}
    assert got == {(k, i): s for k, sizes in found.items() for i, s in enumerate(plain(sizes, most_rows, most_size, long_alone))}


def test_empty_tables_null_sizes_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "k string, i long, n long")
    assert greedy_segments(empty, "k", ["i"], "n", 3, 10).collect() == []
    rows = spark.createDataFrame([("a", 1, None), ("a", 1, 6), ("a", 1, 6), ("a", 1, 6), (None, None, None)], "k string, i long, n long")
    got = greedy_segments(rows, "k", ["i"], "n", 3, 10)
    assert got.columns == ["k", "i", "n", "segment"]
    assert sorted((r.k or "", r.segment) for r in got.collect() if r.n) == [("a", 0), ("a", 1), ("a", 2)]
    with pytest.raises(ValueError):
        greedy_segments(rows, "k", ["i"], "n", 3, 10, width=13)


def test_running_sums_over_several_parts(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(5000)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(spark.createDataFrame(rows, "k string, i long, n long"), ["k"], ["i"], {"total": F.col("n")}, Rounds(spark, "test")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    want, sums = {}, {}
    for k, i, n in rows:
        rank, total = sums.get(k, (0, 0))
        sums[k] = want[i] = (rank + 1, total + n)
    assert {r.i: (r.rank, r.total) for r in got} == want


def test_units_and_files(spark):
    units = spark.createDataFrame([(1, i, 10 + i, n) for i, n in enumerate([5, 5, 30, 30, 4, 4, 4, 4])], "registry long, ord long, unit long, chars long")
    assert {r.unit: r.segment for r in planned_segments(units, 3, 12).collect()} == {10: 0, 11: 0, 12: -1, 13: -1, 14: 1, 15: 1, 16: 1, 17: 2}
    entries = spark.createDataFrame([(s, i, n) for s in ("x", None) for i, n in enumerate([5, 5, 30, 4, 4, 4, 4])], "sink string, ord long, bytes long")
    assert {tuple(r) for r in rotated(entries, 12, 3).collect()} == {(s, *f) for s in ("x", None) for f in ((1, 1, 30), (2, 3, 12), (3, 1, 4))}
