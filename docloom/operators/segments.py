"""Greedy segments of sequences of any length: each as long as its bounds allow, the next begins where one ends.

Where a segment begins depends on all before it, yet only through one number, the row at which a block of the sequence
is entered. So a sequence is cut into blocks of bounded weight, each block tells for every row that may be its entry
where the next block is then entered, and these maps are composed in pairs, pairs of pairs and so on, until the entries
follow from above. No sequence is ever in one task, however long; the maps are a small share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.folds import fold_rows
from docloom.scratch import Rounds


def running(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], rounds: Rounds) -> DataFrame:
    """The rows with `rank` (from 1) and running sums (of whole numbers, the row's own included) within each key.

    Rows are dealt out by ranges of key and order, so that a large key lies in many parts; what the parts before hold is
    added to the sums within a part. Rows equal in key and order are ranked at random, once. Keys mustn't be null.
    """
    named = {"rank": F.lit(1).cast("long"), **sums}
    placed = rounds.keep(rows.repartitionByRange(*key, *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*key, "part").agg(*[F.sum(c).alias(n) for n, c in named.items()])
    before = totals.select(*key, "part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in named])
    within = Window.partitionBy(*key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(within).alias(n) for n, c in named.items()])
    full = local.join(before, [*key, "part"])
    return rounds.keep(full.select(*rows.columns, *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in named]))


def _block_maps(cells: DataFrame, most_rows: int, most_size: int) -> DataFrame:
    """seq, block, entry, exit: for each possible entry of a block, where the next one is entered then, if at all.

    cells: cell, seq, block, rank, size, own (false for the first rows of the next block), entry (may be one).
    """

    def step(state: list, row: tuple) -> Iterable[tuple]:
        state.append(row[1:])
        return ()

    def end(state: list, cell: str) -> Iterable[tuple]:
        size = np.array([r[3] for r in state], dtype=np.int64)
        ends, places = np.cumsum(size), np.arange(len(size))
        following = np.searchsorted(ends, ends - size + most_size, side="right")
        following = np.maximum(np.minimum(following, places + most_rows), places + 1).tolist()
        own = sum(r[4] for r in state)
        beyond = following[:]
        for i in reversed(range(own)):
            if following[i] < own:
                beyond[i] = beyond[following[i]]
        return [(seq, block, rank, state[beyond[i]][2]) for i, (seq, block, rank, _, _, entry) in enumerate(state[:own]) if entry and beyond[i] < len(state)]

    return fold_rows(cells.select("cell", "seq", "block", "rank", "size", "own", "entry"), "cell", ["rank"], list, step, "seq string, block long, entry long, exit long", end)


def _entries(maps: DataFrame, first: DataFrame, rounds: Rounds) -> DataFrame:
    """seq, block, entry: the row at which each block is really entered; `first` holds that of every block 0.

    Upwards, the maps of two neighbouring spans of blocks make that of both; downwards, each span's entry gives that of
    its second half. Every level is half as large as the one below.
    """
    levels, span, found = [maps], 1, first
    last = maps.agg(F.max("block")).first()[0]
    if last is None:
        return first
    while 2 * span <= last + 1:
        below = levels[-1]
        left = below.filter(F.col("block") % (2 * span) == 0)
        right = below.filter(F.col("block") % (2 * span) == span).select("seq", (F.col("block") - span).alias("block"), F.col("entry").alias("exit"), F.col("exit").alias("far"))
        levels.append(rounds.keep(left.join(right, ["seq", "block", "exit"]).select("seq", "block", "entry", F.col("far").alias("exit"))))
        span *= 2
    for level in reversed(levels):
        reached = found.join(level, ["seq", "block", "entry"]).select("seq", (F.col("block") + span).alias("block"), F.col("exit").alias("entry"))
        found = rounds.keep(found.unionByName(reached))
        span //= 2
    return found


def greedy_segments(rows: DataFrame, key: str, order: list[str], size: str, most_rows: int, most_size: int, long_alone: bool = True, width: int | None = None) -> DataFrame:
    """The rows and their `segment` (from 0) within the key.

    A segment takes rows in order until the next would be its `most_rows` + 1st or bring its sizes above `most_size`. A
    row above `most_size` stands alone, as a segment of its own or, without `long_alone`, as -1 between segments. A null
    key is a key; sizes are whole numbers of at least 0, null counting as 0. `width` is the weight of a block.
    """
    rounds = Rounds(rows.sparkSession, "segments")
    reach = most_size + most_rows  # no farther from a segment's start to the next one's, in sizes and rows together
    width = width or max(64 * reach, 1 << 20)
    if width <= reach:
        raise ValueError(f"blocks of {width} must be wider than {reach}")
    seq = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    sized = rows.withColumn("_seq", seq).withColumn("_size", F.least(F.coalesce(F.col(size), F.lit(0)), F.lit(most_size + 1)).cast("long"))
    weight = F.least(F.col("_size"), F.lit(most_size)) + 1
    ranked = running(sized, ["_seq"], order, {"_end": weight}, rounds).withColumnRenamed("rank", "_rank")
    at = F.col("_end") - weight
    placed = ranked.withColumn("_block", F.floor(at / width)).withColumn("_near", at % width <= reach)

    slim = placed.select(F.col("_seq").alias("seq"), F.col("_block").alias("block"), F.col("_rank").alias("rank"), F.col("_size").alias("size"), F.col("_near").alias("near"))
    here = F.struct(F.col("block"), F.lit(True).alias("own"), F.col("near").alias("entry"))
    ahead = F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("own"), F.lit(False).alias("entry"))
    seen = slim.select("seq", "rank", "size", F.inline(F.when(F.col("near") & (F.col("block") > 0), F.array(here, ahead)).otherwise(F.array(here))))
    cell = F.concat_ws(":", F.col("block").cast("string"), "seq")
    maps = rounds.keep(_block_maps(seen.withColumn("cell", cell), most_rows, most_size))
    first = slim.select("seq").distinct().select("seq", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("entry"))
    entered = slim.join(_entries(maps, first, rounds), ["seq", "block"], "left")

    def step(state: dict, row: tuple) -> Iterable[tuple]:
        _, name, block, rank, much, entry = row
        starts = rank == entry or (state["rows"] and (state["rows"] == most_rows or state["size"] + much > most_size))
        if starts:
            state.update(rows=0, size=0, segments=state["segments"] + (long_alone or much <= most_size))
        if starts or state["rows"]:
            state.update(rows=state["rows"] + 1, size=state["size"] + much)
        return [(name, block, rank, state["segments"])]

    begin = lambda: {"rows": 0, "size": 0, "segments": 0}
    columns = entered.withColumn("cell", cell).select("cell", "seq", "block", "rank", "size", "entry")
    counted = rounds.keep(fold_rows(columns, "cell", ["rank"], begin, step, "_seq string, _block long, _rank long, _segments long"))
    per_block = counted.groupBy("_seq", "_block").agg(F.max("_segments").alias("_in_block"))
    before = running(per_block, ["_seq"], ["_block"], {"_until": F.col("_in_block")}, rounds).select("_seq", "_block", (F.col("_until") - F.col("_in_block")).alias("_before"))
    number = (F.col("_before") + F.col("_segments") - 1).cast("int")
    segment = number if long_alone else F.when(F.col("_size") <= most_size, number).otherwise(-1)
    joined = placed.join(counted, ["_seq", "_block", "_rank"]).join(before, ["_seq", "_block"])
    return joined.select(*rows.columns, segment.alias("segment"))
