"""Line deduplication by a distributed suffix array over line ids.

Every document is a sequence of lines. Lines that occur once end every repeat, so only positions whose line is
repeated stay in play. Prefix doubling ranks their suffixes by the first 1, 2, 4, ... lines: the pair of a
position's rank and the rank `h` lines on is sorted anew, and pairs that occur once are discarded, as no longer
prefix of theirs repeats; it goes on until no pair repeats. A class of equal ranks at depth h is the interval of the
suffix array whose longest common prefix is at least h lines; a window of any length between two powers of two is
the pair of two overlapping classes, which is needed only while a run's words are few.

The first place of a class is its original, every other one begins a later copy. The intervals of lines that later
copies cover, from classes of all depths, are merged along each document: the maximal runs are what is cut.

All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch

#: A word is a run of other characters than space, tab and line breaks.
WORD = r"[^ \t-\r]+"


def _numbered_lines(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc, part, at, pos, words and the 128-bit id of every line with a word; `at` numbers those, `pos` all lines."""
    text = F.col(text_column)
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("id_a"), F.xxhash64(F.lit(1), x).alias("id_b"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    return (
        df.filter(text.isNotNull())
        .select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("part"), F.posexplode(F.filter(lines, lambda x: x["words"] > 0)).alias("at", "line"))
        .select("doc", "part", "at", "line.*")
    )


def _ranked(classes: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """Classes with `rank`: increasing in the order of their keys across partitions, gaps allowed."""
    ordered = classes.repartitionByRange(*by).sortWithinPartitions(*by)
    return scratch.keep(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def suffix_levels(lines: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Level k: doc, part, at, rank of the positions whose first 2**k lines occur elsewhere too; the last one isn't empty unless it is the first.

    Within a level, ranks order the suffixes by those lines (in the order of line ids).
    """
    place = ["doc", "part", "at"]
    repeated = lines.groupBy("id_a", "id_b").agg(F.count("*").alias("n")).filter("n > 1").select("id_a", "id_b")
    ranks = _ranked(repeated, ["id_a", "id_b"], scratch)
    level = scratch.keep(lines.join(ranks, ["id_a", "id_b"]).select(*place, "pos", "words", "rank"), "level")
    scratch.drop(ranks)
    levels, h = [level], 1
    while True:
        ahead = Window.partitionBy("doc", "part").orderBy("at").rangeBetween(h, h)
        pairs = scratch.keep(level.select(*place, "rank", F.first("rank").over(ahead).alias("next")).filter("next is not null").withColumnRenamed("rank", "first"), "pairs")
        classes = pairs.groupBy("first", "next").agg(F.count("*").alias("n")).filter("n > 1").select("first", "next")
        ranks = _ranked(classes, ["first", "next"], scratch)
        if ranks.isEmpty():
            scratch.drop(pairs, ranks)
            return levels
        level = scratch.keep(pairs.join(ranks, ["first", "next"]).select(*place, "rank"), "level")
        scratch.drop(pairs, ranks)
        levels.append(level)
        h *= 2


def _windows(levels: list[DataFrame], min_words: int) -> DataFrame:
    """Windows of at most min_words repeated lines with min_words words that lose it without their first or their last line.

    Columns: doc, part, at, lines (length), class_a, class_b (the ranks of its two overlapping blocks). Every run
    with min_words words is a union of such windows.
    """
    place = ["doc", "part", "at"]
    names = [f"rank_{k}" for k in range(len(levels))]
    parts = []
    for k, level in enumerate(levels):
        ranks = [F.col("rank").alias(n) if i == k else F.lit(None).cast("long").alias(n) for i, n in enumerate(names)]
        words = F.col("words") if k == 0 else F.lit(None).cast("int").alias("words")
        parts.append(level.select(*place, words, *ranks))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy(*place).agg(*[F.max(n).alias(n) for n in ("words", *names)])
    ahead = Window.partitionBy("doc", "part").orderBy("at").rangeBetween(0, min_words - 1)
    merged = merged.withColumn("ahead", F.collect_list(F.struct("at", "words", *names)).over(ahead))

    def element(i: int) -> Column:
        return F.get("ahead", F.lit(i))

    found = []
    for length in range(1, min_words + 1):
        k = length.bit_length() - 1
        if k >= len(levels):
            break
        words = sum((element(i)["words"] for i in range(1, length)), element(0)["words"])
        whole = (F.size("ahead") >= length) & (element(length - 1)["at"] == F.col("at") + length - 1)
        tight = (words - element(0)["words"] < min_words) | (words - element(length - 1)["words"] < min_words)
        a, b = element(0)[f"rank_{k}"], element(length - 2**k)[f"rank_{k}"]
        window = F.struct(F.lit(length).alias("lines"), a.alias("class_a"), b.alias("class_b"))
        found.append(F.when(whole & (words >= min_words) & tight & a.isNotNull() & b.isNotNull(), window))
    return merged.select(*place, F.explode(F.array_compact(F.array(*found))).alias("window")).select(*place, "window.*")


def later_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 5) -> DataFrame:
    """doc, part (hash of the text) and `removed`: the positions of lines inside later copies of repeated runs."""
    scratch = Scratch(df.sparkSession, "lines")
    place = ["doc", "part", "at"]
    lines = scratch.keep(_numbered_lines(df, id_column, text_column), "lines")
    levels = suffix_levels(lines, scratch)
    scratch.drop(lines)
    # classes of more than min_words lines have the words by themselves, of fewer lines only some windows have
    shallow = min_words.bit_length()
    windows = _windows(levels[:shallow], min_words)
    for k, level in enumerate(levels[shallow:], shallow):
        windows = windows.unionByName(level.select(*place, F.lit(2**k).alias("lines"), F.col("rank").alias("class_a"), F.col("rank").alias("class_b")))
    windows = scratch.keep(windows, "windows")
    scratch.drop(*levels[1:])
    where = F.struct(F.col("doc").isNull().alias("x"), *place)
    classes = ["lines", "class_a", "class_b"]
    firsts = windows.groupBy(*classes).agg(F.min(where).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = scratch.keep(firsts, "firsts")
    copies = windows.join(firsts, classes).filter(~where.eqNullSafe(F.col("origin")))
    ends = copies.select(*place, F.lit(None).cast("int").alias("pos"), (F.col("at") + F.col("lines")).alias("end"))
    both = levels[0].select(*place, "pos", F.lit(None).cast("int").alias("end")).unionByName(ends)
    along = Window.partitionBy("doc", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    reach = both.groupBy(*place).agg(F.max("pos").alias("pos"), F.max("end").alias("end")).withColumn("reach", F.max("end").over(along))
    removed = scratch.keep(reach.filter("at < reach").groupBy("doc", "part").agg(F.array_sort(F.collect_list("pos")).alias("removed")), "removed")
    scratch.drop(windows, firsts, levels[0])
    return removed


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 5) -> DataFrame:
    """The rows of df with later copies of repeated line runs cut from the text, and `lines` and `removed` (positions).

    A run is one or more consecutive lines (lines without a word don't count and always stay) with at least
    `min_words` words in all. Its first copy is the one with the smallest id, then hash of the text, then position;
    every line inside another copy is removed, copies within one document included. Runs don't cross documents.

    Null texts stay null, with no lines; empty texts have one empty line; null ids come last; rows that agree in id
    and text count as one copy and fare alike; other columns stay as they are, whatever their names (a column
    called `lines` or `removed` is replaced).
    """
    cuts = later_copies(df, id_column, text_column, min_words).toDF("__cut_doc", "__cut_part", "removed")
    names = [c for c in df.columns if c not in ("lines", "removed")]
    left = df.select(*[F.col(f"`{c}`") for c in names]).withColumns({"__part": F.xxhash64(F.col(text_column)), "__doc": F.col(id_column).cast("long")})
    joined = left.join(cuts, (F.col("__part") == F.col("__cut_part")) & F.col("__doc").eqNullSafe(F.col("__cut_doc")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    split = F.split(F.col(text_column), "\n", -1)
    bounds = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(split)))  # what stays lies between them
    between = lambda x: F.transform(F.sequence(F.lit(1), F.size(x["bounds"]) - 1), lambda i: F.slice(x["lines"], F.get(x["bounds"], i - 1) + 2, F.get(x["bounds"], i) - F.get(x["bounds"], i - 1) - 1))
    # a lambda's variable holds the lines once; a column would be split again for every piece
    kept = F.transform(F.array(F.struct(split.alias("lines"), bounds.alias("bounds"))), lambda x: F.array_join(F.flatten(between(x)), "\n"))[0]
    text = F.when(F.col("removed").isNull(), F.col(text_column)).otherwise(kept)
    lines = F.when(F.col(text_column).isNull(), 0).otherwise(F.size(split))
    return joined.select(*[text.alias(c) if c == text_column else F.col(f"`{c}`") for c in names], lines.cast("long").alias("lines"), removed.alias("removed"))
