"""Tool calls as a table: calls of several tools are split, answered in a batch each, and united."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.scratch import Rounds

TOOLS = ("contents", "open", "search", "definitions")


def answered(calls: DataFrame, nodes: DataFrame, blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """call, tool, ok, n, first, error: every call with its answer, or with what is wrong with it.

    calls: call, tool, arg (a node id, or a word). contents: how many children a node has and the first of them; open:
    its blocks and the first in order; search: how many lines hold the word and the first; definitions: lines that
    begin with it. nodes: node_id, parent_id; blocks: node_id, block_id, ord; lines: line (an id), words.

    A bad call is data like any other: an unknown tool, an unknown node or an empty word gives a row with its error,
    a word that stands nowhere an answer of none. Each tool is one join on what its calls ask for, so equal calls cost
    one look-up, and frequent words are counted before they meet the calls.
    """
    asked = calls.withColumn("arg", F.coalesce("arg", F.lit("")))
    of = lambda tool: asked.filter(F.col("tool") == tool)

    known = nodes.select(F.col("node_id").alias("arg"), F.lit(True).alias("known"))
    children = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("arg")).agg(F.count("*").alias("n"), F.min("node_id").alias("first"))
    opened = blocks.groupBy(F.col("node_id").alias("arg")).agg(F.count("*").alias("n"), F.min_by(F.col("block_id").cast("string"), "ord").alias("first"))
    at_nodes = [of(tool).join(known, "arg", "left").join(found, "arg", "left").withColumn("error", F.when(F.col("known").isNull(), "unknown node")) for tool, found in (("contents", children), ("open", opened))]

    # both tools are answered out of one pass over the words; what is asked for is few, so texts needn't be moved to meet it
    rounds = Rounds(calls.sparkSession, "calls")
    wanted = rounds.keep(asked.filter(F.col("tool").isin("search", "definitions")).select("arg").distinct())
    heads = F.col("pos") == 0
    words = lines.select("line", F.posexplode("words").alias("pos", "arg")).join(wanted, "arg", "left_semi")
    counts = rounds.keep(words.groupBy("arg").agg(F.count("*").alias("n"), F.min("line").alias("first"), F.count_if(heads).alias("n_heads"), F.min(F.when(heads, F.col("line"))).alias("first_head")))
    found = {"search": counts.select("arg", "n", "first"), "definitions": counts.select("arg", F.col("n_heads").alias("n"), F.col("first_head").alias("first"))}
    by_word = [of(tool).join(answers, "arg", "left").withColumn("error", F.when(F.col("arg") == "", "empty word")) for tool, answers in found.items()]

    others = asked.filter(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False))).withColumn("error", F.lit("unknown tool"))
    out = None
    for part in (*at_nodes, *by_word, others):
        missing = [F.lit(None).cast(kind).alias(c) for c, kind in (("n", "long"), ("first", "string")) if c not in part.columns]
        part = part.select("*", *missing)
        ok = F.col("error").isNull()
        part = part.select("call", "tool", ok.alias("ok"), F.when(ok, F.coalesce("n", F.lit(0).cast("long"))).alias("n"), F.when(ok, F.col("first")).alias("first"), "error")
        out = part if out is None else out.unionByName(part)
    return out
