"""Ordered block trees: closure, paths, reading order, sections and their enumerations.

Frames: nodes(node_id, parent_id, level, title, key), blocks(block_id, node_id, ord, kind, confirmed, ...). Children
come at ord = CHILD + key among their parent's blocks. Closures are joins that double the distance covered until
nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.scratch import Rounds

#: Where child nodes stand among a node's items: behind most blocks, before those with larger numbers.
CHILD = 1_000_000_000_000
HEADING = "heading"


def closure(nodes: DataFrame) -> DataFrame:
    """ancestor, descendant, distance: every node with itself and all above it, however deep the tree is.

    Each step doubles the distance covered, until it adds nothing; two counts are all that reaches the driver. Steps
    are persisted, as each is read by all later ones. Where nodes form a cycle it ends with the step that meets itself.
    """
    above = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("ancestor"), F.col("node_id").alias("descendant"), F.lit(1).alias("distance"))
    own = nodes.select(F.col("node_id").alias("ancestor"), F.col("node_id").alias("descendant"), F.lit(0).alias("distance"))
    last, reached = above, above
    while True:
        # what is `far` above a node's ancestor at the largest distance so far is that much farther
        far, low = reached.alias("far"), last.alias("low")
        distance = (F.col("low.distance") + F.col("far.distance")).alias("distance")
        step = low.join(far, F.col("low.ancestor") == F.col("far.descendant")).select(F.col("far.ancestor").alias("ancestor"), F.col("low.descendant").alias("descendant"), distance).persist()
        found = step.agg(F.count("*").alias("n"), F.count_if(F.col("ancestor") == F.col("descendant")).alias("cycles"), F.max("distance").alias("most")).first()
        if not found["n"]:
            step.unpersist()
            return own.unionByName(reached)
        reached = reached.unionByName(step)
        if found["cycles"]:
            return own.unionByName(reached)
        last = step.filter(F.col("distance") == found["most"])


def paths(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """node_id, depth, path: the titles from below the root down to the node, blank ones skipped."""
    titled = up.join(nodes.select(F.col("node_id").alias("ancestor"), "title", "parent_id"), "ancestor")
    parts = F.filter(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "title", F.col("parent_id").isNull().alias("root")))), lambda x: ~x["root"] & (F.trim(x["title"]) != ""))
    return titled.groupBy(F.col("descendant").alias("node_id")).agg(F.max("distance").alias("depth"), F.array_join(F.transform(parts, lambda x: x["title"]), " > ").alias("path"))


def reading_order(nodes: DataFrame, blocks: DataFrame, up: DataFrame) -> DataFrame:
    """block_id, node_id, sort_key: blocks in depth-first order by sort_key, a fixed-width key of positions from the root."""
    at = nodes.select(F.col("node_id").alias("ancestor"), F.when(F.col("parent_id").isNull(), 0).otherwise(CHILD + F.col("key")).alias("at"))
    steps = up.join(at, "ancestor").groupBy(F.col("descendant").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "at"))), lambda x: F.lpad(x["at"].cast("string"), 14, "0")), "/").alias("prefix"))
    return blocks.join(steps, "node_id").select("block_id", "node_id", F.concat_ws("/", "prefix", F.lpad(F.col("ord").cast("string"), 14, "0")).alias("sort_key"))


def sections(nodes: DataFrame, blocks: DataFrame, word: str = "exclusion") -> DataFrame:
    """node_id, body, exclusions, guarantees, is_exclusion: a title that begins with `word`, or a strict majority of exclusions among blocks that aren't headings."""
    counted = blocks.groupBy("node_id").agg(
        F.count_if(F.col("kind") != HEADING).alias("body"),
        F.count_if(F.col("kind") == "exclusion").alias("exclusions"),
        F.count_if((F.col("kind") == "guarantee") & F.col("confirmed")).alias("guarantees"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = nodes.select("node_id", "title").join(counted, "node_id", "left").select("node_id", "title", zero("body"), zero("exclusions"), zero("guarantees"))
    return out.withColumn("is_exclusion", F.lower("title").startswith(word) | (F.col("exclusions") * 2 > F.col("body"))).drop("title")


def first_after(value: Column, order: Column, partition: list[str]) -> Column:
    """The next non-null value behind each row.

    Read from the end: a frame that grows from the first row is one pass, one that reaches to the last is read again for every row.
    """
    back = Window.partitionBy(*partition).orderBy(order.desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(back)


def opening_conditions(blocks: DataFrame) -> DataFrame:
    """node_id, block_id: a node's first block before its children that isn't a heading, where it is a condition."""
    first = blocks.filter((F.col("kind") != HEADING) & (F.col("ord") < CHILD)).groupBy("node_id").agg(F.min_by(F.struct("block_id", "kind"), "ord").alias("first"))
    return first.filter("first.kind = 'condition'").select("node_id", F.col("first.block_id").alias("block_id"))


def nearest(up: DataFrame, marked: DataFrame, value: str) -> DataFrame:
    """node_id, value of the nearest marked node at or above it."""
    found = up.join(marked.withColumnRenamed("node_id", "ancestor"), "ancestor")
    return found.groupBy(F.col("descendant").alias("node_id")).agg(F.min_by(value, "distance").alias(value))


def common_ancestor(up: DataFrame, members: DataFrame) -> DataFrame:
    """group, node_id: the deepest node at or above all nodes of each group (group, node_id)."""
    distinct = members.distinct()
    sizes = distinct.groupBy("group").agg(F.count("*").alias("size"))
    over = distinct.join(up, distinct.node_id == up.descendant).groupBy("group", "ancestor").agg(F.count("*").alias("n"), F.sum("distance").alias("total"))
    return over.join(sizes, "group").filter("n = size").groupBy("group").agg(F.min_by("ancestor", "total").alias("node_id"))


def subtree_digests(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """node_id, digest: equal where subtrees have equal contents and hang together alike, children in order.

    nodes: node_id, parent_id, level, key; own: node_id, h (a digest of the node's own contents). Digests are made from
    the deepest level up: a node's is that of its own contents, the number of its children and the sums of two halves
    of their digests, each taken with its place among its siblings. Sums are added up on the map side, so that a node
    of any number of children is no large group. There are as many rounds as levels.
    """
    rounds = Rounds(nodes.sparkSession, "subtrees")
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("key", "node_id"))
    placed = rounds.keep(nodes.select("node_id", "parent_id", "level", "key").join(own, "node_id").withColumn("place", place).drop("key"))
    half = lambda at: F.conv(F.substring("mixed", at, 15), 16, 10).cast("decimal(38,0)")
    out, below = None, None
    for level in sorted((r.level for r in placed.select("level").distinct().collect()), reverse=True):  # one row a level
        here = placed.filter(F.col("level") == level)
        if below is None:
            here = here.withColumn("children", F.lit("0:0:0"))
        else:
            sums = below.groupBy(F.col("parent_id").alias("node_id")).agg(F.concat_ws(":", F.count("*"), F.sum(half(1)), F.sum(half(16))).alias("children"))
            here = here.join(sums, "node_id", "left").withColumn("children", F.coalesce("children", F.lit("0:0:0")))
        digest = F.md5(F.concat_ws("/", "h", "children").cast("binary"))
        below = here.withColumn("digest", digest).withColumn("mixed", F.md5(F.concat_ws(":", "place", "digest").cast("binary"))).select("node_id", "parent_id", "digest", "mixed")
        below = rounds.keep(below)
        out = below if out is None else out.unionByName(below)
    return out.select("node_id", "digest") if out is not None else own.select("node_id", F.col("h").alias("digest"))
