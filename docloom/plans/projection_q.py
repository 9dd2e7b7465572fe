"""Predicates and projections over blocks (orders), readings and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.plans.base import BLOCKS, LINES, NODES, Tables, blocks, lines, nodes, norm_sql, query

_BLOCK = """b AS (SELECT o_orderkey AS block_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE o_orderpriority END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'thin' ELSE 'substantive' END AS surface,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'preliminary' WHEN 2 THEN 'contents' ELSE 'body' END AS source_field, CASE o_orderstatus WHEN 'F' THEN 'manual' WHEN 'O' THEN 'model_verified' END AS kind_source FROM orders)"""


def _typed(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("block_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise(F.col("o_orderpriority")).alias("kind"),
        F.when(key % 4 == 0, "thin").otherwise("substantive").alias("surface"),
        F.when(key % 5 == 0, F.lit(None).cast("string")).when(key % 5 == 1, "preliminary").when(key % 5 == 2, "contents").otherwise("body").alias("source_field"),
        F.when(F.col("o_orderstatus") == "F", "manual").when(F.col("o_orderstatus") == "O", "model_verified").alias("kind_source"),
    )


@query("p1_p2_citable_confirmed", f"WITH {_BLOCK} SELECT block_id, kind <> 'other' AND surface = 'substantive' AND coalesce(source_field, '') NOT IN ('preliminary', 'contents') AS citable, coalesce(kind_source IN ('manual', 'model_verified'), false) AS confirmed FROM b")
def p1(spark, sf):
    """Citable and confirmed; an unknown source field doesn't exclude, an unknown origin of the kind doesn't confirm."""
    citable = (F.col("kind") != "other") & (F.col("surface") == "substantive") & ~F.coalesce("source_field", F.lit("")).isin("preliminary", "contents")
    confirmed = F.coalesce(F.col("kind_source").isin("manual", "model_verified"), F.lit(False))
    return _typed(Tables(spark, sf)).select("block_id", citable.alias("citable"), confirmed.alias("confirmed"))


@query("p3_surface_migration", f"WITH {_BLOCK} SELECT block_id, right('doc:' || block_id, length(CAST(block_id AS VARCHAR)) + 1) = ':' || block_id AS id_fits, CASE WHEN source_field IN ('preliminary', 'contents') THEN 'front' WHEN source_field IS NULL THEN 'unknown' ELSE surface END AS surface_class FROM b")
def p3(spark, sf):
    surface = F.when(F.col("source_field").isin("preliminary", "contents"), "front").when(F.col("source_field").isNull(), "unknown").otherwise(F.col("surface"))
    fits = F.endswith(F.concat(F.lit("doc:"), "block_id"), F.concat(F.lit(":"), "block_id"))
    return _typed(Tables(spark, sf)).select("block_id", fits.alias("id_fits"), surface.alias("surface_class"))


@query("p4_children_and_blocks", f"WITH {NODES}, {BLOCKS}, c AS (SELECT parent_id AS node_id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id), b AS (SELECT node_id, count(*) AS n FROM blocks GROUP BY node_id) SELECT n.node_id, CAST(coalesce(c.n, 0) AS BIGINT) AS children, CAST(coalesce(b.n, 0) AS BIGINT) AS blocks FROM nodes n LEFT JOIN c ON c.node_id = n.node_id LEFT JOIN b ON b.node_id = n.node_id")
def p4(spark, sf):
    t = Tables(spark, sf)
    n = nodes(t)
    items = blocks(t).select("node_id", F.lit(1).alias("block"), F.lit(0).alias("child")).union(n.filter("parent_id is not null").select("parent_id", F.lit(0), F.lit(1)))
    counted = items.groupBy("node_id").agg(F.sum("child").alias("children"), F.sum("block").alias("blocks"))
    return n.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query("p5_source_excerpt", f"WITH {LINES}, t AS (SELECT doc_id, {norm_sql('line')} AS title FROM lines WHERE seq = 1) SELECT d.doc_id, coalesce(x.excerpt, '') AS excerpt FROM documents d LEFT JOIN (SELECT l.doc_id, arg_min(trim(regexp_replace(line, '\\s+', ' ', 'g')), seq) AS excerpt FROM lines l LEFT JOIN t ON t.doc_id = l.doc_id WHERE seq > 1 AND {norm_sql('line')} IS DISTINCT FROM t.title GROUP BY l.doc_id) x ON x.doc_id = d.doc_id")
def p5(spark, sf):
    """The first line behind the title whose normalised text differs from it; empty where there is none."""
    t = Tables(spark, sf)
    all_lines = lines(t).withColumn("norm", tx.normalize(F.col("line")))
    titled = all_lines.withColumn("title", F.first(F.when(F.col("seq") == 1, F.col("norm")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = titled.filter((F.col("seq") > 1) & ~F.col("norm").eqNullSafe(F.col("title"))).groupBy("doc_id").agg(F.min_by(F.trim(F.regexp_replace("line", r"\s+", " ")), "seq").alias("excerpt"))
    return t.documents.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("excerpt", F.lit("")).alias("excerpt"))


@query("p6_overlay_patch", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN coalesce(CASE WHEN p_partkey % 20 = 0 THEN 'PATCHED' END, p_type) ELSE p_type END AS type, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE p_size END AS size, p_partkey % 10 = 0 AS patched FROM part")
def p6(spark, sf):
    """A manual patch by key: its non-null fields replace the base's."""
    part = Tables(spark, sf).part
    overlay = part.filter("p_partkey % 10 = 0").select("p_partkey", F.when(F.col("p_partkey") % 20 == 0, "PATCHED").alias("new_type"), F.lit(1).alias("new_size"))
    joined = part.join(overlay, "p_partkey", "left")
    return joined.select("p_partkey", F.coalesce("new_type", "p_type").alias("type"), F.coalesce("new_size", "p_size").alias("size"), F.col("new_size").isNotNull().alias("patched"))


@query(
    "p7_perimeter_text",
    """WITH s AS (SELECT n_regionkey, n_nationkey, n_name, sum(length(n_name) + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS upto, sum(length(n_name) + 1) OVER (PARTITION BY n_regionkey) AS whole FROM nation)
    SELECT r_regionkey, string_agg(n_name, chr(10) ORDER BY n_nationkey) FILTER (upto <= 40) AS text, bool_or(upto > 40) AS cut, CASE WHEN any_value(whole) <= 40 THEN 'whole' WHEN min(upto) <= 40 THEN 'part' ELSE 'none' END AS tier FROM region JOIN s ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
)
def p7(spark, sf):
    """Titles of a level in order while they fit 40 characters, with a flag for what was dropped."""
    per = Window.partitionBy("n_regionkey")
    sized = Tables(spark, sf).nation.withColumn("upto", F.sum(F.length("n_name") + 1).over(per.orderBy("n_nationkey"))).withColumn("whole", F.sum(F.length("n_name") + 1).over(per))
    kept = F.array_sort(F.collect_list(F.when(F.col("upto") <= 40, F.struct("n_nationkey", "n_name"))))
    tier = F.when(F.first("whole") <= 40, "whole").when(F.min("upto") <= 40, "part").otherwise("none")
    return sized.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(kept, lambda x: x["n_name"]), "\n").alias("text"), F.bool_or(F.col("upto") > 40).alias("cut"), tier.alias("tier"))


_PROFILE = {"type": "PROMO", "brand": "Brand#7", "size": "big"}
_CONDITIONS = "cond AS (SELECT p_partkey AS node, 'type' AS k, p_type AS v FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'size', CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'age', 'old' FROM part WHERE p_partkey % 11 = 0)"
_HOLDS = "(k, v) IN (('type', 'PROMO'), ('brand', 'Brand#7'), ('size', 'big'))"


def _conditions(t: Tables):
    key = F.col("p_partkey")
    pairs = F.array(
        F.when(key % 2 == 0, F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v"))),
        F.when(key % 3 == 0, F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v"))),
        F.when(key % 5 == 0, F.struct(F.lit("size").alias("k"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("v"))),
        F.when(key % 11 == 0, F.struct(F.lit("age").alias("k"), F.lit("old").alias("v"))),
    )
    profile = F.create_map(*[F.lit(x) for pair in _PROFILE.items() for x in pair])
    exploded = t.part.select(key.alias("node"), F.explode(F.array_compact(pairs)).alias("c")).select("node", "c.*")
    return exploded.withColumn("held", F.try_element_at(profile, F.col("k")))


@query("p8_p12_bounded_profile", "SELECT conv_id, CAST(count(*) FILTER (length(text) <= 80) AS BIGINT) AS kept, CAST(count(*) FILTER (length(text) > 80) AS BIGINT) AS ignored FROM conversations GROUP BY conv_id")
def p8(spark, sf):
    """Labels within the length bound are kept, the others counted as ignored."""
    return Tables(spark, sf).conversations.groupBy("conv_id").agg(F.count_if(F.length("text") <= 80).alias("kept"), F.count_if(F.length("text") > 80).alias("ignored"))


@query("p9_p10_profile_nodes", f"WITH {_CONDITIONS} SELECT node FROM cond GROUP BY node HAVING bool_and({_HOLDS})")
def p10(spark, sf):
    """Nodes whose every condition the profile satisfies; a key that the profile lacks doesn't."""
    return _conditions(Tables(spark, sf)).groupBy("node").agg(F.bool_and(F.coalesce(F.col("held") == F.col("v"), F.lit(False))).alias("fits")).filter("fits").select("node")


@query("p11_permissive_profile", f"WITH {_CONDITIONS} SELECT node FROM cond GROUP BY node HAVING bool_and(k NOT IN ('type', 'brand', 'size') OR {_HOLDS})")
def p11(spark, sf):
    """The permissive twin: a key that the profile lacks is satisfied."""
    return _conditions(Tables(spark, sf)).groupBy("node").agg(F.bool_and(F.col("held").isNull() | (F.col("held") == F.col("v"))).alias("fits")).filter("fits").select("node")


@query("p13_search_terms", "SELECT l_orderkey, array_to_string(list(f ORDER BY place, f), ',') AS terms FROM (SELECT l_orderkey, f, min(place) AS place FROM (SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS f, unnest([1, 2]) * 1000 + l_linenumber AS place FROM lineitem) GROUP BY l_orderkey, f) GROUP BY l_orderkey")
def p13(spark, sf):
    """Terms, then themes, without repeats, in order of first appearance."""
    per = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))).alias("x"))
    first = F.array_sort(F.transform("x", lambda v: F.struct(v["l_linenumber"].alias("n"), v["l_returnflag"].alias("f"))))
    second = F.array_sort(F.transform("x", lambda v: F.struct(v["l_linenumber"].alias("n"), v["l_linestatus"].alias("f"))))
    both = F.array_distinct(F.transform(F.concat(first, second), lambda v: v["f"]))
    return per.select("l_orderkey", F.array_join(both, ",").alias("terms"))


@query("p14_cachable", "SELECT c_custkey, c_acctbal > 0 AND c_mktsegment <> 'HOUSEHOLD' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS cachable FROM customer")
def p14(spark, sf):
    """Served, not in quarantine, and without an alert."""
    t = Tables(spark, sf)
    alerts = t.orders.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("alert", F.lit(True))
    joined = t.customer.join(alerts, "c_custkey", "left")
    return joined.select("c_custkey", ((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "HOUSEHOLD") & F.col("alert").isNull()).alias("cachable"))


@query("p15_filter_faq", f"SELECT doc_id FROM documents WHERE contains({norm_sql('text')}, 'ation') AND contains({norm_sql('text')}, 'the') AND contains({norm_sql('text')}, 'ing ')")
def p15(spark, sf):
    """Texts that contain every term."""
    terms = F.array(F.lit("ation"), F.lit("the"), F.lit("ing "))
    hay = Tables(spark, sf).documents.select("doc_id", tx.normalize(F.col("text")).alias("hay"))
    return hay.filter(F.forall(terms, lambda x: F.contains(F.col("hay"), x))).select("doc_id")


@query("p16_circular_label", "SELECT p_partkey, (contains(p_name, 'ring') OR contains(p_name, 'bolt')) AND len(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('ring', 'bolt', 'small', 'red', 'blue'))) = 0 AS circular FROM part")
def p16(spark, sf):
    """A label that names the coverage and otherwise only words that say nothing more."""
    tokens = F.split("p_name", " ")
    root = F.exists(tokens, lambda w: w.contains("ring") | w.contains("bolt"))
    rest = F.forall(tokens, lambda w: w.isin("ring", "bolt", "small", "red", "blue"))
    return Tables(spark, sf).part.select("p_partkey", (root & rest).alias("circular"))
