"""Answer assembly, coverage and audit helpers over conversations, orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.plans.base import BLOCKS, NODES, CLOSURE, Tables, blocks, nodes, query
from docloom.operators import tree


@query("e1_answer_text", "SELECT conv_id, sha256(string_agg(trim(text), ' ' ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def e1(spark, sf):
    """Trimmed segments that aren't blank, joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))), lambda x: x["t"])
    return Tables(spark, sf).conversations.filter(F.trim("text") != "").groupBy("conv_id").agg(F.sha2(F.array_join(parts, " ").cast("binary"), 256).alias("digest"))


@query("e2_first_mentions", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem) WHERE pos = 1")
def e2(spark, sf):
    """A claim's linkage follows its first segment only."""
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey"))
    return Tables(spark, sf).lineitem.withColumn("pos", place).filter("pos = 1").select("l_orderkey", "l_partkey", "l_linenumber")


@query("e3_declared_marks", "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderstatus <> 'P' THEN 'cause: ' || o_orderstatus END, CASE WHEN o_totalprice > 100000 THEN 'event: ' || o_orderpriority END) AS marks FROM orders")
def e3(spark, sf):
    cause = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("cause: "), "o_orderstatus"))
    event = F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("event: "), "o_orderpriority"))
    return Tables(spark, sf).orders.select("o_orderkey", F.concat_ws("; ", cause, event).alias("marks"))


@query("e4_gap_templates", "SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'one block was not read' ELSE count(*) || ' blocks were not read' END AS text FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey")
def e4(spark, sf):
    """Templates by number, singular only for one."""
    text = F.when(F.col("n") == 1, "one block was not read").otherwise(F.concat(F.col("n").cast("string"), F.lit(" blocks were not read")))
    return Tables(spark, sf).lineitem.filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", text.alias("text"))


@query("e5_unknown_and_notice", "SELECT l_orderkey, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_returnflag <> 'A'), '') AS missing, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_returnflag = 'A'), '') AS notice FROM lineitem GROUP BY l_orderkey")
def e5(spark, sf):
    """Gaps split into what is missing and what is only noticed, each once."""
    flags = F.array_sort(F.collect_set("l_returnflag"))
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.array_join(F.filter(flags, lambda x: x != "A"), ",").alias("missing"), F.array_join(F.filter(flags, lambda x: x == "A"), ",").alias("notice"))


@query("e6_cited_by_facet", "SELECT l_suppkey AS facet, CAST(count(DISTINCT l_partkey) AS BIGINT) AS blocks, CAST(count(DISTINCT (l_orderkey, l_partkey)) AS BIGINT) AS proofs FROM lineitem GROUP BY l_suppkey")
def e6(spark, sf):
    return Tables(spark, sf).lineitem.groupBy(F.col("l_suppkey").alias("facet")).agg(F.countDistinct("l_partkey").alias("blocks"), F.countDistinct("l_orderkey", "l_partkey").alias("proofs"))


@query("e7_useful_retry", "SELECT l_orderkey, CASE WHEN count(*) = 0 THEN false WHEN bool_or(l_returnflag = 'R' AND l_tax > 0.05) THEN true WHEN bool_and(l_returnflag = 'N') THEN true ELSE false END AS retry FROM lineitem GROUP BY l_orderkey")
def e7(spark, sf):
    retry = F.when(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05)), True).when(F.bool_and(F.col("l_returnflag") == "N"), True).otherwise(False)
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(retry.alias("retry"))


@query("e8_e9_decision_base", "WITH k AS (SELECT o_custkey, o_orderpriority AS facet, bool_or(l_returnflag IN ('A', 'R') AND l_linestatus = 'F') AS based FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderpriority) SELECT c_custkey, coalesce(bool_and(coalesce(based, false)), false) AS based FROM customer LEFT JOIN k ON o_custkey = c_custkey GROUP BY c_custkey")
def e8(spark, sf):
    """Every facet of a case has a claim on a confirmed founding block; false where there are no facets."""
    t = Tables(spark, sf)
    founding = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "F")).alias("b"))
    per_facet = t.orders.join(founding, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey", "o_orderpriority").agg(F.bool_or("b").alias("b"))
    per_case = per_facet.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_and(F.coalesce("b", F.lit(False))).alias("based"))
    return t.customer.select("c_custkey").join(per_case, "c_custkey", "left").select("c_custkey", F.coalesce("based", F.lit(False)).alias("based"))


@query("e11_omitted_founders", "WITH f AS (SELECT l_orderkey, l_partkey, l_linestatus = 'F' AS cited FROM lineitem WHERE l_returnflag = 'A') SELECT l_orderkey, min(l_partkey) AS first, CAST(least(count(DISTINCT l_partkey), 3) AS BIGINT) AS n FROM f GROUP BY l_orderkey HAVING NOT bool_or(cited)")
def e11(spark, sf):
    """Founding blocks that were opened, only where none of them is cited; three at most."""
    f = Tables(spark, sf).lineitem.filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.bool_or(F.col("l_linestatus") == "F").alias("cited"), F.min("l_partkey").alias("first"), F.least(F.countDistinct("l_partkey"), F.lit(3)).alias("n"))
    return f.filter("not cited").select("l_orderkey", "first", F.col("n").cast("long").alias("n"))


@query("e12_uncovered_facets", "WITH s AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS covered FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(list_filter([1, 2, 3, 4, 5, 6, 7], lambda x: NOT list_contains(covered, x)), ',') AS open FROM s")
def e12(spark, sf):
    open_ = F.array_except(F.sequence(F.lit(1), F.lit(7)), F.collect_set("l_linenumber"))
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.array_join(open_.cast("array<string>"), ",").alias("open"))


@query("e13_absence_proof", "WITH t AS (SELECT DISTINCT p_brand AS term FROM part), u AS (SELECT p_brand, CAST(count(DISTINCT p_name) AS BIGINT) AS variants FROM part GROUP BY p_brand), n AS (SELECT count(*) AS blocks, count(DISTINCT source) AS documents FROM documents) SELECT term, variants, blocks, documents FROM t JOIN u ON u.p_brand = term CROSS JOIN n WHERE term NOT IN (SELECT source FROM documents)")
def e13(spark, sf):
    """What was looked for in vain: the term, its variants, and how much was read."""
    t = Tables(spark, sf)
    read = t.documents.agg(F.count("*").alias("blocks"), F.countDistinct("source").alias("documents"))  # one row
    terms = t.part.groupBy(F.col("p_brand").alias("term")).agg(F.countDistinct("p_name").alias("variants"))
    found = t.documents.select(F.col("source").alias("term")).distinct()
    return terms.join(found, "term", "left_anti").crossJoin(F.broadcast(read))


@query("e15_unread_facets", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def e15(spark, sf):
    t = Tables(spark, sf)
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("e16_nearest_nodes", "WITH h AS (SELECT l_suppkey AS facet, l_partkey AS node, min((l_extendedprice, l_orderkey, l_linenumber)) AS pos FROM lineitem GROUP BY l_suppkey, l_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY pos, node) AS k FROM h) SELECT facet, node, CAST(k AS INT) AS k FROM r WHERE k <= 3")
def e16(spark, sf):
    """The first three different nodes in the order of the hits."""
    first = Tables(spark, sf).lineitem.groupBy(F.col("l_suppkey").alias("facet"), F.col("l_partkey").alias("node")).agg(F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("pos"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("facet").orderBy("pos", "node"))).filter("k <= 3").select("facet", "node", "k")


@query("e17_decision_inventory", f"WITH {NODES}, {BLOCKS} SELECT block_id, kind, title, left(kind || ' ' || title, 12) AS excerpt FROM blocks b JOIN nodes n ON n.node_id = b.node_id WHERE kind IN ('exclusion', 'guarantee') AND confirmed")
def e17(spark, sf):
    t = Tables(spark, sf)
    kept = blocks(t).filter(F.col("kind").isin("exclusion", "guarantee") & F.col("confirmed"))
    return kept.join(nodes(t).select("node_id", "title"), "node_id").select("block_id", "kind", "title", F.substring(F.concat_ws(" ", "kind", "title"), 1, 12).alias("excerpt"))


@query("e18_subtree_listing", f"WITH {NODES}, {CLOSURE} SELECT c.ancestor AS root, c.descendant AS node_id, repeat('  ', distance) || n.title AS line FROM closure c JOIN nodes n ON n.node_id = c.descendant WHERE c.ancestor LIKE 'n%'")
def e18(spark, sf):
    """A subtree's titles, indented by the level below its root."""
    n = nodes(Tables(spark, sf))
    up = tree.closure(n).filter(F.col("ancestor").startswith("n"))
    return up.join(n.select(F.col("node_id").alias("descendant"), "title"), "descendant").select(F.col("ancestor").alias("root"), F.col("descendant").alias("node_id"), F.concat(F.expr("repeat('  ', distance)"), "title").alias("line"))


@query("e20_normalised_proofs", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS proofs, CAST(count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS BIGINT) AS rejected FROM lineitem GROUP BY l_orderkey")
def e20(spark, sf):
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ",").alias("proofs"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("rejected"))


@query("e21_decision_predicate", "SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'A' AND l_linestatus = 'F')")
def e21(spark, sf):
    t = Tables(spark, sf)
    quotes = t.lineitem.filter("l_returnflag = 'A' and l_linestatus = 'F'")
    return t.orders.filter("o_orderstatus = 'F'").join(quotes, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("e22_step_costs", "SELECT user_id, event_type, round(sum(value), 2) AS cost, CAST(count(*) AS BIGINT) AS calls, min(event_id) AS first FROM events GROUP BY user_id, event_type")
def e22(spark, sf):
    return Tables(spark, sf).events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("cost"), F.count("*").alias("calls"), F.min("event_id").alias("first"))


@query("e23_expectations", "SELECT l_orderkey, bool_and(l_quantity < 50) AS typed, list_has_all(list(DISTINCT l_returnflag), ['A']) AS opened, bool_and(CASE WHEN l_suppkey % 7 = 0 THEN true ELSE l_suppkey < 1000000 END) AS sound FROM lineitem GROUP BY l_orderkey")
def e23(spark, sf):
    """Every block typed, the expected one opened, no technical error (an unknown status is none)."""
    status = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey"))
    return Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") < 50).alias("typed"), F.array_contains(F.collect_set("l_returnflag"), "A").alias("opened"), F.bool_and(F.coalesce(status < 1000000, F.lit(True))).alias("sound"))


@query("e24_review_plan", "SELECT k.p AS part, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN p_size = 1 THEN 'no box' ELSE 'shown' END AS state FROM (SELECT DISTINCT l_partkey + l_linenumber % 2 * 7 AS p FROM lineitem) k LEFT JOIN part ON p_partkey = k.p")
def e24(spark, sf):
    t = Tables(spark, sf)
    keys = t.lineitem.select((F.col("l_partkey") + F.col("l_linenumber") % 2 * 7).alias("part")).distinct()
    state = F.when(F.col("p_partkey").isNull(), "unknown").when(F.col("p_size") == 1, "no box").otherwise("shown")
    return keys.join(t.part, F.col("part") == F.col("p_partkey"), "left").select("part", state.alias("state"))


@query("e25_alert_rows", "SELECT 'alert' AS kind, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_totalprice < 5000 UNION ALL SELECT 'quarantine', c_name FROM customer WHERE c_acctbal < -500")
def e25(spark, sf):
    t = Tables(spark, sf)
    return t.orders.filter("o_totalprice < 5000").select(F.lit("alert").alias("kind"), F.col("o_orderkey").cast("string").alias("id")).unionByName(t.customer.filter("c_acctbal < -500").select(F.lit("quarantine").alias("kind"), F.col("c_name").alias("id")))


@query("e26_masked_paths", "SELECT page_id, regexp_replace(url, '/[a-z]{2}/[0-9]+', '/<path>') AS shown FROM pages")
def e26(spark, sf):
    """Paths in a reason that is shown are masked."""
    return Tables(spark, sf).pages.select("page_id", F.regexp_replace("url", "/[a-z]{2}/[0-9]+", "/<path>").alias("shown"))


@query("e27_typed_questions", "SELECT o_orderkey, array_to_string(list_transform(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'state' END, CASE WHEN o_totalprice < 90000 THEN 'amount' END], lambda x: x IS NOT NULL), lambda x: CASE WHEN o_orderpriority = '1-URGENT' THEN x || '!' ELSE x END), ',') AS questions FROM orders")
def e27(spark, sf):
    asked = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", "state"), F.when(F.col("o_totalprice") < 90000, "amount")))
    marked = F.transform(asked, lambda x: F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(x, F.lit("!"))).otherwise(x))
    return Tables(spark, sf).orders.select("o_orderkey", F.array_join(marked, ",").alias("questions"))


@query("e30_files_to_fetch", "SELECT d.doc_id, CASE WHEN p.page_id IS NOT NULL THEN 'committed' WHEN d.lang = 'en' THEN 'fetchable' ELSE 'error' END AS state FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def e30(spark, sf):
    t = Tables(spark, sf)
    state = F.when(F.col("page_id").isNotNull(), "committed").when(F.col("lang") == "en", "fetchable").otherwise("error")
    return t.documents.select("doc_id", "lang").join(t.pages.select("page_id"), F.col("doc_id") == F.col("page_id"), "left").select("doc_id", state.alias("state"))


@query("e31_bounded_labels", "WITH s AS (SELECT conv_id, list(trim(text) ORDER BY turn) AS all_of FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(len(list_filter(all_of, lambda x: x <> '' AND length(x) <= 200)[1:3]) AS INT) AS kept, CAST(len(all_of) - len(list_filter(all_of, lambda x: x <> '' AND length(x) <= 200)[1:3]) AS INT) AS dropped FROM s")
def e31(spark, sf):
    """Labels trimmed, blank and long ones dropped, the first three kept, the others counted."""
    s = Tables(spark, sf).conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))), lambda x: x["t"]).alias("a"))
    kept = F.size(F.slice(F.filter("a", lambda x: (x != "") & (F.length(x) <= 200)), 1, 3))
    return s.select("conv_id", kept.alias("kept"), (F.size("a") - kept).alias("dropped"))


@query("e10_rejected_founder", "WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_tax > 0.04) AS correctable, bool_or(l_returnflag IN ('A', 'R') AND l_linestatus = 'F') AS based FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey FROM f WHERE correctable AND NOT based")
def e10(spark, sf):
    """A correctable rejected claim cites a founding block, and nothing else founds the decision."""
    flag = F.col("l_returnflag")
    f = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.bool_or((flag == "R") & (F.col("l_tax") > 0.04)).alias("correctable"), F.bool_or(flag.isin("A", "R") & (F.col("l_linestatus") == "F")).alias("based"))
    return f.filter("correctable and not based").select("l_orderkey")


@query("e19_blocks_of_node", f"WITH {NODES}, {BLOCKS}, own AS (SELECT node_id, block_id, 0 AS part FROM blocks WHERE node_id NOT LIKE 'c%' AND kind <> 'paragraph'), leaf AS (SELECT n.parent_id AS node_id, min(b.block_id) AS block_id, 1 AS part FROM nodes n JOIN blocks b ON b.node_id = n.node_id WHERE n.level = 3 GROUP BY n.node_id, n.parent_id HAVING count(*) = 1 AND max(b.kind) <> 'paragraph') SELECT node_id, block_id, part FROM own UNION ALL SELECT node_id, block_id, part FROM leaf")
def e19(spark, sf):
    """A node's own citable blocks, then those of its children that hold one block only."""
    t = Tables(spark, sf)
    b = blocks(t)
    own = b.filter(~F.col("node_id").startswith("c") & (F.col("kind") != "paragraph")).select("node_id", "block_id", F.lit(0).alias("part"))
    single = b.groupBy("node_id").agg(F.count("*").alias("n"), F.min("block_id").alias("block_id"), F.max("kind").alias("kind")).filter("n = 1 and kind <> 'paragraph'")
    leaf = single.join(nodes(t).filter("level = 3").select("node_id", "parent_id"), "node_id").select(F.col("parent_id").alias("node_id"), "block_id", F.lit(1).alias("part"))
    return own.unionByName(leaf)


@query("e28_without_circular_labels", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS labels FROM part WHERE NOT (contains(p_name, 'ring') AND p_size < 20) GROUP BY p_brand")
def e28(spark, sf):
    """Labels without those that only name the coverage itself."""
    kept = Tables(spark, sf).part.filter(~(F.contains("p_name", F.lit("ring")) & (F.col("p_size") < 20)))
    return kept.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("labels"))


@query("e29_qualities_to_confirm", "WITH a AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS quality FROM part WHERE p_size > 40), asked AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS quality FROM part WHERE p_size < 4) SELECT p_brand, quality FROM a EXCEPT SELECT p_brand, quality FROM asked")
def e29(spark, sf):
    """Qualities that were said to hold and that haven't been asked about yet."""
    part = Tables(spark, sf).part.select("p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("quality"), "p_size")
    return part.filter("p_size > 40").select("p_brand", "quality").subtract(part.filter("p_size < 4").select("p_brand", "quality"))
