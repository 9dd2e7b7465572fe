"""Knowledge-base shaping and sinks: a base is a brand of `part`, its cards the parts, their rows the sizes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.plans.base import Tables, query


@query("s3_card_tree", "WITH c AS (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY p_brand, p_type) SELECT p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY first) AS INT) AS node FROM c")
def s3(spark, sf):
    """Category nodes of each base, in order of first appearance."""
    c = Tables(spark, sf).part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    return c.select("p_brand", "p_type", F.row_number().over(Window.partitionBy("p_brand").orderBy("first")).alias("node"))


@query(
    "s4_card_blocks",
    "WITH b AS (SELECT p_partkey, 0 AS part, 0 AS i, 'title' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, 0, 'summary', p_type || ' ' || p_brand FROM part UNION ALL SELECT p_partkey, 2, CAST(unnest(generate_series(0, p_size % 3)) AS INT), 'body', 'size ' || p_size FROM part) SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY part, i) AS INT) AS seq, CASE part WHEN 2 THEN field || '[' || i || ']' ELSE field END AS source_field, text FROM b",
)
def s4(spark, sf):
    """A card's blocks in fixed order, numbered densely, each with where it comes from."""
    body = F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.struct(F.concat(F.lit("body["), i.cast("string"), F.lit("]")).alias("field"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("text")))
    parts = F.concat(F.array(F.struct(F.lit("title").alias("field"), F.col("p_name").alias("text")), F.struct(F.lit("summary").alias("field"), F.concat_ws(" ", "p_type", "p_brand").alias("text"))), body)
    blocks = Tables(spark, sf).part.select("p_partkey", F.posexplode(parts).alias("i", "b"))
    return blocks.select("p_partkey", (F.col("i") + 1).alias("seq"), F.col("b.field").alias("source_field"), F.col("b.text").alias("text"))


@query("s5_table_text", "SELECT o_orderkey, string_agg(l_linenumber || ' | ' || coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, '') || ' | ' || replace(l_linestatus || '|' || CAST(l_quantity AS BIGINT), '|', '\\|'), chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) AS cells FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def s5(spark, sf):
    """A grid as text: cells by bars, rows by lines, nulls empty, bars in cells escaped."""
    t = Tables(spark, sf)
    last = F.replace(F.concat_ws("|", "l_linestatus", F.col("l_quantity").cast("long").cast("string")), F.lit("|"), F.lit("\\|"))
    cells = F.concat_ws(" | ", F.col("l_linenumber").cast("string"), F.coalesce(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.lit("")), last)
    rows = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", cells.alias("c"))))
    return rows.groupBy("o_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), "\n").alias("cells"))


@query("s6_conditions", "WITH i AS (SELECT p_partkey % 500 AS node, p_partkey AS ord, CASE WHEN p_size % 4 > 0 THEN p_type END AS si, p_type <> 'PROMO' AS known FROM part) SELECT node, arg_min(si, ord) FILTER (si IS NOT NULL AND known) AS si, CAST(count(*) FILTER (si IS NULL OR NOT known) AS BIGINT) AS ignored FROM i GROUP BY node")
def s6(spark, sf):
    """Timeline conditions: the first valid one of a node wins, the others are counted."""
    valid = F.col("si").isNotNull() & F.col("known")
    i = Tables(spark, sf).part.select((F.col("p_partkey") % 500).alias("node"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("si"), (F.col("p_type") != "PROMO").alias("known"))
    return i.groupBy("node").agg(F.min_by(F.when(valid, F.col("si")), F.when(valid, F.col("ord"))).alias("si"), F.count_if(~valid).alias("ignored"))


@query("s12_s13_served_documents", "SELECT doc_id, CASE WHEN length(text) < 20 THEN 'unreadable' WHEN source = 'src7' THEN 'bad entry' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'language' ELSE 'served' END AS state FROM documents")
def s12(spark, sf):
    """The first failing check is the reason for quarantine; the others are served."""
    reasons = F.coalesce(F.when(F.length("text") < 20, "unreadable"), F.when(F.col("source") == "src7", "bad entry"), F.when(~F.col("lang").isin("en", "fr", "de"), "language"), F.lit("served"))
    return Tables(spark, sf).documents.select("doc_id", reasons.alias("state"))


@query("s19_audit_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 3")
def s19(spark, sf):
    """Opaque JSON lines filtered to one artefact."""
    k = F.from_json("props", "k long")["k"]
    return Tables(spark, sf).events.select("event_id", k.alias("k")).filter("k % 10 = 3")


@query("k1_document_json", """SELECT p_partkey, '{"brand":"' || p_brand || '"' || CASE WHEN p_size > 10 THEN ',"size":' || p_size ELSE '' END || '}' AS json FROM part""")
def k1(spark, sf):
    """JSON without fields that have their default."""
    return Tables(spark, sf).part.select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"))).alias("json"))


@query("k4_merged_manifest", "WITH o AS (SELECT p_partkey AS id, p_type AS entry FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_partkey AS id, p_brand AS entry FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(n.id, o.id) AS id, coalesce(n.entry, o.entry) AS entry FROM o FULL JOIN n ON n.id = o.id")
def k4(spark, sf):
    """Entries of a manifest replaced by key, the others kept as they are."""
    part = Tables(spark, sf).part
    old = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("old"))
    new = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("new"))
    return old.join(new, "id", "full").select("id", F.coalesce("new", "old").alias("entry"))


@query("k6_k7_base_summary", "WITH r AS (SELECT p_brand, p_type, p_partkey, left(p_name, 8) AS name, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS pos FROM part) SELECT p_brand, p_type, string_agg(name, ', ' ORDER BY p_partkey) AS cards FROM r WHERE pos <= 5 GROUP BY p_brand, p_type")
def k6(spark, sf):
    """The first five cards of each category, shortened."""
    place = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    r = Tables(spark, sf).part.withColumn("pos", place).filter("pos <= 5")
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.substring("p_name", 1, 8).alias("n")))), lambda x: x["n"])
    return r.groupBy("p_brand", "p_type").agg(F.array_join(names, ", ").alias("cards"))
