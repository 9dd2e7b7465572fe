"""Shapes of what is read and written: literals, dictionaries, cases, segments, report tables, rotated logs, page areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.segments import greedy_segments, running
from docloom.plans.base import LINES, Tables, lines, query
from docloom.plans.search_q import _THESAURUS, claims
from docloom.scratch import Rounds
from docloom.sources.jsobject import parsed_object

# A base's file: an object literal with unquoted keys, a comment and trailing commas; every 29th part's is broken.
_LITERAL = "concat('// base\\nwindow.KB = {key: ', p_partkey, ', name: \"', p_name, '\", sizes: [', p_size, ', /* next */ ', p_size + 1, ',],', CASE WHEN p_partkey % 29 = 0 THEN ' bad: \\'x\\'' ELSE '' END, '};')"


@query("s1_s2_object_literals", "SELECT p_partkey, CASE WHEN p_partkey % 29 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 29 > 0 THEN CAST(p_size + p_size + 1 AS BIGINT) END AS total, p_partkey % 29 = 0 AS refused FROM part")
def s1(spark, sf):
    """Assigned object literals read as typed columns; single-quoted strings are refused with their place."""
    text = Tables(spark, sf).part.select("p_partkey", F.expr(_LITERAL).alias("text"))
    found = text.select("p_partkey", parsed_object(F.col("text")).alias("p"))
    typed = found.select("p_partkey", F.from_json("p.json", "key long, name string, sizes array<long>").alias("x"), F.col("p.error").isNotNull().alias("refused"))
    return typed.select("p_partkey", "x.name", F.aggregate("x.sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), "refused")


@query(
    "s7_shape_violations",
    "SELECT p_brand, rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_brand, unnest(list_filter([CASE WHEN p_partkey % 37 = 0 THEN 'title missing' END, CASE WHEN p_partkey % 41 = 0 THEN 'size is no number' END, CASE WHEN p_partkey % 43 = 0 THEN 'no section' END], lambda x: x IS NOT NULL)) AS rule FROM part WHERE p_partkey % 47 > 0 UNION ALL SELECT p_brand, 'no object' FROM part WHERE p_partkey % 47 = 0) GROUP BY p_brand, rule",
)
def s7(spark, sf):
    """Cards as JSON texts against the shape that ingestion needs: what breaks it, by base."""
    title = F.when(F.col("p_partkey") % 37 > 0, F.col("p_name"))
    size = F.when(F.col("p_partkey") % 41 == 0, F.lit('"large"')).otherwise(F.col("p_size").cast("string"))
    sections = F.when(F.col("p_partkey") % 43 > 0, F.lit('["a"]')).otherwise(F.lit("[]"))
    head = F.when(title.isNotNull(), F.concat(F.lit('"title": "'), title, F.lit('", '))).otherwise("")
    text = F.concat(F.lit("{"), head, F.lit('"size": '), size, F.lit(', "sections": '), sections, F.lit("}"))
    cards = Tables(spark, sf).part.select("p_brand", F.when(F.col("p_partkey") % 47 == 0, F.substring(text, 1, 9)).otherwise(text).alias("text"))
    x = F.from_json("text", "title string, size string, sections array<string>, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    shaped = cards.select("p_brand", x.alias("x"))
    rules = F.when(F.col("x.bad").isNotNull() | F.col("x").isNull(), F.array(F.lit("no object"))).otherwise(
        F.array_compact(F.array(F.when(F.coalesce("x.title", F.lit("")) == "", "title missing"), F.when(F.expr("try_cast(x.size as long)").isNull(), "size is no number"), F.when(F.size("x.sections") == 0, "no section")))
    )
    return shaped.select("p_brand", F.explode(rules).alias("rule")).groupBy("p_brand", "rule").agg(F.count("*").alias("n"))


@query("s14_dictionary_forms", f"WITH {_THESAURUS} SELECT grp, form, canonical FROM claims WHERE substr(grp, length(grp), 1) <> '3'")
def s14(spark, sf):
    """Dictionaries read from JSON, a text for each group, as a table of forms; a broken one gives no forms and no error."""
    entries = claims(Tables(spark, sf)).groupBy("grp").agg(F.to_json(F.struct(F.col("grp").alias("group"), F.array_sort(F.collect_list(F.struct("form", "canonical"))).alias("forms"))).alias("text"))
    broken = F.col("grp").endswith("3")
    texts = entries.select(F.when(broken, F.expr("left(text, length(text) - 2)")).otherwise(F.col("text")).alias("text"))
    read = texts.select(F.from_json("text", "group string, forms array<struct<form: string, canonical: boolean>>, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("d")).filter("d.bad is null and d.group is not null")
    return read.select(F.col("d.group").alias("grp"), F.explode("d.forms").alias("f")).select("grp", "f.form", "f.canonical")


@query("s17_strict_cases", "SELECT item_id, CASE WHEN item_id % 13 = 0 THEN 'unknown key' WHEN item_id % 17 = 0 THEN 'missing key' WHEN item_id % 19 = 0 THEN 'repeated key' WHEN item_id % 5 = 4 THEN 'unknown suite' ELSE 'accepted' END AS verdict, CASE WHEN item_id % 13 > 0 AND item_id % 17 > 0 AND item_id % 19 > 0 AND item_id % 5 < 4 THEN ['core', 'edge', 'slow', 'core'][item_id % 5 + 1] END AS suite FROM benchmark")
def s17(spark, sf):
    """Golden cases, a key and a value on each line: exactly the known keys, each once, and a known suite."""
    suite = F.element_at(F.array(*[F.lit(x) for x in ("core", "edge", "slow", "core", "later")]), (F.col("item_id") % 5 + 1).cast("int"))
    more = F.when(F.col("item_id") % 13 == 0, "\nnote: x").when(F.col("item_id") % 19 == 0, "\nid: 0").otherwise("")
    question = F.when((F.col("item_id") % 17 == 0) & (F.col("item_id") % 13 > 0), "").otherwise("\nquestion: why: this?")
    text = F.concat(F.lit("id: "), F.col("item_id"), F.lit("\n# a remark\nsuite: "), suite, question, more)
    pairs = F.filter(F.split(text, "\n"), lambda x: ~x.startswith("#"))
    cut = F.transform(pairs, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.expr("1").alias("one"), x.alias("line")))
    cases = Tables(spark, sf).benchmark.select("item_id", cut.alias("pairs")).withColumn("keys", F.transform("pairs", lambda x: x["k"]))
    known = F.array(*[F.lit(x) for x in ("id", "suite", "question")])
    value = F.regexp_replace(F.filter("pairs", lambda x: x["k"] == "suite")[0]["line"], "^suite: ", "")
    verdict = F.when(F.size(F.array_except("keys", known)) > 0, "unknown key").when(F.size(F.array_except(known, F.col("keys"))) > 0, "missing key").when(F.size(F.array_distinct("keys")) < F.size("keys"), "repeated key").when(~value.isin("core", "edge", "slow"), "unknown suite").otherwise("accepted")
    judged = cases.select("item_id", verdict.alias("verdict"), value.alias("suite"))
    return judged.select("item_id", "verdict", F.when(F.col("verdict") == "accepted", F.col("suite")).alias("suite"))


# Texts of a base are written in files of at most so many entries, as a base has no bound.
FILE = 40
_FILED = f"SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // {FILE} AS file FROM part"


def filed(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The rows and their `file` (from 0) within the key, `most` rows to a file in order, however large the key."""
    ranked = running(rows, [key], order, {}, Rounds(rows.sparkSession, "files"))
    return ranked.withColumn("file", F.floor((F.col("rank") - 1) / most)).drop("rank")


def _texts(rows: DataFrame, head: Column, entry: Column, between: str, end: Column) -> DataFrame:
    """p_brand, file, text: a text for each file, with its entries in the order of parts."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("entry")))), lambda x: x["entry"])
    joined = filed(rows, "p_brand", ["p_partkey"], FILE).groupBy("p_brand", "file").agg(F.array_join(entries, between).alias("body"))
    return joined.select("p_brand", "file", F.concat(head, F.col("body"), end).alias("text"))


_PROPOSAL = """'{"doc": "' || p_brand || '", "nodes": [' || string_agg('{"id": ' || p_partkey || ', "size": ' || p_size || '}', ', ' ORDER BY p_partkey) || CASE WHEN right(p_brand, 1) = '4' THEN '' ELSE ']}' END"""


@query("s18_structure_bytes", f"SELECT p_brand, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS digest, CASE WHEN right(p_brand, 1) <> '4' THEN nodes END AS nodes, CASE WHEN right(p_brand, 1) <> '4' THEN total END AS total FROM (SELECT p_brand, {_PROPOSAL} AS text, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand)")
def s18(spark, sf):
    """Structure proposals, one whole text for each base, read once: the exact bytes' length and digest beside what they say; broken ones say nothing."""
    node = F.concat(F.lit('{"id": '), F.col("p_partkey"), F.lit(', "size": '), F.col("p_size"), F.lit("}"))
    nodes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", node.alias("n")))), lambda x: x["n"]), ", ")
    end = F.when(F.col("p_brand").endswith("4"), "").otherwise("]}")
    texts = Tables(spark, sf).part.groupBy("p_brand").agg(nodes.alias("n")).select("p_brand", F.concat(F.lit('{"doc": "'), "p_brand", F.lit('", "nodes": ['), "n", end).alias("text"))
    x = F.from_json("text", "doc string, nodes array<struct<id: long, size: long>>, bad string", {"columnNameOfCorruptRecord": "bad"})
    read = texts.select("p_brand", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), x.alias("x"))
    sound = F.col("x.bad").isNull() & F.col("x.doc").isNotNull()
    total = F.aggregate("x.nodes", F.lit(0).cast("long"), lambda a, b: a + b["size"])
    return read.select("p_brand", "bytes", "digest", F.when(sound, F.size("x.nodes").cast("long")).alias("nodes"), F.when(sound, total).alias("total"))


def planned_segments(units: DataFrame, most_units: int, most_chars: int) -> DataFrame:
    """registry, unit, segment: contiguous segments, each as long as the bounds allow, that never split a unit; -1 for a unit that fits nowhere.

    units: registry, ord, unit, chars.
    """
    found = greedy_segments(units.select("registry", "ord", "unit", "chars"), "registry", ["ord"], "chars", most_units, most_chars, long_alone=False)
    return found.select("registry", "unit", "segment")


@query(
    "l15_planned_segments",
    """WITH RECURSIVE u AS (SELECT source AS registry, doc_id AS unit, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL),
    f AS (
      SELECT registry, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS unit, CAST(0 AS INT) AS current, CAST(0 AS BIGINT) AS units, CAST(0 AS BIGINT) AS chars, CAST(0 AS INT) AS segment FROM u WHERE n = 1
      UNION ALL
      SELECT registry, n, unit, CASE WHEN too_long THEN current + CAST(units > 0 AS INT) WHEN filled THEN current + 1 ELSE current END, CASE WHEN too_long THEN 0 WHEN filled THEN 1 ELSE units + 1 END, CASE WHEN too_long THEN 0 WHEN filled THEN size ELSE chars + size END, CASE WHEN too_long THEN -1 WHEN filled THEN current + 1 ELSE current END
      FROM (SELECT f.registry, u.n, u.unit, current, units, chars, size, size > 6000 AS too_long, units = 8 OR chars + size > 6000 AS filled FROM f JOIN u ON u.registry = f.registry AND u.n = f.n + 1))
    SELECT registry, unit, segment FROM f WHERE n > 0""",
)
def l15(spark, sf):
    """Documents of a source in segments of at most 8 units and 6,000 characters."""
    rows = Tables(spark, sf).documents.filter("text is not null").select(F.col("source").alias("registry"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("unit"), F.length("text").alias("chars"))
    return planned_segments(rows, 8, 6000)


@query("k8_report_tables", f"SELECT p_brand, file, '| part | type | size |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || replace(p_name || CASE WHEN p_partkey % 4 = 0 THEN '|x' ELSE '' END, '|', '\\|') || ' | ' || CASE WHEN p_size % 5 = 0 THEN '—' ELSE p_type END || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS report FROM ({_FILED}) GROUP BY p_brand, file")
def k8(spark, sf):
    """Report tables for each base, in files of 40 rows: bars in cells escaped, a dash for what is missing, rows in order."""
    name = F.replace(F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, "|x").otherwise("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), name, F.lit(" | "), F.when(F.col("p_size") % 5 == 0, "—").otherwise(F.col("p_type")), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    parts = Tables(spark, sf).part.select("p_brand", "p_partkey", "p_name", "p_type", "p_size")
    return _texts(parts, F.lit("| part | type | size |\n|---|---|---|\n"), row, "\n", F.lit("")).withColumnRenamed("text", "report")


def rotated(entries: DataFrame, most_bytes: int, files: int) -> DataFrame:
    """sink, file, lines, bytes: what a log with rotation holds, of the `files` last files of each sink.

    entries: sink, ord, bytes (at least 1). A file is closed where the next line would take it beyond `most_bytes`; a
    longer line has a file of its own.
    """
    filed = greedy_segments(entries.select("sink", "ord", "bytes"), "sink", ["ord"], "bytes", most_bytes, most_bytes)
    closed = filed.groupBy("sink", F.col("segment").alias("file")).agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))
    last = closed.groupBy(F.col("sink").alias("of")).agg(F.max("file").alias("last"))
    return closed.join(last, F.col("sink").eqNullSafe(F.col("of"))).filter(F.col("file") > F.col("last") - files).select("sink", "file", "lines", "bytes")


@query(
    "k9_rotated_log",
    f"""WITH RECURSIVE {LINES}, u AS (SELECT source AS sink, strlen(line) + 1 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id, seq) AS n FROM lines),
    f AS (
      SELECT sink, CAST(0 AS BIGINT) AS n, CAST(0 AS INT) AS file, CAST(0 AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS size FROM u WHERE n = 1
      UNION ALL SELECT f.sink, u.n, CASE WHEN bytes > 0 AND bytes + u.size > 20000 THEN file + 1 ELSE file END, CASE WHEN bytes > 0 AND bytes + u.size > 20000 THEN u.size ELSE bytes + u.size END, u.size FROM f JOIN u ON u.sink = f.sink AND u.n = f.n + 1),
    g AS (SELECT sink, file, CAST(count(*) AS BIGINT) AS lines, CAST(sum(size) AS BIGINT) AS bytes FROM f WHERE n > 0 GROUP BY sink, file)
    SELECT sink, file, lines, bytes FROM (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY file DESC) AS newest FROM g) WHERE newest <= 3""",
)
def k9(spark, sf):
    """Every line of a source logged: files of at most 20,000 bytes, the three last ones kept."""
    rows = lines(Tables(spark, sf)).withColumn("ord", F.struct("doc_id", "seq"))
    return rotated(rows.select(F.col("source").alias("sink"), "ord", (F.octet_length("line") + 1).alias("bytes")), 20_000, 3)


def union_area(rectangles: DataFrame) -> DataFrame:
    """page, area: the exact area of the union of axis-aligned rectangles (page, x0, y0, x1, y1), empty ones aside.

    Every edge in x begins a slab; the slabs of a page with n edges make about sqrt(n) strips. A sweep down each strip
    tells how much of y the rectangles that reach across it cover above every edge, and that is taken out of the y axis;
    only those that begin or end inside the strip, of which there are few, meet its slabs, where a running maximum
    merges them. A page of n rectangles makes n * sqrt(n) rows, not n * n. Rows without a page are left out.
    """
    strip = ["page", "strip"]
    sound = rectangles.filter("x1 > x0 and y1 > y0").select("page", "x0", "y0", "x1", "y1")
    edges = sound.select("page", F.explode(F.array("x0", "x1")).alias("x")).distinct()
    along = Window.partitionBy("page").orderBy("x")
    counted = edges.select("page", "x", F.lead("x").over(along).alias("next"), F.row_number().over(along).alias("n"), F.count("*").over(Window.partitionBy("page")).alias("of"))
    slabs = counted.filter("next is not null").select("page", F.floor((F.col("n") - 1) / F.ceil(F.sqrt("of"))).alias("strip"), "x", "next")
    strips = slabs.groupBy(*strip).agg(F.min("x").alias("lo"), F.max("next").alias("hi"))
    # one page's strips go to many tasks
    met = sound.join(strips, "page").filter("x0 < hi and x1 > lo").withColumn("across", F.expr("x0 <= lo and x1 >= hi")).repartition(*strip)

    down = Window.partitionBy(*strip).orderBy("y")
    ends = met.select("*", F.inline(F.array(F.struct(F.col("y0").alias("y"), F.lit(1).alias("sign")), F.struct(F.col("y1").alias("y"), F.lit(-1).alias("sign")))))
    opened = ends.withColumn("open", F.sum(F.when(F.col("across"), F.col("sign")).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.when(F.lag("open").over(down) > 0, F.col("y") - F.lag("y").over(down)).otherwise(0)
    swept = opened.withColumn("gap", gap).withColumn("covered", F.sum("gap").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    wide = swept.groupBy(*strip, "lo", "hi").agg(F.max("covered").alias("covered")).select("page", (F.col("covered") * (F.col("hi") - F.col("lo"))).alias("part"))

    left = F.col("y") - F.col("covered")
    short = swept.filter("not across").groupBy(*strip, "x0", "x1", "y0", "y1").agg(F.max(F.when(F.col("sign") > 0, left)).alias("top"), F.max(F.when(F.col("sign") < 0, left)).alias("bottom")).filter("bottom > top")
    inside = slabs.join(short.select(*strip, "x0", "x1", "top", "bottom"), strip).filter("x0 <= x and x1 >= next")
    slab = Window.partitionBy(*strip, "x").orderBy("top", "bottom")
    before = F.max("bottom").over(slab.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("bottom") - F.greatest("top", F.coalesce(before, F.col("top"))))
    parts = wide.unionByName(inside.select("page", (fresh * (F.col("next") - F.col("x"))).alias("part")))
    return parts.groupBy("page").agg(F.sum("part").alias("area"))


@query(
    "g1_union_area",
    "WITH r AS (SELECT l_orderkey AS page, l_partkey % 30 AS x0, l_partkey % 30 + l_quantity AS x1, l_suppkey % 20 AS y0, l_suppkey % 20 + 3 * l_linenumber AS y1 FROM lineitem), c AS (SELECT DISTINCT page, x, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT))) AS y FROM (SELECT page, y0, y1, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT))) AS x FROM r)) SELECT page, CAST(count(*) AS BIGINT) AS area FROM c GROUP BY page",
)
def g1(spark, sf):
    """An order is a page, its line items rectangles."""
    x, y = F.col("l_partkey") % 30, F.col("l_suppkey") % 20
    rectangles = Tables(spark, sf).lineitem.select(F.col("l_orderkey").alias("page"), x.alias("x0"), (x + F.col("l_quantity").cast("long")).alias("x1"), y.alias("y0"), (y + 3 * F.col("l_linenumber")).alias("y1"))
    return union_area(rectangles).withColumn("area", F.col("area").cast("long"))
