"""Pages of boxes: gutters, columns, reading order, baselines, running bands, outlines.

A part is a page and its line items are boxes: one to four columns by supplier, indents by line number, a few boxes
across all columns, some pages of labels with amounts, runs of text that keep to a column or don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import calls, layout, pagetext
from docloom.plans.base import BLOCKS, LINES, NODES, Tables, block_id, blocks, line_words, lines, nodes, norm_sql, query, words_sql


def boxes(t: Tables) -> DataFrame:
    """page, box, x0, y0, x1, y1, src, is_line, text, bullet."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    dealt = layout.dealt(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag"), "l_partkey", t.lineitem.count())
    li = dealt.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), "l_returnflag", F.row_number().over(order).alias("box"))
    page, number = F.col("l_partkey"), F.col("l_linenumber")
    amounts = page % 11 == 0
    cols = F.when(amounts, 2).otherwise(1 + page % 4)
    li = li.withColumn("cols", cols).withColumn("k", F.floor(F.col("l_suppkey") / 4) % cols)
    full = (F.col("q") >= 49) & ~amounts
    left = F.when(full, 40).when(amounts & (F.col("k") == 1), 300).otherwise(40 + 150 * F.col("k") + 4 * (number % 3))
    wide = F.when(full, 150 * F.col("cols") - 20).when(amounts & (F.col("k") == 1), 25).otherwise(100 + F.col("q") % 25)
    top = 12 * (F.col("l_orderkey") % 30) + F.when(amounts, 0).otherwise(number % 2)
    src = F.when(page % 5 == 0, None).when(page % 7 == 0, F.floor(top / 120)).otherwise(10 * F.col("k") + F.floor(top / 120))
    number_text = F.when((F.col("q") % 4 == 0) & (F.col("k") == 0), F.concat((F.col("q") % 9).cast("string"), F.lit("."), number.cast("string"))).otherwise(F.concat(F.lit("line "), F.col("q").cast("string")))
    as_double = lambda c: c.cast("double")
    return li.select(
        page.alias("page"), "box", as_double(left).alias("x0"), as_double(top).alias("y0"), as_double(left + wide).alias("x1"), as_double(top + 10).alias("y1"),
        src.cast("long").alias("src"), (number != 7).alias("is_line"), number_text.alias("text"), (F.col("l_returnflag") == "R").alias("bullet"),
    )


BOXES = """li AS (
  SELECT l_partkey AS page, l_orderkey, l_linenumber AS nr, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag, l_partkey % 11 = 0 AS amounts, CASE WHEN l_partkey % 11 = 0 THEN 2 ELSE 1 + l_partkey % 4 END AS cols,
    CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag) AS INT) AS box FROM lineitem),
lk AS (SELECT *, (l_suppkey // 4) % cols AS k, 12 * (l_orderkey % 30) + CASE WHEN amounts THEN 0 ELSE nr % 2 END AS top, q >= 49 AND NOT amounts AS wide FROM li),
lx AS (SELECT *, CASE WHEN wide THEN 40 WHEN amounts AND k = 1 THEN 300 ELSE 40 + 150 * k + 4 * (nr % 3) END AS x, CASE WHEN wide THEN 150 * cols - 20 WHEN amounts AND k = 1 THEN 25 ELSE 100 + q % 25 END AS w FROM lk),
boxes AS MATERIALIZED (
  SELECT page, box, CAST(x AS DOUBLE) AS x0, CAST(top AS DOUBLE) AS y0, CAST(x + w AS DOUBLE) AS x1, CAST(top + 10 AS DOUBLE) AS y1,
    CASE WHEN page % 5 = 0 THEN NULL WHEN page % 7 = 0 THEN top // 120 ELSE 10 * k + top // 120 END AS src, nr <> 7 AS is_line,
    CASE WHEN q % 4 = 0 AND k = 0 THEN (q % 9) || '.' || nr ELSE 'line ' || q END AS text, l_returnflag = 'R' AS bullet FROM lx),
d0 AS (SELECT *, '' AS region, max(y1) OVER (PARTITION BY page) - min(y0) OVER (PARTITION BY page) AS height FROM boxes)"""


def gutters_sql(regions: str, name: str) -> str:
    """The best gutter of every region by comparing every candidate with every box of it."""
    left, right, both = "is_line AND x1 <= c", "is_line AND x0 >= c", "ll > 0 AND lr > 0"
    return f"""
{name}c AS (SELECT DISTINCT page, region, x0 AS c FROM {regions}),
{name}s AS (
  SELECT page, region, c, any_value(height) AS height, count(*) AS n, count(*) FILTER (x1 <= c) AS l, count(*) FILTER (x0 >= c) AS r, count(*) FILTER (x0 < c AND c < x1) AS crossing,
    min(x0) FILTER (x0 >= c) - max(x1) FILTER (x1 <= c) AS gutter, max(y1) FILTER (x1 <= c) - min(y0) FILTER (x1 <= c) AS tl, max(y1) FILTER (x0 >= c) - min(y0) FILTER (x0 >= c) AS tr,
    count(*) FILTER ({left}) AS ll, count(*) FILTER ({right}) AS lr, min(x0) FILTER (is_line) AS ml, max(x1) FILTER (is_line) AS mr,
    min(x0) FILTER ({left}) AS lx0, max(x1) FILTER ({left}) AS lx1, min(x0) FILTER ({right}) AS rx0, max(x1) FILTER ({right}) AS rx1,
    coalesce(list(DISTINCT src) FILTER ({left} AND src IS NOT NULL), []) AS sl, coalesce(list(DISTINCT src) FILTER ({right} AND src IS NOT NULL), []) AS sr,
    coalesce(list(DISTINCT src) FILTER (is_line AND x0 < c AND c < x1 AND src IS NOT NULL), []) AS sx
  FROM {name}c JOIN {regions} USING (page, region) GROUP BY page, region, c),
{name}q AS (SELECT a.page, a.region, a.box, a.x0 AS ax0, a.x1 AS ax1, b.x0 AS bx0, b.x1 AS bx1 FROM {regions} a JOIN {regions} b ON a.page = b.page AND a.region = b.region AND abs(a.y0 - b.y0) <= 3 WHERE a.is_line AND b.is_line),
{name}p AS (SELECT page, region, c, count(DISTINCT box) FILTER (ax1 <= c AND bx0 >= c) AS pl, count(DISTINCT box) FILTER (ax0 >= c AND bx1 <= c) AS pr FROM {name}c JOIN {name}q USING (page, region) GROUP BY page, region, c),
{name}j AS (
  SELECT s.*, CASE WHEN {both} THEN least(pl / ll, pr / lr) ELSE 0 END AS pairing,
    CASE WHEN {both} THEN least(CASE WHEN rx0 - ml > 0 THEN (lx1 - lx0) / (rx0 - ml) ELSE 1 END, CASE WHEN mr - lx1 > 0 THEN (rx1 - rx0) / (mr - lx1) ELSE 1 END) END AS fill
  FROM {name}s s LEFT JOIN {name}p USING (page, region, c)),
{name} AS MATERIALIZED (
  SELECT page, region, c AS boundary, crossing, gutter FROM {name}j
  WHERE n >= 8 AND l >= 4 AND r >= 4 AND least(tl, tr) >= 0.35 * height
    AND NOT (list_has_any(sl, sr) AND {both} AND (pairing <= 0.5 OR fill < 0.6))
    AND (gutter >= 18 OR (len(sl) > 0 AND len(sr) > 0 AND NOT list_has_any(sl, sr) AND NOT list_has_any(sx, list_concat(sl, sr)) AND {both} AND rx0 - lx0 >= 18 AND fill >= 0.6))
    AND NOT ({both} AND pairing > 0.5 AND fill < 0.6)
  QUALIFY row_number() OVER (PARTITION BY page, region ORDER BY crossing, gutter DESC, c) = 1)"""


def boundaries_sql(rounds: int = 5) -> str:
    """All gutters by `rounds` rounds of splitting, one more than any page of the casting needs."""
    parts = [BOXES]
    for k in range(rounds):
        parts.append(gutters_sql(f"d{k}", f"g{k}"))
        if k < rounds - 1:
            parts.append(f"d{k + 1} AS MATERIALIZED (SELECT d.* REPLACE (region || side AS region) FROM (SELECT d.*, unnest(list_filter([CASE WHEN x1 <= boundary THEN 'L' END, CASE WHEN x0 >= boundary THEN 'R' END], lambda x: x IS NOT NULL)) AS side FROM d{k} d JOIN g{k} g USING (page, region)) d)".replace("SELECT d.* REPLACE (region || side AS region) FROM", "SELECT page, box, x0, y0, x1, y1, src, is_line, text, bullet, region || side AS region, height FROM"))
    every = " UNION ALL ".join(f"SELECT page, boundary FROM g{k}" for k in range(rounds))
    return ",\n".join(parts) + f",\nfound AS MATERIALIZED ({every}), gutters AS (SELECT page, list(boundary ORDER BY boundary) AS gutters FROM found GROUP BY page)"


@query("g2_g3_best_gutter", f"WITH {BOXES}, {gutters_sql('d0', 'best')} SELECT page, boundary, CAST(crossing AS BIGINT) AS crossing, gutter FROM best")
def g2(spark, sf):
    """The best gutter of every page: fewest boxes crossed, then the most white, then the leftmost."""
    return layout.best_gutters(layout.whole_pages(boxes(Tables(spark, sf)))).drop("region")


@query("g4_column_boundaries", f"WITH {boundaries_sql()} SELECT page, boundary FROM found")
def g4(spark, sf):
    """All gutters of all pages, by splitting every open region of every page at once."""
    return layout.boundaries(boxes(Tables(spark, sf)))


@query(
    "g5_reading_order",
    f"""WITH {boundaries_sql()},
    b AS (SELECT boxes.*, coalesce(gutters, []) AS gutters FROM boxes LEFT JOIN gutters USING (page)),
    k AS (SELECT *, CASE WHEN len(gutters) > 0 AND len(list_filter(gutters, lambda g: x0 < g AND g < x1)) = len(gutters) THEN 0 ELSE 1 + len(list_filter(gutters, lambda g: x0 >= g)) END AS col FROM b),
    o AS (SELECT *, CASE WHEN col = 0 AND NOT coalesce(lag(col = 0) OVER (PARTITION BY page ORDER BY y0, x0, box), true) THEN 1 ELSE 0 END AS opens FROM k),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY y0, x0, box ROWS UNBOUNDED PRECEDING) AS band FROM o)
    SELECT page, box, CAST(col AS INT) AS column, CAST(band AS INT) AS band, CAST(CASE WHEN len(gutters) = 0 THEN row_number() OVER (PARTITION BY page ORDER BY box) ELSE row_number() OVER (PARTITION BY page ORDER BY band, col, y0, x0, box) END AS INT) AS place FROM s""",
)
def g5(spark, sf):
    """Boxes by band, column, height and left edge; what crosses all gutters opens a band."""
    b = boxes(Tables(spark, sf))
    return layout.reading_order(b, layout.boundaries(b))


@query(
    "g6_baseline_pairing",
    f"""WITH {BOXES}, s AS (SELECT page, box, y0, CASE WHEN x1 <= 190 THEN 'L' WHEN x0 >= 190 THEN 'R' END AS side FROM boxes WHERE is_line AND (x1 <= 190 OR x0 >= 190)),
    p AS (SELECT a.page, a.side, a.box, bool_or(abs(a.y0 - b.y0) <= 3) AS paired FROM s a LEFT JOIN s b ON a.page = b.page AND a.side <> b.side GROUP BY ALL),
    n AS (SELECT page, count(*) FILTER (side = 'L') AS l, count(*) FILTER (side = 'R') AS r, count(*) FILTER (side = 'L' AND paired) AS pl, count(*) FILTER (side = 'R' AND paired) AS pr FROM p GROUP BY page)
    SELECT page, CAST(l AS BIGINT) AS lines_left, CAST(r AS BIGINT) AS lines_right, CASE WHEN l > 0 AND r > 0 THEN least(pl / l, pr / r) ELSE 0 END AS pairing FROM n""",
)
def g6(spark, sf):
    """The mutual share of lines with a partner on their baseline on the other side of the second column's edge."""
    side = F.when(F.col("x1") <= 190, "L").when(F.col("x0") >= 190, "R")
    return layout.baseline_pairing(boxes(Tables(spark, sf)).filter("is_line").select("page", side.alias("side"), "y0").filter("side is not null"))


@query(
    "g11_number_lines",
    f"""WITH RECURSIVE {boundaries_sql()},
    b AS (SELECT boxes.*, coalesce(gutters, []) AS gutters, row_number() OVER (PARTITION BY page ORDER BY y0, x0, box) AS i FROM boxes LEFT JOIN gutters USING (page) WHERE is_line),
    m AS (SELECT b.*, n.text AS ntext, n.x0 AS nx0, n.y0 AS ny0, n.x1 AS nx1, n.y1 AS ny1, regexp_matches(b.text, '^[0-9]+([.][0-9]+)*$') AND b.x0 < 70 AND n.page IS NOT NULL AND NOT n.bullet AND abs(n.y0 - b.y0) <= 3 AND n.x0 >= b.x1 - 80 AND len(list_filter(b.gutters, lambda g: b.x1 - 79 <= g AND g <= n.x0)) = 0 AS joins
      FROM b LEFT JOIN b n ON n.page = b.page AND n.i = b.i + 1),
    w(page, i, takes) AS (SELECT page, i, coalesce(joins, false) FROM m WHERE i = 1 UNION ALL SELECT m.page, m.i, coalesce(m.joins, false) AND NOT w.takes FROM w JOIN m ON m.page = w.page AND m.i = w.i + 1)
    SELECT m.page, CAST(m.i AS INT) AS box, CAST(1 + CAST(w.takes AS INT) AS INT) AS parts, CASE WHEN w.takes THEN m.text || ' ' || ntext ELSE m.text END AS text,
      CASE WHEN w.takes THEN least(m.x0, nx0) ELSE m.x0 END AS x0, CASE WHEN w.takes THEN least(m.y0, ny0) ELSE m.y0 END AS y0, CASE WHEN w.takes THEN greatest(m.x1 - 79, nx1 - 79) ELSE m.x1 - 79 END AS x1, CASE WHEN w.takes THEN greatest(m.y1, ny1) ELSE m.y1 END AS y1
    FROM m JOIN w ON w.page = m.page AND w.i = m.i LEFT JOIN w v ON v.page = m.page AND v.i = m.i - 1 WHERE NOT coalesce(v.takes, false)""",
)
def g11(spark, sf):
    """Numbers that stand alone joined to the next line of their baseline, never across a gutter; lines from the top, 79 narrower."""
    b = boxes(Tables(spark, sf))
    from_top = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "box"))
    rows = b.filter("is_line").withColumn("box", from_top).withColumn("x1", F.col("x1") - 79)
    return layout.merged_numbers(rows, layout.boundaries(b))


def page_lines(t: Tables) -> DataFrame:
    """book, page, line, y0, y1, height, text, size, turned: documents as pages of their source, with a chapter and small capitals at
    the top, a number at the foot and a turned title at the side."""
    d = t.documents.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "lang", "text")
    body = d.select("book", "page", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("y0", 30 + 12 * F.col("line")).withColumn("size", F.lit(11)).withColumn("turned", F.length("text") % 9 == 0)

    def extra(line: int, y0: int, text: Column, size: int, turned: bool) -> DataFrame:
        return d.select("book", "page", F.lit(line).alias("line"), text.alias("text"), F.lit(y0).alias("y0"), F.lit(size).alias("size"), F.lit(turned).alias("turned"))

    rows = body.unionByName(extra(-1, 12, F.concat(F.lit("chapter "), (F.col("page") % 3).cast("string")), 12, False))
    rows = rows.unionByName(extra(-2, 20, F.upper("lang"), 8, False)).unionByName(extra(-3, 780, (F.col("page") % 1500).cast("string"), 11, False))
    rows = rows.unionByName(extra(-4, 400, F.concat("lang", F.lit(" terms "), F.col("page").cast("string"), F.lit(" | 48")), 11, True))
    return rows.withColumn("y1", F.col("y0") + 10).withColumn("height", F.lit(800))


PAGE_LINES = """page_lines AS (
  SELECT book, page, CAST(line AS INT) AS line, text, y0, y0 + 10 AS y1, 800 AS height, size, turned FROM (
    SELECT source AS book, doc_id AS page, line, text, 30 + 12 * line AS y0, 11 AS size, length(text) % 9 = 0 AS turned FROM (SELECT source, doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents)
    UNION ALL SELECT source, doc_id, -1, 'chapter ' || doc_id % 3, 12, 12, false FROM documents UNION ALL SELECT source, doc_id, -2, upper(lang), 20, 8, false FROM documents
    UNION ALL SELECT source, doc_id, -3, CAST(doc_id % 1500 AS VARCHAR), 780, 11, false FROM documents UNION ALL SELECT source, doc_id, -4, lang || ' terms ' || doc_id || ' | 48', 400, 11, true FROM documents))"""


@query(
    "g9_running_lines",
    f"""WITH {PAGE_LINES},
    n AS (SELECT book, greatest(2, CAST(ceil(count(DISTINCT page) * 0.3) AS BIGINT)) AS least FROM page_lines GROUP BY book),
    b AS (SELECT *, y0 < 40 OR y1 > height - 40 AS in_band, regexp_replace(text, '[0-9]+', '#', 'g') AS template FROM page_lines),
    s AS (SELECT book, text, count(*) AS seen FROM b WHERE in_band GROUP BY book, text),
    t AS (SELECT book, template, count(DISTINCT page) AS pages FROM b WHERE turned GROUP BY book, template),
    m AS (SELECT b.*, s.seen, t.pages, CASE WHEN in_band AND (s.seen >= least OR regexp_matches(b.text, '^[0-9]{{1,3}}$') OR (size <= 10 AND b.text = upper(b.text))) THEN 'running_band' WHEN turned AND t.pages >= least THEN 'turned_title' END AS motive, least
      FROM b JOIN n ON n.book = b.book LEFT JOIN s ON s.book = b.book AND s.text = b.text LEFT JOIN t ON t.book = b.book AND t.template = b.template)
    SELECT book, page, line, motive, CAST(CASE WHEN motive = 'turned_title' THEN pages WHEN seen >= least THEN seen ELSE 1 END AS BIGINT) AS seen FROM m WHERE motive IS NOT NULL""",
)
def g9(spark, sf):
    """What a source's pages repeat in their bands, page numbers, small capitals and turned titles, each with its motive."""
    return pagetext.running_lines(page_lines(Tables(spark, sf)))


@query(
    "g8_conserved_lines",
    f"""WITH {PAGE_LINES}, s AS (SELECT page || ':' || line AS uid, page, line, length(text) AS n FROM page_lines),
    c AS (SELECT uid, page || '/' || line // 4 AS block FROM s WHERE n % 13 <> 0 UNION ALL SELECT uid, page || '/x' FROM s WHERE n % 17 = 0 UNION ALL SELECT page || ':' || (line + 100000), page || '/y' FROM s WHERE n % 29 = 0),
    r AS (SELECT uid, CASE WHEN n % 19 = 0 THEN 'turned' ELSE 'band' END AS motive FROM s WHERE n % 26 = 0 OR n % 19 = 0),
    a AS (SELECT uid, count(*) AS n FROM c GROUP BY uid), m AS (SELECT s.uid AS known, coalesce(s.uid, a.uid) AS uid, coalesce(a.n, 0) AS n, r.motive FROM s FULL JOIN a ON a.uid = s.uid LEFT JOIN r ON r.uid = s.uid)
    SELECT * FROM (SELECT uid, CASE WHEN known IS NULL THEN 'unknown' WHEN n > 1 THEN 'several' WHEN n = 1 AND motive IS NOT NULL THEN 'both' WHEN n = 0 AND motive IS NULL THEN 'lost' END AS problem, CAST(n AS BIGINT) AS n_blocks, motive FROM m) WHERE problem IS NOT NULL""",
)
def g8(spark, sf):
    """Every line of a page in one block or one removal: what is lost, carried twice, carried and removed, or unknown."""
    s = page_lines(Tables(spark, sf)).select("page", "line", F.concat("page", F.lit(":"), "line").alias("uid"), F.length("text").alias("n"))
    in_fours = s.filter("n % 13 <> 0").select("uid", F.concat("page", F.lit("/"), F.expr("line div 4")).alias("block"))
    twice = s.filter("n % 17 = 0").select("uid", F.concat("page", F.lit("/x")).alias("block"))
    unknown = s.filter("n % 29 = 0").select(F.concat("page", F.lit(":"), F.col("line") + 100_000).alias("uid"), F.concat("page", F.lit("/y")).alias("block"))
    removed = s.filter("n % 26 = 0 or n % 19 = 0").select("uid", F.when(F.col("n") % 19 == 0, "turned").otherwise("band").alias("motive"))
    return pagetext.conservation(s, in_fours.unionByName(twice).unionByName(unknown), removed)[0]


@query(
    "g10_contents_pages",
    """WITH RECURSIVE p AS (SELECT source AS book, doc_id AS page, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, length(text) % 3 > 0 AND doc_id > 60 AS entries, length(text) % 5 = 0 AS other, length(text) % 11 = 0 AS article FROM documents WHERE text IS NOT NULL),
    w(book, i, state, page, is_contents) AS (
      SELECT DISTINCT book, CAST(0 AS BIGINT), 0, CAST(NULL AS BIGINT), false FROM p
      UNION ALL SELECT p.book, p.i, CASE WHEN state = 2 THEN 2 WHEN state = 0 AND NOT entries THEN 0 WHEN state = 1 AND (NOT entries OR other) THEN 2 WHEN article THEN 2 ELSE 1 END, p.page, CASE WHEN state = 0 THEN entries WHEN state = 1 THEN entries AND NOT other ELSE false END
      FROM w JOIN p ON p.book = w.book AND p.i = w.i + 1)
    SELECT book, page, is_contents, state = 2 AND NOT is_contents AS after FROM w WHERE i > 0""",
)
def g10(spark, sf):
    """A source's documents as pages: where contents begin, go on and end, never to begin again."""
    n = F.length("text")
    pages = Tables(spark, sf).documents.filter("text is not null").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), ((n % 3 > 0) & (F.col("doc_id") > 60)).alias("entries"), (n % 5 == 0).alias("other"), (n % 11 == 0).alias("article"))
    return pagetext.contents_pages(pages)


@query(
    "s11_numbered_outline",
    """WITH h AS (SELECT l_suppkey AS book, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS ord, 1 + l_partkey % 5 AS level FROM lineitem),
    p AS (SELECT a.book, a.ord, a.level, max(b.ord) AS parent FROM h a LEFT JOIN h b ON b.book = a.book AND b.ord < a.ord AND b.level < a.level GROUP BY ALL),
    d AS (WITH RECURSIVE u(book, ord, top, depth) AS (SELECT book, ord, parent, 0 FROM p UNION ALL SELECT u.book, u.ord, p.parent, depth + 1 FROM u JOIN p ON p.book = u.book AND p.ord = u.top) SELECT book, ord, max(depth) AS depth FROM u GROUP BY ALL)
    SELECT p.book, p.ord, CAST(level AS INT) AS level, parent, CAST(depth AS INT) AS depth FROM p JOIN d ON d.book = p.book AND d.ord = p.ord""",
)
def s11(spark, sf):
    """A supplier is a book, its items numbered headings (`3.1.4 A`): each under the nearest earlier one with a shorter number."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    parts = F.slice(F.array(F.col("l_linenumber").cast("long"), "l_partkey", "l_suppkey", "l_orderkey", F.col("l_quantity").cast("long")), F.lit(1), (1 + F.col("l_partkey") % 5).cast("int"))
    text = F.concat(F.array_join(parts.cast("array<string>"), "."), F.lit(" "), "l_returnflag")
    lines = Tables(spark, sf).lineitem.select(F.col("l_suppkey").alias("book"), (F.row_number().over(order) - 1).cast("long").alias("ord"), text.alias("text"))
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", 1)
    return pagetext.outline(lines.select("book", "ord", F.size(F.split(number, r"\.")).alias("level")), chunk=250)


_CONTENTS = """toc AS (
  SELECT page, box, CASE WHEN q % 5 = 1 THEN 600.0 ELSE x0 END AS x0, y0, CASE WHEN q % 5 = 1 THEN 612.0 ELSE x1 END AS x1, y1,
    CASE WHEN q % 5 = 0 AND q % 3 = 0 THEN q || '.' || box || ' cover ' || q || ' ..... ' || (q + 10) WHEN q % 5 = 0 THEN q || '.' || box || '. title ' || l_returnflag || '.' WHEN q % 5 = 1 THEN CAST(q AS VARCHAR) ELSE 'goes on ' || l_returnflag || box || '.' END AS text
  FROM (SELECT page, box, CAST(x AS DOUBLE) AS x0, CAST(top AS DOUBLE) AS y0, CAST(x + w AS DOUBLE) AS x1, CAST(top + 10 AS DOUBLE) AS y1, q, l_returnflag FROM lx))"""


def contents_lines(t: Tables) -> DataFrame:
    """page, box, x0, y0, x1, y1, text: the boxes as lines of printed contents, page numbers at the right edge."""
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    more = t.lineitem.select(F.col("l_partkey").alias("page"), F.row_number().over(order).alias("box"), F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    b = boxes(t).drop("text").join(more, ["page", "box"])
    q, flag, box = F.col("q").cast("string"), F.col("l_returnflag"), F.col("box").cast("string")
    number = F.col("q") % 5 == 1
    cover = F.concat(q, F.lit("."), box, F.lit(" cover "), q, F.lit(" ..... "), (F.col("q") + 10).cast("string"))
    text = F.when((F.col("q") % 5 == 0) & (F.col("q") % 3 == 0), cover).when(F.col("q") % 5 == 0, F.concat(q, F.lit("."), box, F.lit(". title "), flag, F.lit("."))).when(number, q).otherwise(F.concat(F.lit("goes on "), flag, box, F.lit(".")))
    return b.select("page", "box", F.when(number, 600.0).otherwise(F.col("x0")).alias("x0"), "y0", F.when(number, 612.0).otherwise(F.col("x1")).alias("x1"), "y1", text.alias("text"))


@query(
    "e32_printed_entries",
    f"""WITH {BOXES}, {_CONTENTS},
    k AS (SELECT *, regexp_matches(text, '^[0-9.]+ cover') AS printed, regexp_matches(text, '^[0-9]+[.][0-9]+[.] ') AS start, regexp_matches(text, '^[0-9]+$') AS number FROM toc),
    s AS (SELECT s.*, (SELECT min(n.x0) FROM k n WHERE n.page = s.page AND n.number AND n.x0 > s.x0 AND abs(n.y0 - s.y0) <= 8) AS edge, coalesce((SELECT min(o.y0) FROM k o WHERE o.page = s.page AND o.start AND o.y0 > s.y0 AND abs(o.x0 - s.x0) <= 80), 800) AS until FROM k s WHERE s.start),
    c AS (SELECT s.page, s.box, s.y1 AS sy1, c.box AS cbox, c.y0, c.x0, c.y1, c.text FROM s JOIN k c ON c.page = s.page AND c.y0 > s.y0 AND c.y0 < s.until AND c.x0 >= s.x0 - 5 AND c.x1 < s.edge AND NOT c.printed AND NOT c.start AND NOT c.number WHERE s.edge IS NOT NULL),
    g AS (SELECT *, y0 - coalesce(lag(y1) OVER w, sy1) <= 1.5 * (y1 - y0) AS near FROM c WINDOW w AS (PARTITION BY page, box ORDER BY y0, x0, cbox)),
    h AS (SELECT *, bool_and(near) OVER (PARTITION BY page, box ORDER BY y0, x0, cbox ROWS UNBOUNDED PRECEDING) AS kept FROM g),
    m AS (SELECT page, box, string_agg(rtrim(text, '.'), ' ' ORDER BY y0, x0, cbox) AS more, count(*) AS n FROM h WHERE kept GROUP BY page, box)
    SELECT page, box, regexp_extract(text, '^[0-9]+[.][0-9]+') AS number, regexp_extract(text, '(cover [0-9]+)') AS title, CAST(1 AS INT) AS parts FROM k WHERE printed
    UNION ALL SELECT s.page, s.box, regexp_extract(s.text, '^[0-9]+[.][0-9]+'), regexp_extract(s.text, '(title [A-Z])') || coalesce(' ' || more, ''), CAST(1 + coalesce(m.n, 0) AS INT) FROM s LEFT JOIN m ON m.page = s.page AND m.box = s.box WHERE s.edge IS NOT NULL""",
)
def e32(spark, sf):
    """Entries of printed contents; titles go on below their start, in its column and left of the page number."""
    return pagetext.printed_entries(contents_lines(Tables(spark, sf)), 800.0)


@query(
    "s10_grid_cells",
    f"""WITH {BOXES}, x AS (SELECT page, x0, sum(fresh) OVER (PARTITION BY page ORDER BY x0) AS col FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) <= 3 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT page, x0 FROM boxes))),
    y AS (SELECT page, y0, sum(fresh) OVER (PARTITION BY page ORDER BY y0) AS nr FROM (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0) <= 3 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT page, y0 FROM boxes)))
    SELECT page, CAST(nr AS INT) AS row, CAST(col AS INT) AS column, string_agg(text, chr(10) ORDER BY y0, x0, box) AS text FROM boxes JOIN x USING (page, x0) JOIN y USING (page, y0) GROUP BY page, nr, col""",
)
def s10(spark, sf):
    """The boxes of a page in the cells of the grid of their aligned edges."""
    return pagetext.grid_cells(boxes(Tables(spark, sf)))


_CALLS = f"""asked AS (SELECT item_id, list_filter({words_sql(norm_sql('text'))}, lambda x: length(x) > 6)[1] AS word, {words_sql(norm_sql('text'))}[1] AS head FROM benchmark),
calls AS (SELECT event_id AS call, CASE event_type WHEN 'view' THEN 'contents' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'search' WHEN 'signup' THEN 'definitions' ELSE event_type END AS tool,
  CASE WHEN event_type = 'view' THEN 'n' || user_id % 30 WHEN event_type = 'click' THEN 'c' || event_id WHEN event_type = 'purchase' THEN word ELSE head END AS arg FROM events LEFT JOIN asked ON item_id = event_id % 50)"""


@query(
    "u1_u5_tool_calls",
    f"""WITH {NODES}, {BLOCKS}, {LINES}, {_CALLS},
    w AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || ':' || lpad(CAST(seq AS VARCHAR), 5, '0') AS line, list_distinct({words_sql(norm_sql('line'))}) AS words, {words_sql(norm_sql('line'))}[1] AS head FROM lines),
    a AS (
      SELECT call, tool, CASE WHEN node_id IS NULL THEN 'unknown node' END AS error, (SELECT count(*) FROM nodes k WHERE k.parent_id = arg) AS n, (SELECT min(node_id) FROM nodes k WHERE k.parent_id = arg) AS first FROM calls LEFT JOIN nodes ON node_id = arg WHERE tool = 'contents'
      UNION ALL SELECT call, tool, CASE WHEN nodes.node_id IS NULL THEN 'unknown node' END, coalesce(b.n, 0), b.first FROM calls LEFT JOIN nodes ON node_id = arg LEFT JOIN (SELECT node_id, count(*) AS n, CAST(arg_min(block_id, ord) AS VARCHAR) AS first FROM blocks GROUP BY node_id) b ON b.node_id = arg WHERE tool = 'open'
      UNION ALL SELECT call, tool, CASE WHEN coalesce(arg, '') = '' THEN 'empty word' END, coalesce(f.n, 0), f.first FROM calls LEFT JOIN (SELECT word, count(*) AS n, min(line) AS first FROM (SELECT line, unnest(words) AS word FROM w) GROUP BY word) f ON f.word = arg WHERE tool = 'search'
      UNION ALL SELECT call, tool, CASE WHEN coalesce(arg, '') = '' THEN 'empty word' END, coalesce(f.n, 0), f.first FROM calls LEFT JOIN (SELECT head, count(*) AS n, min(line) AS first FROM w GROUP BY head) f ON f.head = arg WHERE tool = 'definitions'
      UNION ALL SELECT call, tool, 'unknown tool', NULL, NULL FROM calls WHERE tool NOT IN ('contents', 'open', 'search', 'definitions'))
    SELECT call, tool, error IS NULL AS ok, CASE WHEN error IS NULL THEN CAST(n AS BIGINT) END AS n, CASE WHEN error IS NULL THEN first END AS first, error FROM a""",
)
def u5(spark, sf):
    """Events as calls of four tools and one that doesn't exist, on nations, customers and words of the benchmark."""
    t = Tables(spark, sf)
    w = tx.words(tx.normalize(F.col("text")))
    asked = t.benchmark.select("item_id", F.get(F.filter(w, lambda x: F.length(x) > 6), F.lit(0)).alias("word"), F.get(w, F.lit(0)).alias("head"))
    e = t.events.select("event_id", "user_id", "event_type", (F.col("event_id") % 50).alias("item_id")).join(asked, "item_id", "left")
    tool, kind = F.col("event_type"), F.col("event_type")
    for name, called in (("view", "contents"), ("click", "open"), ("purchase", "search"), ("signup", "definitions")):
        tool = F.when(kind == name, called).otherwise(tool)
    arg = F.when(kind == "view", F.concat(F.lit("n"), (F.col("user_id") % 30).cast("string"))).when(kind == "click", F.concat(F.lit("c"), F.col("event_id").cast("string"))).when(kind == "purchase", F.col("word")).otherwise(F.col("head"))
    held = line_words(t).select(block_id().alias("line"), "words")
    return calls.answered(e.select(F.col("event_id").alias("call"), tool.alias("tool"), arg.alias("arg")), nodes(t), blocks(t), held)
