"""Quality reports, evaluation metrics, matrices and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.plans.base import BLOCKS, LINES, Tables, blocks, lines, norm_sql, query, words_sql

N = norm_sql


@query("a1_report_counts", f"WITH {BLOCKS} SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (confirmed) AS BIGINT) AS confirmed, CAST(count(*) FILTER (block_id % 3 = 0 AND block_id + 7 NOT IN (SELECT block_id FROM blocks)) AS BIGINT) AS unresolved FROM blocks GROUP BY kind")
def a1(spark, sf):
    """Blocks by kind, how many are confirmed, and how many references lead nowhere."""
    b = blocks(Tables(spark, sf))
    known = b.select((F.col("block_id") - 7).alias("source"), F.lit(True).alias("resolved"))
    joined = b.join(known, b.block_id == known.source, "left")
    return joined.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("confirmed"), F.count_if((F.col("block_id") % 3 == 0) & F.col("resolved").isNull()).alias("unresolved"))


@query(
    "a2_numbering_checks",
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS prev FROM lineitem)
    SELECT l_orderkey, CAST(count(*) FILTER (prev > l_linenumber) AS BIGINT) AS descents, CAST(count(*) - count(DISTINCT l_linenumber) AS BIGINT) AS repeats, max(l_linenumber) - CAST(count(DISTINCT l_linenumber) AS INT) AS gaps FROM o GROUP BY l_orderkey""",
)
def a2(spark, sf):
    """Numbers that go down, repeat or leave gaps."""
    before = F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey"))
    o = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", before.alias("prev"))
    distinct = F.countDistinct("l_linenumber")
    found = o.groupBy("l_orderkey").agg(F.count_if(F.col("prev") > F.col("l_linenumber")).alias("descents"), F.count("*").alias("n"), distinct.alias("numbers"), F.max("l_linenumber").alias("top"))
    return found.select("l_orderkey", "descents", (F.col("n") - F.col("numbers")).alias("repeats"), (F.col("top") - F.col("numbers").cast("int")).alias("gaps"))


#: Words by which a page of another language than French is known.
SIGNALS = ("the", "and", "of", "der", "und", "die", "que", "los", "las")
_SIGNALS_SQL = "[" + ", ".join(f"'{w}'" for w in SIGNALS) + "]"


@query(
    "a3_page_quality",
    f"""WITH p AS (SELECT doc_id, {words_sql(N('text'))} AS w, text FROM documents),
    s AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: list_contains({_SIGNALS_SQL}, x))) AS signals, len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}\\s.,;:!?]')) AS odd, length(text) AS chars FROM p)
    SELECT doc_id, n >= 12 AND signals >= 3 AND CAST(signals AS DOUBLE) / n >= 0.08 AS foreign_page, CAST(odd AS DOUBLE) / chars > 0.1 AS gibberish FROM s WHERE chars > 0""",
)
def a3(spark, sf):
    """Pages in another language (share and number of signal words) and pages of odd signs."""
    w = tx.words(tx.normalize(F.col("text")))
    s = Tables(spark, sf).documents.filter(F.length("text") > 0).select("doc_id", F.size(w).alias("n"), F.size(F.filter(w, lambda x: x.isin(*SIGNALS))).alias("signals"), F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s.,;:!?]")).alias("odd"), F.length("text").alias("chars"))
    foreign = (F.col("n") >= 12) & (F.col("signals") >= 3) & F.coalesce(F.try_divide("signals", "n") >= 0.08, F.lit(False))
    return s.select("doc_id", foreign.alias("foreign_page"), (F.col("odd") / F.col("chars") > 0.1).alias("gibberish"))


@query("a3_repeated_edges", f"WITH {LINES}, e AS (SELECT source, doc_id, line FROM lines WHERE seq = 1), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM e GROUP BY source) SELECT e.source, line, CAST(count(DISTINCT doc_id) AS BIGINT) AS pages FROM e JOIN n ON n.source = e.source GROUP BY e.source, line, n.pages HAVING count(DISTINCT doc_id) >= greatest(2, ceil(0.02 * n.pages))")
def a3_edges(spark, sf):
    """First lines that at least a fiftieth of a source's pages share, two at the least."""
    edges = lines(Tables(spark, sf)).filter("seq = 1").select("source", "doc_id", "line")
    totals = edges.groupBy("source").agg(F.countDistinct("doc_id").alias("all"))
    shared = edges.groupBy("source", "line").agg(F.countDistinct("doc_id").alias("pages")).join(totals, "source")
    return shared.filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.lit(0.02) * F.col("all")))).select("source", "line", "pages")


@query("a4_typing_alerts", f"WITH {BLOCKS} SELECT CAST(count(*) FILTER (price < 20000) AS BIGINT) AS low_confidence, CAST(count(*) FILTER (NOT confirmed) AS BIGINT) AS unconfirmed, CAST(count(*) FILTER (kind = 'exclusion' AND price > 450000) AS BIGINT) AS unmarked_exclusions FROM blocks")
def a4(spark, sf):
    return blocks(Tables(spark, sf)).agg(F.count_if(F.col("price") < 20000).alias("low_confidence"), F.count_if(~F.col("confirmed")).alias("unconfirmed"), F.count_if((F.col("kind") == "exclusion") & (F.col("price") > 450000)).alias("unmarked_exclusions"))


_PRINTED = "printed AS (SELECT CAST(p_partkey / 2 AS BIGINT) AS number, p_name AS title FROM part WHERE p_partkey % 3 > 0), actual AS (SELECT p_partkey AS number, p_name AS title FROM part WHERE p_partkey % 5 > 0)".replace("CAST(p_partkey / 2 AS BIGINT)", "p_partkey // 2")


@query(
    "a5_printed_contents",
    f"""WITH {_PRINTED}, p AS (SELECT number, count(*) AS n, min(title) AS low, max(title) AS high FROM printed GROUP BY number)
    SELECT coalesce(p.number, a.number) AS number, CASE WHEN p.number IS NULL THEN 'missing' WHEN p.low <> p.high THEN 'conflict' WHEN p.n > 1 THEN 'duplicate' WHEN a.number IS NULL THEN 'unknown' WHEN a.title <> p.low THEN 'other title' ELSE 'sound' END AS state FROM p FULL JOIN actual a ON a.number = p.number""",
)
def a5(spark, sf):
    """Printed numbers against those found: missing, conflicting, double, unknown or otherwise titled."""
    part = Tables(spark, sf).part
    printed = part.filter("p_partkey % 3 > 0").groupBy(F.expr("p_partkey div 2").alias("number")).agg(F.count("*").alias("n"), F.min("p_name").alias("low"), F.max("p_name").alias("high"))
    actual = part.filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("title"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("low") != F.col("high"), "conflict").when(F.col("n") > 1, "duplicate").when(F.col("title").isNull(), "unknown").when(F.col("title") != F.col("low"), "other title").otherwise("sound")
    return printed.join(actual, "number", "full").select("number", state.alias("state"))


# Evaluation: a case is an order, its expected ids its line items' parts, a run one of two repetitions of it.
_RUNS = "runs AS (SELECT o_orderkey AS case_id, r AS repetition, o_orderpriority AS suite, CASE WHEN (o_orderkey + r) % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS ms, o_orderstatus || (o_orderkey * r) % 7 % 2 AS signature FROM orders, (VALUES (1), (2)) v(r))"


def _runs(t: Tables):
    runs = t.orders.withColumn("repetition", F.explode(F.array(F.lit(1), F.lit(2))))
    missing = (F.col("o_orderkey") + F.col("repetition")) % 5 == 0
    signature = F.concat("o_orderstatus", ((F.col("o_orderkey") * F.col("repetition")) % 7 % 2).cast("string"))
    return runs.select(F.col("o_orderkey").alias("case_id"), "repetition", F.col("o_orderpriority").alias("suite"), F.when(~missing, F.floor(F.col("o_totalprice") / 100)).alias("ms"), signature.alias("signature"))


@query("a6_recall", "WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT o_orderpriority AS suite, count(*) AS expected, count(*) FILTER (l_partkey % 3 > 0 AND l_orderkey % 7 > 0) AS met FROM e JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority) SELECT suite, CAST(expected AS BIGINT) AS expected, CAST(met AS BIGINT) AS met, round(CAST(met AS DOUBLE) / expected, 4) AS recall FROM s")
def a6(spark, sf):
    """Micro recall: ids found over ids expected; a missing run (order divisible by 7) stays in the denominator."""
    t = Tables(spark, sf)
    expected = t.lineitem.select("l_orderkey", "l_partkey").distinct().join(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("suite")), F.col("l_orderkey") == F.col("o_orderkey"))
    found = expected.groupBy("suite").agg(F.count("*").alias("expected"), F.count_if((F.col("l_partkey") % 3 > 0) & (F.col("l_orderkey") % 7 > 0)).alias("met"))
    return found.withColumn("recall", F.round(F.col("met") / F.col("expected"), 4))


@query("a7_judged_label", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'error' WHEN o_totalprice < 50000 THEN 'not found' WHEN o_orderpriority = '1-URGENT' THEN 'other verdict' ELSE 'correct' END AS label, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'error' END, CASE WHEN o_totalprice < 50000 THEN 'not found' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'other verdict' END], lambda x: x IS NOT NULL), ',') AS deviations FROM orders")
def a7(spark, sf):
    """One label by precedence, and every deviation."""
    rules = [(F.col("o_orderstatus") == "P", "error"), (F.col("o_totalprice") < 50000, "not found"), (F.col("o_orderpriority") == "1-URGENT", "other verdict")]
    all_of = F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))
    return Tables(spark, sf).orders.select("o_orderkey", F.coalesce(F.get(all_of, F.lit(0)), F.lit("correct")).alias("label"), F.array_join(all_of, ",").alias("deviations"))


@query("a8_a9_stability", f"WITH {_RUNS} SELECT suite, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (executed = 2 AND same) AS BIGINT) AS stable FROM (SELECT suite, case_id, count(ms) AS executed, count(DISTINCT signature) = 1 AS same FROM runs GROUP BY suite, case_id) GROUP BY suite")
def a8(spark, sf):
    """Cases with all repetitions executed and one signature, by suite."""
    per_case = _runs(Tables(spark, sf)).groupBy("suite", "case_id").agg(F.count("ms").alias("executed"), F.countDistinct("signature").alias("kinds"))
    return per_case.groupBy("suite").agg(F.count("*").alias("cases"), F.count_if((F.col("executed") == 2) & (F.col("kinds") == 1)).alias("stable"))


_FLOORS = "floors AS (SELECT DISTINCT o_orderpriority AS suite, CASE WHEN o_orderpriority < '3' THEN 0.8 ELSE 0.2 END AS floor, CASE WHEN o_orderpriority = '5-LOW' THEN 1000000 ELSE 10 END AS least FROM orders UNION ALL SELECT 'never measured', 0.5, 1)"


@query(
    "a10_floor_decisions",
    f"""WITH {_RUNS}, {_FLOORS}, m AS (SELECT suite, avg(CASE WHEN ms IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM runs GROUP BY suite)
    SELECT f.suite, CASE WHEN m.suite IS NULL THEN 'red: not emitted' WHEN n < least THEN 'red: too few' WHEN share < floor THEN 'red: below' ELSE 'green' END AS decision FROM floors f LEFT JOIN m ON m.suite = f.suite""",
)
def a10(spark, sf):
    """A metric against its floor; one that was never emitted or rests on too few runs is red."""
    t = Tables(spark, sf)
    suites = t.orders.select(F.col("o_orderpriority").alias("suite")).distinct()
    floors = suites.select("suite", F.when(F.col("suite") < "3", 0.8).otherwise(0.2).alias("floor"), F.when(F.col("suite") == "5-LOW", 1000000).otherwise(10).alias("least")).union(spark.createDataFrame([("never measured", 0.5, 1)], "suite string, floor double, least int"))
    measured = _runs(t).groupBy("suite").agg(F.avg(F.when(F.col("ms").isNotNull(), 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n"))
    decision = F.when(F.col("n").isNull(), "red: not emitted").when(F.col("n") < F.col("least"), "red: too few").when(F.col("share") < F.col("floor"), "red: below").otherwise("green")
    return floors.join(measured, "suite", "left").select("suite", decision.alias("decision"))


@query("a11_report_metrics", f"WITH {_RUNS} SELECT suite, CAST(floor(median(coalesce(ms, 0))) AS BIGINT) AS p50, quantile_disc(coalesce(ms, 0), 0.95) AS p95, max(coalesce(ms, 0)) AS top, round(sum(coalesce(ms, 0)) / CAST(count(*) AS DOUBLE), 4) AS mean FROM runs GROUP BY suite")
def a11(spark, sf):
    """Latencies over planned runs, where one that wasn't executed counts 0: middle, nearest-rank 95th, highest, mean."""
    ms = F.coalesce("ms", F.lit(0))
    runs = _runs(Tables(spark, sf)).select("suite", ms.alias("ms"))
    return runs.groupBy("suite").agg(F.expr("cast(floor(median(ms)) as bigint)").alias("p50"), F.expr("cast(percentile_disc(0.95) within group (order by ms) as bigint)").alias("p95"), F.max("ms").alias("top"), F.round(F.sum("ms") / F.count("*"), 4).alias("mean"))


_CELLS = "cells AS (SELECT p_brand AS cell, avg(p_size) AS a, avg(p_retailprice) AS b, CAST(count(*) AS DOUBLE) AS c FROM part GROUP BY p_brand)"


@query("a12_skyline", f"WITH {_CELLS} SELECT x.cell FROM cells x WHERE NOT EXISTS (SELECT 1 FROM cells y WHERE y.a > x.a AND y.b > x.b AND y.c > x.c)")
def a12(spark, sf):
    """Brands that no other beats strictly on all three axes; the aggregate has one row a brand."""
    cells = Tables(spark, sf).part.groupBy(F.col("p_brand").alias("cell")).agg(F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("b"), F.count("*").cast("double").alias("c"))
    other = cells.toDF("other", "a2", "b2", "c2")
    return cells.join(other, (F.col("a2") > F.col("a")) & (F.col("b2") > F.col("b")) & (F.col("c2") > F.col("c")), "left_anti").select("cell")


@query("a13_ranked_configurations", "WITH c AS (SELECT s_nationkey, round(avg(s_acctbal), 4) AS cost, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY s_nationkey) SELECT s_nationkey, cost, n, CAST(row_number() OVER (ORDER BY n >= 3 DESC, cost, s_nationkey) AS INT) AS rank FROM c")
def a13(spark, sf):
    """Admissible ones first, then by cost and name; one row a nation."""
    c = Tables(spark, sf).supplier.groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 4).alias("cost"), F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("n") >= 3), "cost", "s_nationkey")))


@query("a14_quality_closure", "WITH r AS (SELECT p_brand, p_type, bool_and(p_size > 1) AS ok FROM part GROUP BY p_brand, p_type) SELECT p_brand, bool_and(ok) AS closed, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS open FROM r GROUP BY p_brand")
def a14(spark, sf):
    """A row is closed where everything it depends on is."""
    r = Tables(spark, sf).part.groupBy("p_brand", "p_type").agg(F.bool_and(F.col("p_size") > 1).alias("ok"))
    return r.groupBy("p_brand").agg(F.bool_and("ok").alias("closed"), F.count_if(~F.col("ok")).alias("open"))


@query("a15_branch_universe", "WITH a AS (SELECT DISTINCT o_orderstatus FROM orders), b AS (SELECT DISTINCT o_orderpriority FROM orders), c AS (SELECT DISTINCT c_mktsegment FROM customer) SELECT o_orderstatus || '/' || o_orderpriority || '/' || c_mktsegment AS branch FROM a, b, c WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')")
def a15(spark, sf):
    """The closed product of three small sets of values, without one excluded combination."""
    t = Tables(spark, sf)
    product = t.orders.select("o_orderstatus").distinct().crossJoin(t.orders.select("o_orderpriority").distinct()).crossJoin(t.customer.select("c_mktsegment").distinct())
    return product.filter("not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')").select(F.concat_ws("/", "o_orderstatus", "o_orderpriority", "c_mktsegment").alias("branch"))


_SCORES = "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.0 END"


def _status_score():
    return F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.0)


@query("a16_weighted_mean", f"SELECT l_suppkey, round(CAST(sum(CASE WHEN s IS NOT NULL THEN s * l_quantity END) / nullif(sum(CASE WHEN s IS NOT NULL THEN l_quantity END), 0) AS DOUBLE), 8) AS score FROM (SELECT *, {_SCORES} AS s FROM lineitem) GROUP BY l_suppkey")
def a16(spark, sf):
    """The mean of status scores weighted by quantity; statuses without a score don't count."""
    rows = Tables(spark, sf).lineitem.withColumn("s", _status_score()).filter("s is not null or true")
    weight = F.sum(F.when(F.col("s").isNotNull(), F.col("l_quantity")))
    return rows.groupBy("l_suppkey").agg(F.round(F.try_divide(F.sum(F.col("s") * F.col("l_quantity")), F.nullif(weight, F.lit(0.0))), 8).alias("score"))


@query("a17_recommendation", f"WITH x AS (SELECT l_suppkey, l_linestatus, avg({_SCORES}) AS m FROM lineitem GROUP BY l_suppkey, l_linestatus) SELECT l_suppkey, CAST(floor(100 * sum(m * CASE l_linestatus WHEN 'F' THEN 3 ELSE 1 END) / sum(CASE WHEN m IS NOT NULL THEN CASE l_linestatus WHEN 'F' THEN 3 ELSE 1 END END) + 0.5) AS BIGINT) AS percent FROM x GROUP BY l_suppkey")
def a17(spark, sf):
    """The mean of each asset, then the weighted mean of the assets in per cent."""
    means = Tables(spark, sf).lineitem.groupBy("l_suppkey", "l_linestatus").agg(F.avg(_status_score()).alias("m"))
    weight = F.when(F.col("l_linestatus") == "F", 3).otherwise(1)
    share = F.sum(F.col("m") * weight) / F.sum(F.when(F.col("m").isNotNull(), weight))
    return means.groupBy("l_suppkey").agg(F.floor(100 * share + 0.5).alias("percent"))


@query("a18_matrix", "SELECT p_brand, " + ", ".join(f"CAST(count(*) FILTER (p_type = '{k}') AS BIGINT) AS {k.lower()}" for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part GROUP BY p_brand")
def a18(spark, sf):
    """Brands by types, absent ones 0."""
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    return Tables(spark, sf).part.groupBy("p_brand").pivot("p_type", kinds).count().na.fill(0).withColumnsRenamed({k: k.lower() for k in kinds})


@query("a19_occurrences", f"WITH h AS (SELECT source, doc_id, {N('text')} AS hay FROM documents) SELECT source, CAST(sum((length(hay) - length(replace(hay, 'tion', ''))) / 4) AS BIGINT) AS occurrences, min(CASE WHEN contains(hay, 'tion') THEN doc_id END) AS first_page FROM h GROUP BY source")
def a19(spark, sf):
    """Uses of a term without overlap, and the first page with one."""
    h = Tables(spark, sf).documents.select("source", "doc_id", tx.normalize(F.col("text")).alias("hay"))
    n = ((F.length("hay") - F.length(F.replace("hay", F.lit("tion"), F.lit("")))) / 4).cast("long")
    return h.groupBy("source").agg(F.sum(n).alias("occurrences"), F.min(F.when(F.contains("hay", F.lit("tion")), F.col("doc_id"))).alias("first_page"))


@query("a20_divergence_order", "WITH d AS (SELECT p_brand, CAST(count(DISTINCT l_returnflag) AS BIGINT) * 10 + CASE WHEN count(DISTINCT l_suppkey) < 10 THEN 15 WHEN count(DISTINCT l_suppkey) < 20 THEN 5 ELSE 0 END AS score FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand) SELECT p_brand, score, CAST(row_number() OVER (ORDER BY score DESC, p_brand) AS INT) AS rank FROM d")
def a20(spark, sf):
    """Rows with more different statuses first; one row a brand."""
    t = Tables(spark, sf)
    suppliers = F.countDistinct("l_suppkey")
    joined = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.countDistinct("l_returnflag").alias("kinds"), suppliers.alias("suppliers"))
    scored = joined.select("p_brand", (F.col("kinds") * 10 + F.when(F.col("suppliers") < 10, 15).when(F.col("suppliers") < 20, 5).otherwise(0)).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "p_brand")))


@query("a22_first_appearance_groups", "WITH g AS (SELECT c_mktsegment, min(c_custkey) AS first, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment) SELECT c_mktsegment, n, CAST(row_number() OVER (ORDER BY first) AS INT) AS ord FROM g")
def a22(spark, sf):
    g = Tables(spark, sf).customer.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("first"), F.count("*").alias("n"))
    return g.select("c_mktsegment", "n", F.row_number().over(Window.orderBy("first")).alias("ord"))


@query("a23_offer_points", "WITH s AS (SELECT user_id, event_type, round(sum(value), 2) AS points FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, points, CAST(rank() OVER (PARTITION BY user_id ORDER BY points DESC) AS INT) AS rank FROM s")
def a23(spark, sf):
    """Points of the options chosen, summed per offer and ranked for each user."""
    s = Tables(spark, sf).events.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("points"))
    return s.withColumn("rank", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("points"))))


@query("a24_common_value", "SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 AND count(*) = count(p_type) THEN max(p_type) END AS profile, CAST(sum(p_size) AS BIGINT) AS cases, bool_and(p_size > 1) AS countersigned FROM part GROUP BY p_brand")
def a24(spark, sf):
    common = F.when((F.countDistinct("p_type") == 1) & (F.count("*") == F.count("p_type")), F.max("p_type"))
    return Tables(spark, sf).part.groupBy("p_brand").agg(common.alias("profile"), F.sum("p_size").alias("cases"), F.bool_and(F.col("p_size") > 1).alias("countersigned"))


@query("a25_decision_sets", "WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS flags FROM lineitem GROUP BY l_orderkey) SELECT array_to_string(flags, '') AS flags, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY flags")
def a25(spark, sf):
    """How many registries have the same set of decisions."""
    s = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags"))
    return s.groupBy("flags").agg(F.count("*").alias("n"))
