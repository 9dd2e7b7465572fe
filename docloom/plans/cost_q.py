"""Costs, tokens, cache bounds and calculators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.base import Tables, query
from docloom.plans.joins_q import BRACKET_SQL, bracket_tax

# Fixed values of the casting: price per million tokens by model (an order's status), and the rate to euros.
PRICES = {"F": (3.0, 15.0, 0.3), "O": (1.0, 5.0, 0.1), "P": (0.25, 1.25, 0.03)}
FX = 0.92


def usage_cost(model, fresh, output, cached, batch, prices=PRICES, fx=FX):
    """Token buckets times their prices, half for batches, in euros with four places, half to even."""
    price = lambda i: F.element_at(F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.lit(v[i]))]), model)
    dollars = (fresh * price(0) + output * price(1) + cached * price(2)) / 1e6
    return F.bround(dollars * F.when(batch, 0.5).otherwise(1.0) * fx, 4)


_PRICE = lambda i: "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in PRICES.items()) + " END"
_USAGE = "u AS (SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS fresh, o_orderkey % 5000 AS output, CAST(o_custkey * 17 % 90000 AS BIGINT) AS cached, o_orderpriority = '5-LOW' AS batch FROM orders)"


def _usage(t: Tables):
    return t.orders.select("o_orderkey", "o_orderstatus", F.floor("o_totalprice").alias("fresh"), (F.col("o_orderkey") % 5000).alias("output"), (F.col("o_custkey") * 17 % 90000).alias("cached"), (F.col("o_orderpriority") == "5-LOW").alias("batch"))


@query("l1_usage_cost", f"WITH {_USAGE} SELECT o_orderkey, round(CAST((fresh * CAST({_PRICE(0)} AS DOUBLE) + output * CAST({_PRICE(1)} AS DOUBLE) + cached * CAST({_PRICE(2)} AS DOUBLE)) / 1e6 * CASE WHEN batch THEN 0.5 ELSE 1.0 END * CAST({FX} AS DOUBLE) AS DOUBLE), 4) AS cost FROM u")
def l1(spark, sf):
    cost = usage_cost(F.col("o_orderstatus"), F.col("fresh"), F.col("output"), F.col("cached"), F.col("batch"))
    return _usage(Tables(spark, sf)).select("o_orderkey", cost.alias("cost"))


@query("l2_token_estimate", "SELECT doc_id, CAST(ceil(length(text) * CAST(1.3 AS DOUBLE) / 2.0) AS BIGINT) AS tokens FROM documents")
def l2(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.ceil(F.length("text") * F.lit(1.3) / 2.0).alias("tokens"))


@query("l3_cost_bound", "SELECT source, round(sum(ceil(length(text) * CAST(1.3 AS DOUBLE) / 2.0)) * 15.0 / 1e6 + count(*) * 0.001, 6) AS bound FROM documents GROUP BY source")
def l3(spark, sf):
    """An upper bound by item at the worst tariff."""
    tokens = F.ceil(F.length("text") * F.lit(1.3) / 2.0)
    return Tables(spark, sf).documents.groupBy("source").agg(F.round(F.sum(tokens) * 15.0 / 1e6 + F.count("*") * 0.001, 6).alias("bound"))


@query(
    "l6_client_identity",
    "WITH h AS (SELECT page_id, (page_id * 7 % 223 + 1) || '.' || (page_id % 256) || '.0.' || (page_id % 250 + 1) AS ip FROM pages) SELECT page_id, ip AS client FROM h",
)
def l6(spark, sf):
    """The first forwarded address without brackets and port."""
    key = F.col("page_id")
    ip = F.concat_ws(".", (key * 7 % 223 + 1).cast("string"), (key % 256).cast("string"), F.lit("0"), (key % 250 + 1).cast("string"))
    header = F.when(key % 3 == 0, F.concat(ip, F.lit(":8080, 10.0.0.1"))).when(key % 3 == 1, F.concat(F.lit(" "), ip, F.lit(" , 10.0.0.2"))).otherwise(ip)
    first = F.trim(F.element_at(F.split(header, ","), 1))
    return Tables(spark, sf).pages.select("page_id", F.regexp_extract(first, r"^\[?(\d+\.\d+\.\d+\.\d+)\]?(?::\d+)?$", 1).alias("client"))


@query("l7_cache_key", """SELECT doc_id, sha256('{"lang":"' || lang || '","length":' || n_chars || ',"source":"' || source || '"}') AS cache_key FROM documents""")
def l7(spark, sf):
    body = F.to_json(F.struct("lang", F.col("n_chars").alias("length"), "source"))
    return Tables(spark, sf).documents.select("doc_id", F.sha2(body.cast("binary"), 256).alias("cache_key"))


@query("l8_cache_bounds", "WITH r AS (SELECT source, doc_id, row_number() OVER w AS pos, sum(strlen(text)) OVER w AS bytes FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id FROM r WHERE pos <= 20 AND bytes <= 60000")
def l8(spark, sf):
    """The newest entries that fit both bounds: 20 entries and 60,000 bytes a source."""
    newest = Window.partitionBy("source").orderBy(F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, 0)
    sized = Tables(spark, sf).documents.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id"))).alias("pos"), F.sum(F.octet_length("text")).over(newest).alias("bytes"))
    return sized.filter("pos <= 20 and bytes <= 60000").select("source", "doc_id")


@query("l10_campaign_ledger", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders")
def l10(spark, sf):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return Tables(spark, sf).orders.select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(order), 2).alias("running"))


# Fixed values of the casting: a payroll with capped contributions, an allowance and a surcharge above a threshold.
CAP, RATE, CARE, ALLOWANCE, LUMP, SURCHARGE = 300_000.0, 0.11, 0.014, 6_000.0, 1_020.0, (150_000.0, 0.07, 0.09)


def payroll(gross, relief):
    """contributions, taxable, tax, net for a gross amount; `relief` exempts half of it."""
    contributions = F.least(gross, F.lit(CAP)) * RATE + CARE * F.greatest(F.lit(0.0), gross - ALLOWANCE)
    taxable = F.greatest(F.lit(0.0), gross - contributions - F.when(relief, 0.5 * gross).otherwise(0.0) - LUMP)
    threshold, low, high = SURCHARGE
    tax = bracket_tax(taxable) * (1 + F.when(taxable > threshold, high).otherwise(low))
    return contributions, taxable, tax, gross - contributions - tax


_CONTRIB = f"(least(g, {CAP}) * {RATE} + {CARE} * greatest(0, g - {ALLOWANCE}))"
_PAY = f"""a AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS g, o_orderkey % 4 = 0 AS relief FROM orders), b AS (SELECT *, {_CONTRIB} AS contributions FROM a),
  c AS (SELECT *, greatest(0, g - contributions - CASE WHEN relief THEN 0.5 * g ELSE 0 END - {LUMP}) AS taxable FROM b),
  d AS (SELECT *, {BRACKET_SQL.format(x='taxable')} * (1 + CASE WHEN taxable > {SURCHARGE[0]} THEN {SURCHARGE[2]} ELSE {SURCHARGE[1]} END) AS tax FROM c)"""


@query("l11_payroll", f"WITH {_PAY} SELECT o_orderkey, round(CAST(contributions AS DOUBLE), 3) AS contributions, round(CAST(tax AS DOUBLE), 3) AS tax, round(CAST(g - contributions - tax AS DOUBLE), 3) AS net FROM d")
def l11(spark, sf):
    contributions, _, tax, net = payroll(F.col("o_totalprice"), F.col("o_orderkey") % 4 == 0)
    return Tables(spark, sf).orders.select("o_orderkey", F.round(contributions, 3).alias("contributions"), F.round(tax, 3).alias("tax"), F.round(net, 3).alias("net"))


@query("l12_household", f"WITH h AS (SELECT o_custkey, max(o_totalprice) AS high, min(o_totalprice) AS low, sum(o_totalprice) AS both FROM orders GROUP BY o_custkey) SELECT o_custkey, round(CAST({BRACKET_SQL.format(x='high')} + low * 0.15 AS DOUBLE), 3) AS withheld, round(CAST({BRACKET_SQL.format(x='(high + low)')} AS DOUBLE), 3) AS assessed FROM h")
def l12(spark, sf):
    """Two incomes: brackets on the higher and a fixed rate on the lower, against brackets on their sum."""
    h = Tables(spark, sf).orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))
    withheld = bracket_tax(F.col("high")) + F.col("low") * 0.15
    return h.select("o_custkey", F.round(withheld, 3).alias("withheld"), F.round(bracket_tax(F.col("high") + F.col("low")), 3).alias("assessed"))


@query("l13_scenarios", f"SELECT o_orderkey, k AS scenario, round(CAST(CASE k WHEN 'plain' THEN {BRACKET_SQL.format(x='o_totalprice')} WHEN 'half' THEN {BRACKET_SQL.format(x='(o_totalprice / 2)')} ELSE o_totalprice * 0.2 END AS DOUBLE), 6) AS tax FROM orders, (VALUES ('plain'), ('half'), ('flat')) v(k)")
def l13(spark, sf):
    """One input in three scenarios: an explode of a constant array."""
    rows = Tables(spark, sf).orders.withColumn("scenario", F.explode(F.array(F.lit("plain"), F.lit("half"), F.lit("flat"))))
    paid = F.col("o_totalprice")
    tax = F.when(F.col("scenario") == "plain", bracket_tax(paid)).when(F.col("scenario") == "half", bracket_tax(paid / 2)).otherwise(paid * 0.2)
    return rows.select("o_orderkey", "scenario", F.round(tax, 6).alias("tax"))


@query("l14_annuity", "SELECT o_orderkey, round(CASE WHEN r = 0 THEN o_totalprice / 240 ELSE o_totalprice * r / (1 - pow(1 + r, -240)) END, 6) AS payment, round(CASE WHEN r = 0 THEN 900 * 240.0 ELSE 900 * (1 - pow(1 + r, -240)) / r END, 2) AS capital FROM (SELECT *, CAST(o_orderkey % 6 AS DOUBLE) / 100 / 12 AS r FROM orders)")
def l14(spark, sf):
    """Monthly payment of a loan and what 900 a month can carry over 240 months; a zero rate has its own branch."""
    r = (F.col("o_orderkey") % 6).cast("double") / 100 / 12
    factor = 1 - F.pow(1 + r, F.lit(-240.0))
    payment = F.when(r == 0, F.col("o_totalprice") / 240).otherwise(F.try_divide(F.col("o_totalprice") * r, factor))
    capital = F.when(r == 0, F.lit(900 * 240.0)).otherwise(F.try_divide(900 * factor, r))
    return Tables(spark, sf).orders.select("o_orderkey", F.round(payment, 6).alias("payment"), F.round(capital, 2).alias("capital"))


@query("l17_digest", "SELECT source, sha256(string_agg(range || chr(1) || digest, chr(1) ORDER BY range)) AS digest FROM (SELECT source, doc_id // 1000 AS range, sha256(string_agg(doc_id || chr(1) || md5(text), chr(1) ORDER BY doc_id)) AS digest FROM documents GROUP BY source, doc_id // 1000) GROUP BY source")
def l17(spark, sf):
    """One digest of all keys and contents in order: of ranges of 1,000 keys first, then of these, so that no group is large."""

    def digest(rows: DataFrame, by: list[str], key: str, value: Column) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("h")))), lambda x: F.concat(x[key].cast("string"), F.lit("\x01"), x["h"]))
        return rows.groupBy(*by).agg(F.sha2(F.array_join(parts, "\x01").cast("binary"), 256).alias("digest"))

    rows = Tables(spark, sf).documents.withColumn("range", F.floor(F.col("doc_id") / 1000))
    return digest(digest(rows, ["source", "range"], "doc_id", F.md5(F.col("text").cast("binary"))), ["source"], "range", F.col("digest"))
