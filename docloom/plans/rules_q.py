"""Decision tables: ordered rules over claims (orders) and their clauses (line items)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.plans.base import Tables, query

# A claim's clauses: flag A stands for a guarantee, R for an exclusion, N for a condition; status F is confirmed.
_CLAIMS = """claims AS (SELECT o_orderkey AS claim, o_custkey AS case_id, o_orderpriority AS priority, o_orderstatus = 'F' AS linked, o_totalprice < 50000 AS contradicted FROM orders),
  clauses AS (SELECT l_orderkey AS claim, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS excluded, bool_or(l_returnflag = 'A') AS guarantee, bool_and(l_linestatus = 'F') AS confirmed, bool_or(l_returnflag = 'N') AS condition FROM lineitem GROUP BY l_orderkey),
  judged AS (SELECT c.*, k.claim IS NOT NULL AS cited, k.excluded, k.guarantee, k.condition, CASE WHEN k.claim IS NULL THEN NULL WHEN contradicted THEN 'human' WHEN NOT linked AND excluded THEN 'no' WHEN NOT confirmed AND NOT guarantee THEN 'human' WHEN condition AND NOT linked THEN 'human' WHEN guarantee THEN 'yes' ELSE 'no' END AS applies FROM claims c LEFT JOIN clauses k ON k.claim = c.claim)"""


def judged(t: Tables):
    """Each claim with what its clauses say and an ordered chain of rules: null, human, no or yes."""
    claims = t.orders.select(F.col("o_orderkey").alias("claim"), F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("linked"), (F.col("o_totalprice") < 50000).alias("contradicted"))
    flag, fixed = F.col("l_returnflag"), F.col("l_linestatus") == "F"
    clauses = t.lineitem.groupBy(F.col("l_orderkey").alias("claim")).agg(F.bool_or((flag == "R") & fixed).alias("excluded"), F.bool_or(flag == "A").alias("guarantee"), F.bool_and(fixed).alias("confirmed"), F.bool_or(flag == "N").alias("condition"), F.lit(True).alias("found"))
    joined = claims.join(clauses, "claim", "left")
    applies = (
        F.when(F.col("found").isNull(), F.lit(None))
        .when(F.col("contradicted"), "human")
        .when(~F.col("linked") & F.col("excluded"), "no")
        .when(~F.col("confirmed") & ~F.col("guarantee"), "human")
        .when(F.col("condition") & ~F.col("linked"), "human")
        .when(F.col("guarantee"), "yes")
        .otherwise("no")
    )
    return joined.withColumn("applies", applies)


@query("d1_applicable_claims", f"WITH {_CLAIMS} SELECT claim, applies FROM judged")
def d1(spark, sf):
    return judged(Tables(spark, sf)).select("claim", "applies")


_ORD = "CASE {} WHEN 'no' THEN 0 WHEN 'human' THEN 1 WHEN 'yes' THEN 2 END"


def _ordinal(c):
    return F.when(c == "no", 0).when(c == "human", 1).when(c == "yes", 2)


@query(
    "d2_d3_principal_guarantee",
    f"WITH {_CLAIMS}, p AS (SELECT case_id, coalesce(max({_ORD.format('applies')}) FILTER (priority <> '5-LOW' AND guarantee), 1) AS principal FROM judged GROUP BY case_id) SELECT claim, CASE WHEN priority = '5-LOW' THEN least({_ORD.format('applies')}, principal) ELSE {_ORD.format('applies')} END AS rank FROM judged j JOIN p ON p.case_id = j.case_id",
)
def d2(spark, sf):
    """An extension (priority 5) applies at most as far as the case's principal guarantee; no guarantee counts as human."""
    j = judged(Tables(spark, sf)).withColumn("own", _ordinal(F.col("applies")))
    principal = j.groupBy("case_id").agg(F.coalesce(F.max(F.when((F.col("priority") != "5-LOW") & F.col("guarantee"), F.col("own"))), F.lit(1)).alias("principal"))
    # least() skips nulls in both engines, so an extension that wasn't judged takes the principal's rank
    return j.join(principal, "case_id").select("claim", F.when(F.col("priority") == "5-LOW", F.least("own", "principal")).otherwise(F.col("own")).alias("rank"))


@query("d4_decisive_exclusion", f"WITH {_CLAIMS} SELECT case_id, min(claim) AS claim FROM judged WHERE excluded AND (linked OR priority = '1-URGENT') GROUP BY case_id")
def d4(spark, sf):
    """The first exclusion that applies and meets the case or is linked to the facts."""
    hits = judged(Tables(spark, sf)).filter(F.col("excluded") & (F.col("linked") | (F.col("priority") == "1-URGENT")))
    return hits.groupBy("case_id").agg(F.min("claim").alias("claim"))


@query("d5_open_siblings", f"WITH {_CLAIMS}, h AS (SELECT case_id, priority, claim FROM judged WHERE applies = 'human' AND guarantee) SELECT claim, CAST(count(*) OVER (PARTITION BY case_id, priority) - 1 AS BIGINT) AS siblings FROM h")
def d5(spark, sf):
    """How many other open guarantees share a claim's lead-in."""
    h = judged(Tables(spark, sf)).filter((F.col("applies") == "human") & F.col("guarantee"))
    return h.select("claim", (F.count("*").over(Window.partitionBy("case_id", "priority")) - 1).alias("siblings"))


@query(
    "d6_verdict",
    f"""WITH {_CLAIMS}, f AS (SELECT case_id, count(applies) AS n, coalesce(bool_or(excluded AND linked), false) AS excl, coalesce(bool_or(applies = 'yes' AND linked), false) AS yes, coalesce(bool_or(applies = 'human'), false) AS human, bool_or(contradicted) AS contra FROM judged GROUP BY case_id)
    SELECT case_id, CASE WHEN n = 0 THEN 'nothing read' WHEN contra AND NOT yes THEN 'contradicted' WHEN excl AND NOT yes THEN 'excluded' WHEN yes AND excl THEN 'human' WHEN yes AND NOT human THEN 'covered' WHEN yes THEN 'covered if' WHEN human THEN 'human' ELSE 'not covered' END AS verdict FROM f""",
)
def d6(spark, sf):
    """One exclusive table per case over flags of its claims."""
    f = judged(Tables(spark, sf)).groupBy("case_id").agg(
        F.count("applies").alias("n"),
        F.coalesce(F.bool_or(F.col("excluded") & F.col("linked")), F.lit(False)).alias("excl"),
        F.coalesce(F.bool_or((F.col("applies") == "yes") & F.col("linked")), F.lit(False)).alias("yes"),
        F.coalesce(F.bool_or(F.col("applies") == "human"), F.lit(False)).alias("human"),
        F.bool_or("contradicted").alias("contra"),
    )
    yes, human, excl = F.col("yes"), F.col("human"), F.col("excl")
    verdict = F.when(F.col("n") == 0, "nothing read").when(F.col("contra") & ~yes, "contradicted").when(excl & ~yes, "excluded").when(yes & excl, "human").when(yes & ~human, "covered").when(yes, "covered if").when(human, "human").otherwise("not covered")
    return f.select("case_id", verdict.alias("verdict"))


@query("d8_qualifier_roots", "SELECT p_partkey, array_to_string(list_sort(list_filter(['blu', 'gre', 'lar', 'red', 'sma'], lambda r: len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, r))) > 0)), ',') AS roots FROM part")
def d8(spark, sf):
    """Roots of a lexicon that begin a word of the name."""
    found = F.filter(F.array(*[F.lit(r) for r in ("blu", "gre", "lar", "red", "sma")]), lambda r: F.exists(F.split("p_name", " "), lambda w: F.startswith(w, r)))
    return Tables(spark, sf).part.select("p_partkey", F.array_join(F.array_sort(found), ",").alias("roots"))


@query("d9_d10_missing_facts", f"WITH {_CLAIMS}, m AS (SELECT case_id, priority FROM judged WHERE applies IN ('human', 'yes') AND NOT linked GROUP BY case_id, priority), e AS (SELECT case_id, priority FROM judged WHERE applies = 'yes' AND linked GROUP BY case_id, priority), r AS (SELECT m.*, row_number() OVER (PARTITION BY m.case_id ORDER BY m.priority) AS pos FROM m LEFT JOIN e ON e.case_id = m.case_id AND e.priority = m.priority WHERE e.case_id IS NULL) SELECT case_id, priority FROM r WHERE pos <= 2")
def d9(spark, sf):
    """Facts that claims still lack, without those that another claim establishes; two at most."""
    j = judged(Tables(spark, sf))
    missing = j.filter(F.col("applies").isin("human", "yes") & ~F.col("linked")).select("case_id", "priority").distinct()
    known = j.filter((F.col("applies") == "yes") & F.col("linked")).select("case_id", "priority").distinct()
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("priority"))
    return missing.join(known, ["case_id", "priority"], "left_anti").withColumn("pos", place).filter("pos <= 2").select("case_id", "priority")


_CITATIONS = "cites AS (SELECT l_orderkey AS claim, l_partkey || '/' || l_linenumber AS cond, l_returnflag FROM lineitem)"


@query("d11_open_conditions", f"WITH {_CLAIMS}, {_CITATIONS}, y AS (SELECT DISTINCT cond FROM cites JOIN judged USING (claim) WHERE applies = 'yes') SELECT DISTINCT cond AS condition FROM cites JOIN judged USING (claim) WHERE l_returnflag = 'N' AND applies = 'human' AND cond NOT IN (SELECT cond FROM y)")
def d11(spark, sf):
    """Conditions (a line of a part's text) of open claims that no applying claim cites."""
    t = Tables(spark, sf)
    condition = F.concat(F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("condition")
    cited = t.lineitem.select(F.col("l_orderkey").alias("claim"), condition, "l_returnflag").join(judged(t).select("claim", "applies"), "claim")
    settled = cited.filter("applies = 'yes'").select("condition").distinct()
    return cited.filter("l_returnflag = 'N' and applies = 'human'").select("condition").distinct().join(settled, "condition", "left_anti")


@query("d12_escalations", f"WITH {_CLAIMS} SELECT case_id, array_to_string(list_filter([CASE WHEN bool_or(contradicted) THEN 'contradiction' END, CASE WHEN bool_or(priority = '4-NOT SPECIFIED') THEN 'open reference' END, CASE WHEN bool_or(NOT coalesce(guarantee, false)) THEN 'unconfirmed' END, CASE WHEN bool_or(NOT cited) THEN 'empty scope' END], lambda x: x IS NOT NULL), ',') AS escalate FROM judged GROUP BY case_id")
def d12(spark, sf):
    """Fixed messages by flag, in a fixed order."""
    flags = [("contradicted", F.bool_or("contradicted")), ("open reference", F.bool_or(F.col("priority") == "4-NOT SPECIFIED")), ("unconfirmed", F.bool_or(~F.coalesce("guarantee", F.lit(False)))), ("empty scope", F.bool_or(F.col("found").isNull()))]
    names = {"contradicted": "contradiction"}
    messages = F.array_compact(F.array(*[F.when(c, names.get(n, n)) for n, c in flags]))
    return judged(Tables(spark, sf)).groupBy("case_id").agg(F.array_join(messages, ",").alias("escalate"))


_READINGS = "r1 AS (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS kind FROM labels), r2 AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'bad' ELSE 'good' END AS kind FROM documents WHERE doc_id % 4 > 0), r3 AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'good' ELSE 'bad' END AS kind FROM documents WHERE doc_id % 3 > 0)"


@query(
    "d13_d15_adjudication",
    f"""WITH {_READINGS}, d AS (SELECT doc_id, CASE WHEN r1.kind IS NULL THEN 'NOT_PLANNED' WHEN r2.kind IS NULL THEN 'FAILED' WHEN r1.kind = r2.kind THEN 'KIND_MATCH' WHEN r3.kind IS NULL THEN 'KIND_MISMATCH' WHEN r3.kind = r1.kind THEN 'ARBITRATION_FIRST' ELSE 'ARBITRATION_SECOND' END AS reason, r1.kind AS a, r2.kind AS b, r3.kind AS c FROM documents LEFT JOIN r1 USING (doc_id) LEFT JOIN r2 USING (doc_id) LEFT JOIN r3 USING (doc_id))
    SELECT doc_id, reason, CASE WHEN reason = 'KIND_MATCH' THEN a WHEN reason LIKE 'ARB%' THEN c END AS kind, CAST(reason = 'KIND_MATCH' OR reason LIKE 'ARB%' AS INT) AS settled FROM d""",
)
def d13(spark, sf):
    """Two readings and an arbiter: equal kinds stand without one, unequal ones need its voice."""
    t = Tables(spark, sf)
    first = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("a"))
    base = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.when(F.col("n_chars") % 3 == 0, "bad").otherwise("good")).alias("b"), F.when(F.col("doc_id") % 3 > 0, F.when(F.col("lang") == "en", "good").otherwise("bad")).alias("c"))
    j = base.join(first, "doc_id", "left")
    reason = F.when(F.col("a").isNull(), "NOT_PLANNED").when(F.col("b").isNull(), "FAILED").when(F.col("a") == F.col("b"), "KIND_MATCH").when(F.col("c").isNull(), "KIND_MISMATCH").when(F.col("c") == F.col("a"), "ARBITRATION_FIRST").otherwise("ARBITRATION_SECOND")
    j = j.withColumn("reason", reason)
    arbitrated = F.col("reason").startswith("ARB")
    return j.select("doc_id", "reason", F.when(F.col("reason") == "KIND_MATCH", F.col("a")).when(arbitrated, F.col("c")).alias("kind"), ((F.col("reason") == "KIND_MATCH") | arbitrated).cast("int").alias("settled"))


@query("d14_critical_disagreement", "SELECT l_orderkey, l_linenumber, CAST(count(*) FILTER (l_returnflag IS DISTINCT FROM other OR abs(l_tax - l_discount) > 0.05) AS BIGINT) AS disagreements FROM (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'A' ELSE l_returnflag END AS other FROM lineitem) GROUP BY l_orderkey, l_linenumber")
def d14(spark, sf):
    """Payloads differ (null against a value too), or confidences are further apart than allowed."""
    other = F.when(F.col("l_suppkey") % 5 == 0, F.lit(None)).when(F.col("l_linestatus") == "F", "A").otherwise(F.col("l_returnflag"))
    apart = ~F.col("l_returnflag").eqNullSafe(other) | (F.abs(F.col("l_tax") - F.col("l_discount")) > 0.05)
    return Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count_if(apart).alias("disagreements"))


@query("d16_gate_alerts", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'no gate' WHEN p_size < 10 THEN 'gate failed' WHEN (p_type, p_brand) = ('PROMO', 'Brand#7') THEN 'old protocol' END AS alert FROM part")
def d16(spark, sf):
    alert = F.when(F.col("p_size") == 1, "no gate").when(F.col("p_size") < 10, "gate failed").when((F.col("p_type") == "PROMO") & (F.col("p_brand") == "Brand#7"), "old protocol")
    return Tables(spark, sf).part.select("p_partkey", alert.alias("alert"))
