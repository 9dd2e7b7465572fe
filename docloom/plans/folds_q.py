"""Sequential folds and conversation state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import folds
from docloom.plans.base import LINES, Tables, lines, query
from docloom.plans.text_q import DENIALS, MEANING, NO, UNSURE, YES


def _admission_sql(units: str, most_blocks: int, most_tokens: int) -> str:
    """Greedy admission as a recursive query, a unit of every question in each step; `units` has question, unit, n, blocks, tokens."""
    return f"""WITH RECURSIVE u AS ({units}),
    f AS (
      SELECT question, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS unit, CAST([] AS BIGINT[]) AS inside, CAST(0 AS BIGINT) AS spent, CAST(NULL AS VARCHAR) AS reason FROM u WHERE n = 1
      UNION ALL
      SELECT question, n, unit, CASE WHEN why IS NULL THEN list_concat(inside, fresh) ELSE inside END, CASE WHEN why IS NULL THEN spent + cost ELSE spent END, why
      FROM (SELECT *, CASE WHEN len(inside) + len(fresh) > {most_blocks} THEN 'blocks' WHEN spent + cost > {most_tokens} THEN 'tokens' END AS why
        FROM (SELECT f.question, u.n, u.unit, inside, spent,
            list_distinct(list_filter(u.blocks, lambda b: NOT list_contains(inside, b))) AS fresh,
            CAST(coalesce(list_sum(list_transform(list_filter(list_zip(u.blocks, u.tokens, range(1, len(u.blocks) + 1)), lambda x: NOT list_contains(inside, x[1]) AND NOT list_contains(u.blocks[x[3] + 1:], x[1])), lambda x: x[2])), 0) AS BIGINT) AS cost
          FROM f JOIN u ON u.question = f.question AND u.n = f.n + 1)))
    SELECT question, unit, reason IS NULL AS admitted, reason FROM f WHERE n > 0"""


_UNITS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS unit"


@query(
    "r13_greedy_admission",
    _admission_sql(f"SELECT question, unit, row_number() OVER (PARTITION BY question ORDER BY -price, unit) AS n, [part, part % 5] AS blocks, [q, 3] AS tokens FROM (SELECT l_orderkey AS question, {_UNITS}, l_extendedprice AS price, l_partkey AS part, CAST(l_quantity AS INT) AS q FROM lineitem)", 12, 150),
)
def r13(spark, sf):
    """An order's line items by price are units of one to three parts; twelve parts and 150 pieces are the budget."""
    t = Tables(spark, sf)
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_linenumber", "l_extendedprice")
    numbered = rows.withColumn("unit", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).cast("long"))
    units = numbered.select(F.col("l_orderkey").alias("question"), "unit", (-F.col("l_extendedprice")).alias("ord"), F.array("l_partkey", F.col("l_partkey") % 5).alias("blocks"), F.array("q", F.lit(3)).alias("tokens"))
    return folds.greedy_admission(units, 12, 150)


@query(
    "r15_targeted_extension",
    _admission_sql(f"SELECT question, unit, row_number() OVER (PARTITION BY question ORDER BY line, unit) AS n, [part] AS blocks, [q] AS tokens FROM (SELECT l_orderkey AS question, {_UNITS}, l_linenumber AS line, l_partkey AS part, CAST(l_quantity AS INT) AS q FROM lineitem)", 3, 60),
)
def r15(spark, sf):
    """The same operator with the counters of a smaller remaining budget, block by block."""
    t = Tables(spark, sf)
    rows = t.lineitem.withColumn("unit", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).cast("long"))
    units = rows.select(F.col("l_orderkey").alias("question"), "unit", F.col("l_linenumber").cast("double").alias("ord"), F.array("l_partkey").alias("blocks"), F.array(F.col("l_quantity").cast("int")).alias("tokens"))
    return folds.greedy_admission(units, 3, 60)


@query(
    "l16_greedy_chunks",
    f"""WITH RECURSIVE {LINES}, u AS (SELECT doc_id, seq, length(line) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM lines),
    f AS (
      SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS INT) AS seq, CAST(0 AS INT) AS current, CAST(0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS chars, CAST(0 AS INT) AS chunk FROM u WHERE n = 1
      UNION ALL
      SELECT doc_id, n, seq, CASE WHEN over_long OR NOT filled THEN current ELSE current + 1 END, CASE WHEN over_long THEN items WHEN filled THEN 1 ELSE items + 1 END, CASE WHEN over_long THEN chars WHEN filled THEN size ELSE chars + size END, CASE WHEN over_long THEN -1 WHEN filled THEN current + 1 ELSE current END
      FROM (SELECT f.doc_id, u.n, u.seq, current, items, chars, size, size > 1200 AS over_long, items > 0 AND (items + 1 > 5 OR chars + size > 1200) AS filled FROM f JOIN u ON u.doc_id = f.doc_id AND u.n = f.n + 1))
    SELECT doc_id, seq, chunk FROM f WHERE n > 0""",
)
def l16(spark, sf):
    """Lines of a document in chunks of at most 5 lines and 1,200 characters."""
    return folds.greedy_chunks(lines(Tables(spark, sf)).select("doc_id", "seq", F.length("line").alias("chars")), 5, 1200)


@query(
    "l4_l5_quota_windows",
    """WITH RECURSIVE u AS (SELECT user_id AS client, event_id AS request, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (
      SELECT client, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request, CAST(NULL AS DOUBLE) AS ms, CAST(0 AS BIGINT) AS mc, CAST(NULL AS DOUBLE) AS ds, CAST(0 AS BIGINT) AS dc FROM u WHERE n = 1
      UNION ALL
      SELECT f.client, u.n, u.request, CASE WHEN ms IS NULL OR t - ms >= 60 THEN t ELSE ms END, CASE WHEN ms IS NULL OR t - ms >= 60 THEN 1 ELSE mc + 1 END, CASE WHEN ds IS NULL OR t - ds >= 86400 THEN t ELSE ds END, CASE WHEN ds IS NULL OR t - ds >= 86400 THEN 1 ELSE dc + 1 END
      FROM f JOIN u ON u.client = f.client AND u.n = f.n + 1)
    SELECT client, request, CASE WHEN mc > 3 THEN 'minute' WHEN dc > 60 THEN 'day' ELSE 'served' END AS verdict FROM f WHERE n > 0""",
)
def l4(spark, sf):
    """Events as requests: 3 a minute and 60 a day for each user, in windows that start with the user's own events."""
    events = Tables(spark, sf).events
    return folds.quota_decisions(events.select(F.col("user_id").alias("client"), F.col("event_id").alias("request"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), 3, 60)


@query(
    "d7_fact_absorption",
    """WITH RECURSIVE u AS (
      SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n, p_name || ' ' || p_type AS label,
        list_distinct(CASE WHEN p_size % 4 = 0 THEN list_concat(string_split(p_name, ' '), [lower(p_type)]) WHEN p_size % 4 = 3 THEN [] ELSE string_split(p_name, ' ') END) AS roots
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    f AS (
      SELECT grp, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k VARCHAR[], c VARCHAR[])[]) AS kept FROM u WHERE n = 1
      UNION ALL
      SELECT grp, n, CASE
          WHEN len(roots) = 0 THEN CASE WHEN len(list_filter(kept, lambda x: len(x.k) = 0 AND x.c[1] = label)) > 0 THEN kept ELSE list_append(kept, {'k': roots, 'c': [label]}) END
          WHEN cover IS NOT NULL THEN list_transform(kept, lambda x, i: CASE WHEN i = cover AND NOT list_contains(x.c, label) THEN {'k': x.k, 'c': list_append(x.c, label)} ELSE x END)
          ELSE list_append(list_filter(kept, lambda x: len(x.k) = 0 OR NOT list_has_all(roots, x.k)),
            {'k': roots, 'c': list_concat([label], list_filter(flatten(list_transform(list_filter(kept, lambda x: len(x.k) > 0 AND list_has_all(roots, x.k)), lambda x: x.c)), lambda v: v <> label))}) END
      FROM (SELECT f.grp, u.n, u.label, u.roots, kept, list_filter(range(1, len(kept) + 1), lambda i: len(kept[i].k) > 0 AND list_has_all(kept[i].k, u.roots))[1] AS cover FROM f JOIN u ON u.grp = f.grp AND u.n = f.n + 1)),
    final AS (SELECT grp, unnest(arg_max(kept, n)) AS x FROM f GROUP BY grp)
    SELECT grp AS "group", x.c[1] AS label, CAST(len(x.c) AS BIGINT) AS variants FROM final""",
)
def d7(spark, sf):
    """Line items' parts as labels; the words of a part's name and type are its roots."""
    t = Tables(spark, sf)
    named = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    roots = F.when(F.col("p_size") % 4 == 0, F.array_union(F.split("p_name", " "), F.array(F.lower("p_type")))).when(F.col("p_size") % 4 == 3, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    labels = named.select(F.col("l_orderkey").alias("group"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("ord"), F.concat_ws(" ", "p_name", "p_type").alias("label"), roots.alias("roots"))
    order = Window.partitionBy("group").orderBy("ord")
    return folds.absorb(labels.withColumn("ord", F.row_number().over(order)))


# Conversations: user turns are answers to the question before them.


@query("c1_active_events", "SELECT event_id FROM events e WHERE event_id NOT IN (SELECT event_id - 3 FROM events WHERE event_type = 'error') AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'signup' AND value < 5)")
def c1(spark, sf):
    """Events that no later one replaces (an error replaces the third before it) and that lost no conflict."""
    events = Tables(spark, sf).events
    replaced = events.filter("event_type = 'error'").select((F.col("event_id") - 3).alias("event_id"))
    lost = events.filter("event_type = 'signup' and value < 5").select("event_id")
    return events.select("event_id").join(replaced, "event_id", "left_anti").join(lost, "event_id", "left_anti")


@query("c4_last_response", "SELECT conv_id, arg_max(text, turn) AS last_text, max(turn) AS turn, CAST(count(*) AS BIGINT) AS answers FROM conversations WHERE role = 'user' GROUP BY conv_id")
def c4(spark, sf):
    return Tables(spark, sf).conversations.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("turn"), F.count("*").alias("answers"))


@query(
    "c3_c5_recomputed_claims",
    "WITH a AS (SELECT user_id, event_type, CAST(extract('day' FROM ts) AS INT) AS day, CASE WHEN value < 10 THEN 'negative' WHEN value < 40 THEN 'positive' ELSE 'unclear' END AS meaning FROM events), last AS (SELECT user_id, event_type, day, bool_or(meaning = 'negative') AS neg, bool_or(meaning = 'positive') AS pos FROM a GROUP BY user_id, event_type, day) SELECT user_id, event_type, day, CASE WHEN neg THEN 'no' WHEN pos THEN 'yes' ELSE 'contested' END AS state FROM last",
)
def c3(spark, sf):
    """Answers applied to their claims: a negative one beats a positive, a positive an unclear one."""
    meaning = F.when(F.col("value") < 10, "negative").when(F.col("value") < 40, "positive").otherwise("unclear")
    a = Tables(spark, sf).events.select("user_id", "event_type", F.dayofmonth("ts").alias("day"), meaning.alias("meaning"))
    state = F.when(F.bool_or(F.col("meaning") == "negative"), "no").when(F.bool_or(F.col("meaning") == "positive"), "yes").otherwise("contested")
    return a.groupBy("user_id", "event_type", "day").agg(state.alias("state"))


@query("c6_promoted_questions", "WITH e AS (SELECT *, CAST(extract('day' FROM ts) AS INT) AS day FROM events), q AS (SELECT user_id, day, event_id, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS pos FROM e WHERE event_type = 'view'), act AS (SELECT user_id, day, least(count(*) FILTER (value > 95), 3) AS active FROM e GROUP BY user_id, day) SELECT q.user_id, q.day, event_id FROM q JOIN act a ON a.user_id = q.user_id AND a.day = q.day WHERE pos <= 3 - active")
def c6(spark, sf):
    """Pending questions of a user's day are promoted in order until three are active."""
    events = Tables(spark, sf).events.withColumn("day", F.dayofmonth("ts"))
    active = events.groupBy("user_id", "day").agg(F.least(F.count_if(F.col("value") > 95), F.lit(3)).alias("active"))
    pending = events.filter("event_type = 'view'").withColumn("pos", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("event_id")))
    return pending.join(active, ["user_id", "day"]).filter("pos <= 3 - active").select("user_id", "day", "event_id")


@query("c8_initial_conflicts", "SELECT user_id, event_type, CAST(count(DISTINCT CAST(value AS INT)) AS BIGINT) AS versions FROM events GROUP BY user_id, event_type HAVING count(DISTINCT CAST(value AS INT)) > 1".replace("CAST(value AS INT)", "CAST(floor(value / 20) AS INT)"))
def c8(spark, sf):
    """Facts that different sources give different values."""
    versions = F.countDistinct(F.floor(F.col("value") / 20).cast("int"))
    return Tables(spark, sf).events.groupBy("user_id", "event_type").agg(versions.alias("versions")).filter("versions > 1")


@query("c9_verdict_changes", "SELECT event_id, (event_type, CAST(floor(value / 50) AS BIGINT)) IS DISTINCT FROM lag((event_type, CAST(floor(value / 50) AS BIGINT))) OVER (PARTITION BY user_id ORDER BY event_id) AS changed FROM events")
def c9(spark, sf):
    """Whether a verdict differs from the one before it in value or reason."""
    verdict = F.struct("event_type", F.floor(F.col("value") / 50).alias("v"))
    before = F.lag(verdict).over(Window.partitionBy("user_id").orderBy("event_id"))
    return Tables(spark, sf).events.select("event_id", (~verdict.eqNullSafe(before)).alias("changed"))


@query("c10_history_guard", "SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, count(*) > 8 AS refused FROM conversations GROUP BY conv_id")
def c10(spark, sf):
    """A conversation above the bound is refused as a whole, never cut."""
    n = F.count("*")
    return Tables(spark, sf).conversations.groupBy("conv_id").agg(n.alias("turns"), (n > 8).alias("refused"))


@query(
    "c2_c7_conversation_state",
    f"""WITH m AS ({MEANING}), t AS (SELECT *, CASE WHEN meaning IN ('affirmative', 'negative') THEN meaning END AS clear FROM m)
    SELECT conv_id, turn, meaning, coalesce(last_value(clear IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <> clear, false) AS contradicts FROM t""",
)
def c2(spark, sf):
    """Each user turn applied in order: what it means, whether it replaces or contradicts the last clear answer."""
    meaning = tx.classify_reply(F.col("text"), YES, NO, UNSURE, DENIALS)
    turns = Tables(spark, sf).conversations.filter("role = 'user'").select("conv_id", "turn", meaning.alias("meaning"))
    clear = F.when(F.col("meaning").isin("affirmative", "negative"), F.col("meaning"))
    before = F.last(clear, ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return turns.select("conv_id", "turn", "meaning", F.coalesce((before != F.col("meaning")) & clear.isNotNull(), F.lit(False)).alias("contradicts"))
