"""Text, string and scalar functions over documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.plans.base import LINES, Tables, lines, norm_sql, query, words_sql

N = norm_sql

# Fixed values of these queries.
STOP = ("the", "and", "for", "that", "les", "des", "une", "der", "die", "das", "que", "los", "las")
NEGATIONS = ("not", "no", "ni", "pas", "sin", "nicht", "sans", "aucun", "jamais", "non", "of", "ne")
OPENERS = ("it", "this", "that", "these", "those", "they", "elle", "ce", "cela", "es", "das")
PREPOSITIONS = ("with", "without", "for", "by", "in", "on", "under", "after", "before", "mit", "ohne", "sans", "avec", "pour", "dans", "sur")
IMPERSONAL = ("is", "was", "follows", "seems")
YES = ("oui", "yes", "vrai", "true", "confirme", "c'est confirme", "tout a fait")
NO = ("non", "no", "faux", "false")
UNSURE = ("", "inconnu", "je ne sais pas", "ne sait pas", "unknown", "?")
DENIALS = (r"\bpas du tout\b", r"\bjamais\b", r"\bn['’]?est pas\b", r"\bn['’]?etait pas\b", r"\bne\b.{0,80}\bpas\b")


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("n1_normalize", f"SELECT doc_id, {N('text')} AS norm FROM documents")
def n1(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@query("n3_other_number", f"WITH w AS (SELECT DISTINCT unnest({words_sql(N('text'))}) AS word FROM documents) SELECT word, CASE WHEN length(word) <= 2 THEN NULL WHEN right(word, 1) IN ('s', 'x') THEN left(word, length(word) - 1) ELSE word || 's' END AS other FROM w")
def n3(spark, sf):
    words = Tables(spark, sf).documents.select(F.explode(tx.words(tx.normalize(F.col("text")))).alias("word")).distinct()
    return words.select("word", tx.other_number(F.col("word")).alias("other"))


@query("n4_words", f"SELECT doc_id, CAST(len({words_sql(N('text'))}) AS BIGINT) AS n_words, CAST(len(list_distinct({words_sql(N('text'))})) AS BIGINT) AS n_distinct FROM documents")
def n4(spark, sf):
    found = Tables(spark, sf).documents.select("doc_id", tx.words(tx.normalize(F.col("text"))).alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("n5_section_title", f"WITH {LINES}, t AS (SELECT doc_id, trim(regexp_replace({N('line')}, '^[^a-z]+', '')) AS bare FROM lines WHERE seq = 1) SELECT doc_id, regexp_replace(bare, '^((le|la|les|l|de|des|du|d)( +|$))+', '') AS title FROM t")
def n5(spark, sf):
    return lines(Tables(spark, sf)).filter("seq = 1").select("doc_id", tx.section_title(F.col("line")).alias("title"))


_CUT = "regexp_replace(regexp_replace({h}, ' [^ ]*$', ''), '[ ,;:.]+$', '') || '…'"
_FLAT = "trim(regexp_replace(line, '\\s+', ' ', 'g'))"


@query(
    "n6_n7_cut_text",
    f"WITH {LINES} SELECT doc_id, seq, CASE WHEN length(line) <= 60 THEN line ELSE {_CUT.format(h='left(line, 60)')} END AS cut, CASE WHEN length({_FLAT}) <= 40 THEN {_FLAT} ELSE {_CUT.format(h=f'left({_FLAT}, 39)')} END AS truncated FROM lines",
)
def n6(spark, sf):
    line = F.col("line")
    return lines(Tables(spark, sf)).select("doc_id", "seq", tx.cut_at_word(line, 60).alias("cut"), tx.truncated(line, 40).alias("truncated"))


@query("n8_slug", f"SELECT p_partkey, trim(regexp_replace({N('p_name || chr(32) || p_brand')}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def n8(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("n9_canonical_passage", "SELECT item_id, lower(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '’', '''')) AS passage FROM benchmark")
def n9(spark, sf):
    return Tables(spark, sf).benchmark.select("item_id", tx.canonical_passage(F.col("text")).alias("passage"))


@query("n10_canonical_question", "SELECT conv_id, turn, lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[ ?!.…]+$', '')) AS question FROM conversations WHERE role = 'user'")
def n10(spark, sf):
    return Tables(spark, sf).conversations.filter("role = 'user'").select("conv_id", "turn", tx.canonical_question(F.col("text")).alias("question"))


@query("n11_flat_value", "SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS flat FROM conversations")
def n11(spark, sf):
    return Tables(spark, sf).conversations.select("conv_id", "turn", tx.flat_value(F.col("text")).alias("flat"))


_ANAPHORA = f"""toks AS (SELECT *, string_split(replace({N('sentence')}, '''', ' '), ' ') AS t FROM parts),
  past AS (SELECT *, CASE WHEN t[1] IN {_in(PREPOSITIONS)} THEN t[2] ELSE t[1] END AS w1, CASE WHEN t[1] IN {_in(PREPOSITIONS)} THEN t[3] ELSE t[2] END AS w2 FROM toks),
  marked AS (SELECT *, coalesce(w1 IN {_in(OPENERS)}, false) AND NOT coalesce(w1 = 'it' AND w2 IN {_in(IMPERSONAL)}, false) AS back FROM past)"""
_PARTS = r"""cut AS (SELECT item_id, regexp_replace(trim(text), '([.!?…])\s+([A-ZÀ-Þ])', '\1' || chr(1) || '\2', 'g') AS c FROM benchmark),
  parts AS (SELECT item_id, CAST(unnest(generate_series(1, len(string_split(c, chr(1))))) AS INT) AS ord, unnest(string_split(c, chr(1))) AS sentence FROM cut)"""


def _sentences(t: Tables):
    cut = F.split(F.trim("text"), r"(?<=[.!?…])\s+(?=[A-ZÀ-Þ])")
    parts = t.benchmark.select("item_id", F.posexplode(cut).alias("ord", "sentence")).withColumn("ord", F.col("ord") + 1)
    return parts.withColumn("back", tx.is_anaphoric(F.col("sentence"), OPENERS, PREPOSITIONS, IMPERSONAL))


@query("n13_anaphoric_opening", f"WITH {_PARTS}, {_ANAPHORA} SELECT item_id, ord, back FROM marked")
def n13(spark, sf):
    return _sentences(Tables(spark, sf)).select("item_id", "ord", "back")


@query(
    "n12_reading_units",
    f"""WITH {_PARTS}, {_ANAPHORA}, units AS (SELECT *, CAST(least(greatest(sum(CASE WHEN back THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY ord), 1), 4) AS INT) AS unit FROM marked)
    SELECT item_id, unit, string_agg(trim(sentence), ' ' ORDER BY ord) AS text FROM units GROUP BY item_id, unit""",
)
def n12(spark, sf):
    """Sentences; those that point back join the one before, and what is beyond the fourth unit joins it."""
    order = Window.partitionBy("item_id").orderBy("ord")
    unit = F.least(F.greatest(F.sum(F.when(F.col("back"), 0).otherwise(1)).over(order), F.lit(1)), F.lit(4)).cast("int")
    units = _sentences(Tables(spark, sf)).withColumn("unit", unit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.trim("sentence").alias("s")))), lambda x: x["s"]), " ")
    return units.groupBy("item_id", "unit").agg(joined.alias("text"))


@query("n14_propositions", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[.!?;]+'), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM documents")
def n14(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.size(tx.propositions(F.col("text"))).cast("long").alias("n"))


@query(
    "n15_negation_reach",
    f"""WITH c AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS clause, unnest(p) AS part FROM (SELECT doc_id, regexp_split_to_array({N('text')}, '[.!?;:]+') AS p FROM documents)),
    k AS (SELECT doc_id, clause, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, clause, {words_sql('part')} AS w FROM c)),
    m AS (SELECT doc_id, token, max(CASE WHEN token IN {_in(NEGATIONS)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, clause ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS neg FROM k)
    SELECT doc_id, CAST(sum(neg) AS BIGINT) AS negated, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY doc_id""",
)
def n15(spark, sf):
    clauses = F.transform(F.split(tx.normalize(F.col("text")), "[.!?;:]+"), tx.words)
    marks = F.flatten(F.transform(clauses, lambda w: tx.negation_marks(w, NEGATIONS, 6)))
    found = Tables(spark, sf).documents.select("doc_id", marks.alias("m")).filter(F.size("m") > 0)
    return found.select("doc_id", F.size(F.filter("m", lambda x: x)).cast("long").alias("negated"), F.size("m").cast("long").alias("n"))


@query(
    "n16_same_word",
    f"""WITH b AS (SELECT DISTINCT unnest({words_sql(N('text'))}) AS w FROM benchmark), d AS (SELECT DISTINCT unnest({words_sql(N('text'))}) AS w FROM documents)
    SELECT b.w AS word, CAST(count(*) AS BIGINT) AS n FROM b JOIN d ON length(b.w) >= 6 AND length(d.w) >= 6 AND left(b.w, 6) = left(d.w, 6) GROUP BY b.w""",
)
def n16(spark, sf):
    """Words of the benchmark with the documents' words that share their first six letters: an equi-join on the prefix."""
    t = Tables(spark, sf)
    known = lambda d: d.select(F.explode(tx.words(tx.normalize(F.col("text")))).alias("w")).distinct().filter(F.length("w") >= 6).withColumn("stem", F.substring("w", 1, 6))
    per_stem = known(t.documents).groupBy("stem").count()
    return known(t.benchmark).join(per_stem, "stem").select(F.col("w").alias("word"), F.col("count").alias("n"))


_REPLY = "trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))"


MEANING = f"""SELECT conv_id, turn, CASE WHEN {_REPLY} IN {_in(UNSURE)} THEN 'unknown' WHEN {_REPLY} IN {_in(YES)} THEN 'affirmative'
WHEN {_REPLY} IN {_in(NO)} OR regexp_matches({_REPLY}, '^(non|no)(\\b|\\s*[,;:.!?])') OR {' OR '.join(f"regexp_matches({_REPLY}, '" + d.replace("'", "''") + "')" for d in DENIALS)} THEN 'negative' ELSE 'ambiguous' END AS meaning
FROM conversations WHERE role = 'user'"""


@query("n17_classify_reply", MEANING)
def n17(spark, sf):
    meaning = tx.classify_reply(F.col("text"), YES, NO, UNSURE, DENIALS)
    return Tables(spark, sf).conversations.filter("role = 'user'").select("conv_id", "turn", meaning.alias("meaning"))


@query("n18_first_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',50 ' || CASE WHEN o_orderkey % 3 = 1 THEN '€' ELSE 'euros' END END AS amount FROM orders")
def n18(spark, sf):
    whole = F.floor("o_totalprice").cast("string")
    currency = F.when(F.col("o_orderkey") % 3 == 1, "€").when(F.col("o_orderkey") % 3 == 2, " euros").otherwise(" francs")
    text = F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(": paid "), whole, F.lit(",50"), currency, F.lit(", then 3 € more"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("no amount in x"), whole, F.lit("eur"))).otherwise(text)
    return Tables(spark, sf).orders.select("o_orderkey", tx.first_amount(text).alias("amount"))


@query("n19_fact_key", f"WITH {LINES} SELECT doc_id, seq, CASE WHEN length(line) <= 64 THEN line ELSE left(line, 47) || '-' || left(sha256(line), 16) END AS fact_key FROM lines")
def n19(spark, sf):
    return lines(Tables(spark, sf)).select("doc_id", "seq", tx.fact_key(F.col("line")).alias("fact_key"))


@query("n20_stable_uid", """SELECT doc_id, 'doc:' || sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS uid FROM documents""")
def n20(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", tx.stable_uid("doc", source=F.col("source"), lang=F.col("lang"), doc_id=F.col("doc_id")).alias("uid"))


@query("n21_quote_hash", f"SELECT item_id, sha256('2:' || {N('text')}) AS quote_hash FROM benchmark")
def n21(spark, sf):
    return Tables(spark, sf).benchmark.select("item_id", tx.quote_hash(tx.normalize(F.col("text"))).alias("quote_hash"))


@query(
    "n22_strip_identifiers",
    "SELECT o_orderkey, CAST(1 + (o_orderkey % 2) AS BIGINT) AS n, 'order and ' || o_orderpriority AS shown FROM orders",
)
def n22(spark, sf):
    """Block and node ids taken out of a text for display, and counted."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("order [blk:"), key, F.lit("] and "), F.when(key % 2 == 1, F.concat(F.lit("[blk:"), key + 1, F.lit("] "))).otherwise(""), F.col("o_orderpriority"))
    ids = r"\[blk:\d+\]\s*"
    return Tables(spark, sf).orders.select(key, F.regexp_count(text, F.lit(ids)).cast("long").alias("n"), F.regexp_replace(text, ids, "").alias("shown"))


@query(
    "n23_expand_articles",
    "SELECT DISTINCT l_linenumber AS a, CAST(l_quantity AS BIGINT) % 5 AS lo, CAST(l_tax * 100 AS BIGINT) AS hi, CASE WHEN CAST(l_quantity AS BIGINT) % 5 <= CAST(l_tax * 100 AS BIGINT) AND CAST(l_tax * 100 AS BIGINT) - CAST(l_quantity AS BIGINT) % 5 < 4 THEN array_to_string(list_transform(range(CAST(l_quantity AS BIGINT) % 5, CAST(l_tax * 100 AS BIGINT) + 1), lambda x: l_linenumber || '.' || x), ',') END AS members FROM lineitem",
)
def n23(spark, sf):
    cells = Tables(spark, sf).lineitem.select(F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("long") % 5).alias("lo"), F.round(F.col("l_tax") * 100).cast("long").alias("hi")).distinct()
    article = F.concat("a", F.lit("."), "lo", F.lit("-"), "a", F.lit("."), "hi")
    return cells.select("a", "lo", "hi", F.array_join(tx.expand_articles(article, 4), ",").alias("members"))


@query(
    "n24_request_fragments",
    "SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '(?i)\\s+(?:et|puis|ainsi que|avec)\\s+|[,;]|\\bet/ou\\b'), lambda x: trim(x)), lambda x: length(x) > 2), '|') AS parts FROM conversations WHERE role = 'user'",
)
def n24(spark, sf):
    return Tables(spark, sf).conversations.filter("role = 'user'").select("conv_id", "turn", F.array_join(tx.request_fragments(F.col("text")), "|").alias("parts"))


@query(
    "n25_browser_words",
    f"SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'), ' +'), lambda x: length(x) > 2 AND NOT list_contains({_list(STOP)}, x)), ' ') AS tokens FROM conversations",
)
def n25(spark, sf):
    return Tables(spark, sf).conversations.select("conv_id", "turn", F.array_join(tx.browser_words(F.col("text"), STOP), " ").alias("tokens"))


@query(
    "n26_summary",
    """WITH h AS (SELECT item_id, trim(text) AS t, left(trim(text), 120) AS h, instr(reverse(left(trim(text), 120)), ' .') AS d, instr(reverse(left(trim(text), 120)), ' ') AS s FROM benchmark)
    SELECT item_id, CASE WHEN length(t) <= 120 THEN t WHEN d > 0 AND length(h) - d > 61 THEN left(h, length(h) - d) ELSE left(h, CASE WHEN s > 0 THEN length(h) - s ELSE length(h) - 1 END) || '…' END AS summary FROM h""",
)
def n26(spark, sf):
    return Tables(spark, sf).benchmark.select("item_id", tx.summary(F.col("text"), 120).alias("summary"))


@query("n27_readable_title", f"WITH {LINES} SELECT doc_id, upper(left(t, 1)) || substr(t, 2) AS title FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(line), '\\s+', ' ', 'g')), '[ .:;,]+$', '') AS t FROM lines WHERE seq = 1)")
def n27(spark, sf):
    return lines(Tables(spark, sf)).filter("seq = 1").select("doc_id", tx.readable_title(F.col("line")).alias("title"))


@query("n28_language_code", "SELECT doc_id, CASE WHEN lower(trim(lang)) IN ('fr', 'de', 'en') THEN lower(trim(lang)) ELSE 'fr' END AS code, NOT coalesce(lower(trim(lang)) IN ('fr', 'de', 'en'), false) AS fell_back FROM documents")
def n28(spark, sf):
    code, back = tx.language_code(F.col("lang"), ("fr", "de", "en"), "fr")
    return Tables(spark, sf).documents.select("doc_id", code.alias("code"), back.alias("fell_back"))
