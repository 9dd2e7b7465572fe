"""Retrieval, ranking and thesaurus queries: benchmark items ask, lines of documents answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import search
from docloom.plans.base import LINES, TOKENS, Tables, block_id, line_words, lines, norm_sql, query, tokens, words_sql
from docloom.scratch import Rounds
from docloom.session import spread

N = norm_sql

_BLOCK = "lpad(CAST(doc_id AS VARCHAR), 12, '0') || ':' || lpad(CAST(seq AS VARCHAR), 5, '0')"
INDEX = f"{LINES}, {TOKENS}, idx AS (SELECT source AS corpus, {_BLOCK} AS block, token, n_tokens FROM tokens), df AS (SELECT corpus, token, count(*) AS df FROM idx GROUP BY corpus, token)"
FORMS = f"""qw AS (SELECT item_id AS question, unnest(w) AS token, len(w) AS question_size FROM (SELECT item_id, list_distinct({words_sql(N('text'))}) AS w FROM benchmark)),
  props AS (SELECT item_id AS question, CAST(unnest(generate_series(1, len(p))) AS INT) AS "group", unnest(p) AS part FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[.!?;]+'), lambda x: trim(x) <> '') AS p FROM benchmark)),
  forms AS (SELECT question, "group", 1 AS form, unnest(w) AS token, len(w) AS form_size FROM (SELECT question, "group", list_distinct({words_sql(N('part'))}) AS w FROM props))"""
SCORES = """hits AS (SELECT question, "group", form, form_size, i.corpus, block, n_tokens, count(*) AS met, min(df) AS rarest FROM idx i JOIN forms f ON f.token = i.token JOIN df d ON d.corpus = i.corpus AND d.token = i.token GROUP BY ALL),
  weights AS (SELECT question, "group", form, corpus, sum(1.0 / CAST(df AS DOUBLE)) AS weight FROM forms f JOIN df d ON d.token = f.token GROUP BY ALL),
  per_group AS (SELECT h.question, h."group", h.corpus, block, max(CASE WHEN met = form_size THEN 1 ELSE 0 END) AS whole, max(CASE WHEN met = form_size AND form_size > 1 THEN CAST(form_size AS DOUBLE) / n_tokens ELSE 0 END) AS density, max(1.0 / CAST(rarest AS DOUBLE) / weight) AS hit
    FROM hits h JOIN weights w ON w.question = h.question AND w."group" = h."group" AND w.form = h.form AND w.corpus = h.corpus GROUP BY ALL),
  n_groups AS (SELECT question, count(DISTINCT "group") AS groups FROM forms GROUP BY question),
  per_block AS (SELECT question, corpus, block, CAST(sum(whole) AS BIGINT) AS "full", max(density) AS density, sum(hit) AS hits FROM per_group GROUP BY ALL),
  covered AS (SELECT question, corpus, block, CAST(count(*) AS DOUBLE) / any_value(question_size) AS coverage FROM idx i JOIN qw q ON q.token = i.token GROUP BY ALL),
  scored AS (SELECT p.question, p.corpus, p.block, "full", round(CASE WHEN "full" = 0 THEN hits / groups ELSE 0 END, 9) AS partial, round(density, 9) AS precision, round(coalesce(coverage, 0), 9) AS coverage
    FROM per_block p JOIN n_groups g ON g.question = p.question LEFT JOIN covered c ON c.question = p.question AND c.corpus = p.corpus AND c.block = p.block),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY "full" DESC, partial DESC, precision DESC, coverage DESC, corpus, block) AS INT) AS rank FROM scored)"""


def index(t: Tables) -> DataFrame:
    return tokens(t).select(F.col("source").alias("corpus"), block_id().alias("block"), "token", "n_tokens")


def sets(t: Tables) -> DataFrame:
    """corpus, block, words: the distinct words of every line that has any."""
    return line_words(t).select(F.col("source").alias("corpus"), block_id().alias("block"), "words")


def asked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Forms and words of every question: each proposition of an item is a group with one form."""
    found = F.array_distinct(tx.words(tx.normalize(F.col("part"))))
    parts = t.benchmark.select(F.col("item_id").alias("question"), F.posexplode(tx.propositions(F.col("text"))).alias("group", "part"))
    forms = parts.select("question", (F.col("group") + 1).alias("group"), F.lit(1).alias("form"), found.alias("w")).select("question", "group", "form", F.size("w").alias("form_size"), F.explode("w").alias("token"))
    whole = t.benchmark.select(F.col("item_id").alias("question"), F.array_distinct(tx.words(tx.normalize(F.col("text")))).alias("w"))
    return forms, whole.select("question", F.size("w").alias("question_size"), F.explode("w").alias("token"))


@query("r1_document_frequency", f"WITH {INDEX} SELECT corpus, token, df FROM df")
def r1(spark, sf):
    return search.document_frequency(index(Tables(spark, sf)))


@query("r2_ranked_search", f'WITH {INDEX}, {FORMS}, {SCORES} SELECT question, corpus, block, "full", partial, precision, coverage, rank FROM ranked WHERE rank <= 20')
def r2(spark, sf):
    """R2-R6: every item searches the lines of all sources; twenty best."""
    t = Tables(spark, sf)
    return search.ranked(sets(t), *asked(t), 20)


@query(
    "r3_group_dedupe",
    f"""WITH {FORMS}, keyed AS (SELECT question, "group", array_to_string(list_sort(list(token)), ' ') AS form_set FROM forms GROUP BY question, "group")
    SELECT question, form_set, min("group") AS "group" FROM keyed GROUP BY question, form_set""",
)
def r3(spark, sf):
    """Groups with the same set of words are one; the first keeps its place."""
    forms, _ = asked(Tables(spark, sf))
    keyed = forms.groupBy("question", "group").agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("form_set"))
    return keyed.groupBy("question", "form_set").agg(F.min("group").alias("group"))


@query("r7_score_clause", f"WITH {INDEX}, {FORMS} SELECT question, corpus, block, round(CAST(count(*) AS DOUBLE) / any_value(question_size), 9) AS coverage FROM idx i JOIN qw q ON q.token = i.token GROUP BY question, corpus, block HAVING count(*) * 2 >= any_value(question_size)")
def r7(spark, sf):
    """Clauses scored by question coverage alone; designated are those with half of a question's words."""
    t = Tables(spark, sf)
    _, words = asked(t)
    found = search.overlapping(Rounds(spark, "coverage").keep(sets(t)), words.select("question", "token"), ["corpus", "block"], "question")
    return found.select("question", "corpus", "block", F.round(F.col("shared") / F.col("size"), 9).alias("coverage"))


@query("r8_block_share", f"WITH {INDEX}, n AS (SELECT source AS corpus, count(*) AS n FROM lines GROUP BY source) SELECT d.corpus, token, round(CAST(df AS DOUBLE) / n, 9) AS share FROM df d JOIN n ON n.corpus = d.corpus WHERE df >= 5")
def r8(spark, sf):
    t = Tables(spark, sf)
    totals = lines(t).groupBy(F.col("source").alias("corpus")).agg(F.count("*").alias("n"))
    return search.document_frequency(index(t)).filter("df >= 5").join(totals, "corpus").select("corpus", "token", F.round(F.col("df") / F.col("n"), 9).alias("share"))


@query(
    "r10_r11_contents_page",
    f"""WITH {LINES}, e AS (SELECT source, doc_id, line AS title FROM lines WHERE seq = 1),
    s AS (SELECT source, CAST(floor(sum(length(CAST(doc_id AS VARCHAR)) + length(title)) / count(*)) AS BIGINT) + 48 AS cost FROM e GROUP BY source),
    o AS (SELECT e.source, doc_id, left(title, 40) AS title, row_number() OVER (PARTITION BY e.source ORDER BY doc_id) AS ord, CAST(floor(6000 / cost) AS BIGINT) AS page FROM e JOIN s ON s.source = e.source)
    SELECT source, doc_id, title, ord FROM o WHERE ord > page AND ord <= 2 * page""",
)
def r10(spark, sf):
    """The second page of each source's contents; a page's length follows from the mean size of its entries."""
    entries = lines(Tables(spark, sf)).filter("seq = 1").select("source", "doc_id", F.col("line").alias("title"))
    size = F.length(F.col("doc_id").cast("string")) + F.length("title")
    cost = entries.groupBy("source").agg((F.floor(F.sum(size) / F.count("*")) + 48).alias("cost"))
    numbered = entries.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")).join(cost, "source").withColumn("page", F.floor(F.lit(6000) / F.col("cost")))
    return numbered.filter("ord > page and ord <= 2 * page").select("source", "doc_id", F.substring("title", 1, 40).alias("title"), "ord")


@query(
    "r12_node_window",
    f"""WITH {LINES}, o AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS ord, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)
    SELECT doc_id, seq, CAST(ord AS BIGINT) AS ord, CASE WHEN (floor((n - 1) / 2 / 3) + 1) * 3 < n THEN CAST((floor((n - 1) / 2 / 3) + 1) * 3 AS BIGINT) END AS next_cursor FROM (SELECT *, floor((n - 1) / 2) AS focus FROM o) WHERE floor(ord / 3) = floor(focus / 3)""".replace("(n - 1) / 2 / 3", "focus / 3"),
)
def r12(spark, sf):
    """The window of three blocks, aligned to multiples, that holds a document's middle block."""
    per = Window.partitionBy("doc_id")
    o = lines(Tables(spark, sf)).select("doc_id", "seq", (F.row_number().over(per.orderBy("seq")) - 1).cast("long").alias("ord"), F.count("*").over(per).alias("n"))
    o = o.withColumn("page", F.floor(F.floor((F.col("n") - 1) / 2) / 3)).filter(F.floor(F.col("ord") / 3) == F.col("page"))
    after = (F.col("page") + 1) * 3
    return o.select("doc_id", "seq", "ord", F.when(after < F.col("n"), after).alias("next_cursor"))


_PAIRS = "pairs AS (SELECT a.doc_id, a.seq AS a, b.seq AS b FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND b.seq > a.seq AND b.seq <= a.seq + 3)"


@query(
    "r14_limiting_clauses",
    f"""WITH {LINES}, {TOKENS}, sets AS (SELECT doc_id, seq, list(token) AS s FROM tokens GROUP BY doc_id, seq),
    p AS (SELECT a.doc_id, a.seq AS target, b.seq AS clause, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))), 9) AS similarity FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND b.seq > a.seq AND b.seq <= a.seq + 5),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, target ORDER BY similarity DESC, clause) AS INT) AS place FROM p WHERE similarity >= 0.2) SELECT * FROM r WHERE place <= 3""",
)
def r14(spark, sf):
    """For each line the three most similar of the five that follow, by the Jaccard index of their words."""
    near = search.next_alike(spread(Tables(spark, sf).documents.select("doc_id", "text")), 5, 0.2, 3)
    return near.select("doc_id", "target", "clause", "similarity", "place")


_STOPS = ("the", "and", "of", "to", "in", "a", "de", "la", "le", "der", "die", "und", "que", "el", "en")
_STOPS_SQL = "(" + ", ".join(f"'{x}'" for x in _STOPS) + ")"


@query("r17_positive_score", f"WITH {INDEX}, {FORMS} SELECT question, block FROM idx i JOIN qw q ON q.token = i.token WHERE i.token NOT IN {_STOPS_SQL} GROUP BY question, block HAVING count(*) >= 3")
def r17(spark, sf):
    """Question and clause pairs that share at least three words outside the stop list."""
    t = Tables(spark, sf)
    _, words = asked(t)
    shared = index(t).filter(~F.col("token").isin(*_STOPS)).join(words, "token")
    return shared.groupBy("question", "block").agg(F.count("*").alias("n")).filter("n >= 3").select("question", "block")


# Cards are documents: the first line is the title, the items' longer words are what is asked for.
_TERMS = f"""terms AS (SELECT DISTINCT item_id AS ask, unnest(list_filter({words_sql(N('text'))}, lambda x: length(x) > 5)) AS term FROM benchmark), sizes AS (SELECT ask, count(*) AS terms FROM terms GROUP BY ask)"""
_HITS = f"""{LINES}, {TOKENS}, {_TERMS}, held AS (SELECT doc_id AS key, token, bool_or(seq = 1) AS head FROM tokens GROUP BY doc_id, token),
  met AS (SELECT t.term, v.token FROM (SELECT DISTINCT term FROM terms) t JOIN (SELECT DISTINCT token FROM held) v ON contains(v.token, t.term)),
  hits AS (SELECT term, key, bool_or(head) AS head FROM held JOIN met ON met.token = held.token GROUP BY term, key)"""


def terms_of(t: Tables) -> DataFrame:
    """ask, term: the distinct words of six letters or more of every item."""
    words = F.array_distinct(F.filter(tx.words(tx.normalize(F.col("text"))), lambda x: F.length(x) > 5))
    return t.benchmark.select(F.col("item_id").alias("ask"), F.explode(words).alias("term"))


def card_hits(t: Tables) -> DataFrame:
    """ask, term, key (document), head (whether in its first line) for every term that a document contains."""
    terms = terms_of(t)
    held = tokens(t).select(F.col("doc_id").alias("key"), "token", (F.col("seq") == 1).alias("head"))
    return terms.join(search.term_hits(held, terms), "term")


def _first(scored: DataFrame, score: str, most: int = 1) -> DataFrame:
    """The best of each ask by score, the first key of equals."""
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc(score), "key"))
    return scored.withColumn("place", place).filter(F.col("place") <= most)


@query(
    "r18_card_search",
    f"""WITH {_HITS}, s AS (SELECT ask, key AS doc_id, CAST(sum(CASE WHEN head THEN 5 ELSE 2 END) AS BIGINT) AS score FROM terms JOIN hits ON hits.term = terms.term GROUP BY ask, key),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id) AS INT) AS place FROM s) SELECT * FROM r WHERE place <= 3""",
)
def r18(spark, sf):
    """Cards scored 5 for a term in the title, else 2 for one in the body; three best, the first of equals."""
    scored = card_hits(Tables(spark, sf)).groupBy("ask", "key").agg(F.sum(F.when(F.col("head"), 5).otherwise(2)).alias("score"))
    return _first(scored, "score", 3).withColumnRenamed("key", "doc_id")


@query(
    "r19_best_answer",
    f"""WITH {_HITS}, s AS (SELECT ask, key, round(CAST(count(*) AS DOUBLE) / any_value(sizes.terms), 9) AS share FROM terms JOIN hits ON hits.term = terms.term JOIN sizes USING (ask) GROUP BY ask, key),
    r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY share DESC, key) AS place FROM s WHERE share >= 0.5) SELECT ask, key AS best, share FROM r WHERE place = 1""",
)
def r19(spark, sf):
    """The card that holds the largest part of the terms, the first of equals, if it holds at least half."""
    t = Tables(spark, sf)
    sizes = terms_of(t).groupBy("ask").agg(F.count("*").alias("terms"))
    met = card_hits(t).groupBy("ask", "key").agg(F.count("*").alias("met")).join(sizes, "ask")
    shares = met.select("ask", "key", F.round(F.col("met") / F.col("terms"), 9).alias("share")).filter("share >= 0.5")
    return _first(shares, "share").select("ask", F.col("key").alias("best"), "share")


@query(
    "r21_weighted_criterion",
    f"""WITH {_HITS}, s AS (SELECT ask, key, round((count(*) + 0.4 * count(*) FILTER (length(terms.term) > 8)) * CASE WHEN any_value(lang) = 'en' THEN 1.15 ELSE 1 END, 9) AS score FROM terms JOIN hits ON hits.term = terms.term JOIN documents ON doc_id = key GROUP BY ask, key),
    r AS (SELECT ask, key AS doc_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY ask ORDER BY score DESC, key) AS place FROM s WHERE score >= 1.15) SELECT ask, doc_id, score FROM r WHERE place = 1""",
)
def r21(spark, sf):
    """Hits weighted by the term's length (1.4 from nine letters on), one kind of card (English) favoured; the first maximum from 1.15 on."""
    t = Tables(spark, sf)
    met = card_hits(t).groupBy("ask", "key").agg(F.count("*").alias("n"), F.count_if(F.length("term") > 8).alias("long"))
    kinds = t.documents.select(F.col("doc_id").alias("key"), F.when(F.col("lang") == "en", 1.15).otherwise(1.0).alias("factor"))
    scored = met.join(kinds, "key").withColumn("score", F.round((F.col("n") + 0.4 * F.col("long")) * F.col("factor"), 9)).filter("score >= 1.15")
    return _first(scored, "score").select("ask", F.col("key").alias("doc_id"), "score")


@query("r23_exact_question", f"WITH k AS (SELECT doc_id, {N('text')} AS form FROM documents) SELECT form_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT min(doc_id) OVER (PARTITION BY form) AS form_id FROM k) GROUP BY form_id HAVING count(*) > 1")
def r23(spark, sf):
    """Texts with the same normalised form, by an equality join on its digest."""
    keyed = Tables(spark, sf).documents.select("doc_id", F.sha2(tx.normalize(F.col("text")).cast("binary"), 256).alias("form"))
    return keyed.groupBy("form").agg(F.min("doc_id").alias("form_id"), F.count("*").alias("n")).filter("n > 1").select("form_id", "n")


# Thesaurus: a brand is a group whose canonical form is its most frequent part name, its variants the others.
_THESAURUS = """uses AS (SELECT p_brand AS grp, p_name AS form, count(*) AS n FROM part GROUP BY p_brand, p_name),
  claims AS (SELECT grp, form, row_number() OVER (PARTITION BY grp ORDER BY n DESC, form) = 1 AS canonical FROM uses),
  owned AS (SELECT form, CASE WHEN count(*) FILTER (canonical) = 1 THEN max(CASE WHEN canonical THEN grp END) WHEN count(*) FILTER (canonical) = 0 AND count(DISTINCT grp) = 1 THEN max(grp) END AS owner, CAST(count(DISTINCT grp) AS BIGINT) AS claimants FROM claims GROUP BY form)"""


def claims(t: Tables) -> DataFrame:
    uses = t.part.groupBy(F.col("p_brand").alias("grp"), F.col("p_name").alias("form")).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "form"))
    return uses.select("grp", "form", (first == 1).alias("canonical"))


def owned_forms(claimed: DataFrame) -> DataFrame:
    """form, owner, claimants: a form belongs to the group that has it as canonical, else to its only claimant, else to none."""
    sole = F.count_if("canonical")
    groups = F.countDistinct("grp")
    owner = F.when(sole == 1, F.max(F.when(F.col("canonical"), F.col("grp")))).when((sole == 0) & (groups == 1), F.max("grp"))
    return claimed.groupBy("form").agg(owner.alias("owner"), groups.alias("claimants"))


@query("q1_form_ownership", f"WITH {_THESAURUS} SELECT form, owner, claimants FROM owned")
def q1(spark, sf):
    return owned_forms(claims(Tables(spark, sf)))


@query("q2_expand", f"WITH {_THESAURUS} SELECT p_partkey, o.owner, c.form AS variant FROM part p JOIN owned o ON o.form = p.p_name JOIN claims c ON c.grp = o.owner WHERE c.form <> p.p_name")
def q2(spark, sf):
    """Every part's name asks; the other forms of the group that owns it are added."""
    t = Tables(spark, sf)
    claimed = claims(t)
    asked_names = t.part.select("p_partkey", F.col("p_name").alias("form"))
    hits = asked_names.join(owned_forms(claimed).filter("owner is not null").select("form", "owner"), "form")
    variants = claimed.select(F.col("grp").alias("owner"), F.col("form").alias("variant"))
    return hits.join(variants, "owner").filter("variant <> form").select("p_partkey", "owner", "variant")


@query(
    "q3_q7_number_key",
    """WITH names AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part), known AS (SELECT word FROM names UNION SELECT word || 's' FROM names WHERE length(word) = 4),
    cand AS (SELECT word AS asked, word AS form, 0 AS priority FROM known UNION ALL SELECT word, CASE WHEN right(word, 1) IN ('s', 'x') THEN left(word, length(word) - 1) ELSE word || 's' END, 1 FROM known)
    SELECT asked, arg_min(form, priority) AS key FROM cand WHERE form IN (SELECT word FROM names) GROUP BY asked""",
)
def q3(spark, sf):
    """A term is looked up as it is, else in its other number; the first that is known wins."""
    names = Tables(spark, sf).part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")).distinct()
    asked_words = names.union(names.filter(F.length("word") == 4).select(F.concat("word", F.lit("s")))).distinct()
    candidates = asked_words.select(F.col("word").alias("asked"), F.explode(F.array(F.struct(F.lit(0).alias("priority"), F.col("word").alias("form")), F.struct(F.lit(1).alias("priority"), tx.other_number(F.col("word")).alias("form")))).alias("c")).select("asked", "c.*")
    return candidates.join(names.withColumnRenamed("word", "form"), "form", "left_semi").groupBy("asked").agg(F.min_by("form", "priority").alias("key"))


@query("q4_variant_counts", f"WITH {_THESAURUS} SELECT c.grp, CAST(count(*) FILTER (o.owner IS NULL) AS BIGINT) AS ambiguous, CAST(count(*) FILTER (o.owner = c.grp AND NOT canonical) AS BIGINT) AS variants FROM claims c JOIN owned o ON o.form = c.form GROUP BY c.grp")
def q4(spark, sf):
    claimed = claims(Tables(spark, sf))
    joined = claimed.join(owned_forms(claimed).select("form", "owner"), "form")
    return joined.groupBy("grp").agg(F.count_if(F.col("owner").isNull()).alias("ambiguous"), F.count_if((F.col("owner") == F.col("grp")) & ~F.col("canonical")).alias("variants"))


@query("q5_canonical_form", f"WITH {_THESAURUS} SELECT p_partkey, coalesce(c.form, p_name) AS canonical FROM part LEFT JOIN owned o ON o.form = p_name LEFT JOIN claims c ON c.grp = o.owner AND c.canonical")
def q5(spark, sf):
    t = Tables(spark, sf)
    claimed = claims(t)
    heads = claimed.filter("canonical").select(F.col("grp").alias("owner"), F.col("form").alias("head"))
    lookup = owned_forms(claimed).join(heads, "owner").select("form", "head")
    return t.part.join(lookup, F.col("p_name") == F.col("form"), "left").select("p_partkey", F.coalesce("head", "p_name").alias("canonical"))


@query("q6_confirmed_intent", f"WITH {_TERMS}, w AS (SELECT doc_id, unnest(list_distinct({words_sql(N('text'))})) AS token FROM documents) SELECT w.doc_id, t.ask AS item_id, CAST(count(*) AS BIGINT) AS met, CAST(any_value(terms) AS BIGINT) AS known FROM terms t JOIN w ON w.token = t.term JOIN sizes k ON k.ask = t.ask GROUP BY w.doc_id, t.ask HAVING count(*) * 2 >= any_value(terms)")
def q6(spark, sf):
    """Triggers (an item's longer words) that a text holds as whole words, against those known; from half on."""
    t = Tables(spark, sf)
    terms = terms_of(t).select(F.col("ask").alias("item_id"), F.col("term").alias("token"))
    held = spread(t.documents.select("doc_id", "text")).select("doc_id", F.array_distinct(tx.words(tx.normalize(F.col("text")))).alias("words"))
    found = search.overlapping(Rounds(spark, "intents").keep(held), terms, ["doc_id"], "item_id")
    return found.select("doc_id", "item_id", F.col("shared").alias("met"), F.col("size").alias("known"))


@query("q8_bounded_share", f"WITH {INDEX}, n AS (SELECT source AS corpus, count(*) AS n FROM lines GROUP BY source) SELECT d.corpus, token, CASE WHEN 0.01 * n < 1 THEN NULL ELSE CAST(df AS DOUBLE) / n <= 0.01 END AS admitted FROM df d JOIN n ON n.corpus = d.corpus WHERE df >= 2")
def q8(spark, sf):
    """Whether a word is rare enough to expand with; no judgement where a hundredth of the blocks is less than one."""
    t = Tables(spark, sf)
    totals = lines(t).groupBy(F.col("source").alias("corpus")).agg(F.count("*").alias("n"))
    share = F.col("df") / F.col("n")
    return search.document_frequency(index(t)).filter("df >= 2").join(totals, "corpus").select("corpus", "token", F.when(F.lit(0.01) * F.col("n") < 1, F.lit(None)).otherwise(share <= 0.01).alias("admitted"))


@query(
    "q9_term_admission",
    f"""WITH {LINES}, k AS (SELECT doc_id, {N('line')} AS t FROM lines),
    m AS (SELECT CASE WHEN t = '' THEN 'blank' WHEN length(t) > 400 THEN 'too long' WHEN len({words_sql('t')}) > 40 THEN 'too many words' WHEN len({words_sql('t')}) = 0 THEN 'no word' ELSE 'admitted' END AS motive FROM k) SELECT motive, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY motive""",
)
def q9(spark, sf):
    terms = lines(Tables(spark, sf)).select(tx.normalize(F.col("line")).alias("t"))
    n = F.size(tx.words(F.col("t")))
    motive = F.when(F.col("t") == "", "blank").when(F.length("t") > 400, "too long").when(n > 40, "too many words").when(n == 0, "no word").otherwise("admitted")
    return terms.groupBy(motive.alias("motive")).agg(F.count("*").alias("n"))


@query("r16_target_definitions", f"WITH {_THESAURUS}, target AS (SELECT grp, list_last(string_split(form, ' ')) AS word FROM claims WHERE canonical) SELECT c.grp, c.form FROM claims c JOIN owned o ON o.form = c.form AND o.owner = c.grp JOIN target t ON t.grp = c.grp WHERE contains(' ' || c.form || ' ', ' ' || t.word || ' ')")
def r16(spark, sf):
    """Of the forms that a group owns, those that define its target, the last word of its canonical form, as a whole word."""
    claimed = claims(Tables(spark, sf))
    own = owned_forms(claimed).filter("owner is not null").select("form", F.col("owner").alias("grp"))
    target = claimed.filter("canonical").select("grp", F.concat(F.lit(" "), F.element_at(F.split("form", " "), -1), F.lit(" ")).alias("word"))
    return claimed.join(own, ["grp", "form"]).join(target, "grp").filter(F.contains(F.concat(F.lit(" "), "form", F.lit(" ")), "word")).select("grp", "form")


@query(
    "r20_answer_list",
    f"""WITH {_TERMS}, faq AS (SELECT q.conv_id || ':' || q.turn AS key, {words_sql(N('q.text'))} AS question, {words_sql(N("coalesce(a.text, '')"))} AS answer FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'),
    held AS (SELECT key, token, bool_or(head) AS head FROM (SELECT key, unnest(question) AS token, true AS head FROM faq UNION ALL SELECT key, unnest(answer), false FROM faq) GROUP BY key, token),
    met AS (SELECT t.term, v.token FROM (SELECT DISTINCT term FROM terms) t JOIN (SELECT DISTINCT token FROM held) v ON contains(v.token, t.term)),
    hits AS (SELECT term, key, bool_or(head) AS head FROM held JOIN met ON met.token = held.token GROUP BY term, key),
    s AS (SELECT ask, key, CAST(sum(CASE WHEN head THEN 3 ELSE 1 END) AS BIGINT) AS score FROM terms JOIN hits ON hits.term = terms.term GROUP BY ask, key HAVING sum(CASE WHEN head THEN 3 ELSE 1 END) >= 3),
    r AS (SELECT ask, key, score, CAST(row_number() OVER (PARTITION BY ask ORDER BY score DESC, key) AS INT) AS place FROM s) SELECT * FROM r WHERE place <= 5""",
)
def r20(spark, sf):
    """Questions (user turns) and their answers: 3 for a term in the question, else 1 for one in the answer; from 3 points on, five best."""
    t = Tables(spark, sf)
    words = lambda c: F.array_distinct(tx.words(tx.normalize(F.col(c))))
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    questions = turns.filter("role = 'user'")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key")
    part = lambda rows, column, head: rows.select(key, F.explode(words(column)).alias("token"), F.lit(head).alias("head"))
    held = part(questions, "text", True).unionByName(part(questions.join(answers, ["conv_id", "turn"]), "answer", False))
    terms = terms_of(t)
    hits = terms.join(search.term_hits(held, terms), "term")
    scored = hits.groupBy("ask", "key").agg(F.sum(F.when(F.col("head"), 3).otherwise(1)).alias("score")).filter("score >= 3")
    return _first(scored, "score", 5)


@query(
    "r22_best_scenario",
    f"""WITH {_HITS}, s AS (SELECT ask, key, count(*) AS hits, any_value(sizes.terms) AS terms FROM terms JOIN hits ON hits.term = terms.term JOIN sizes USING (ask) WHERE head GROUP BY ask, key),
    r AS (SELECT ask, key, CAST(hits AS BIGINT) AS hits, row_number() OVER (PARTITION BY ask ORDER BY hits DESC, key) AS place FROM s WHERE hits >= 2 OR terms = 1) SELECT ask, key AS best, hits FROM r WHERE place = 1""",
)
def r22(spark, sf):
    """The title with most of the terms, the first of equals, if it has at least two, or one where one is asked for."""
    t = Tables(spark, sf)
    sizes = terms_of(t).groupBy("ask").agg(F.count("*").alias("terms"))
    counted = card_hits(t).filter("head").groupBy("ask", "key").agg(F.count("*").alias("hits")).join(sizes, "ask")
    return _first(counted.filter("hits >= 2 or terms = 1"), "hits").select("ask", F.col("key").alias("best"), "hits")


@query(
    "n29_nearest_themes",
    f"""WITH {_HITS}, heads AS (SELECT DISTINCT source, doc_id FROM lines WHERE seq = 1), n AS (SELECT ask, key, count(*) AS score FROM terms JOIN hits ON hits.term = terms.term WHERE head GROUP BY ask, key),
    r AS (SELECT sizes.ask, source, doc_id, CAST(coalesce(score, 0) AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY sizes.ask, source ORDER BY coalesce(score, 0) DESC, doc_id) AS INT) AS pos FROM sizes CROSS JOIN heads LEFT JOIN n ON n.ask = sizes.ask AND n.key = doc_id) SELECT * FROM r WHERE pos <= 3""",
)
def n29(spark, sf):
    """Headings by how many of an item's terms they contain; three a source, filled up from its first ones.

    Only the first three headings of a source can fill up, so that many are added to an ask's hits, and no more.
    """
    t = Tables(spark, sf)
    heads = lines(t).filter("seq = 1").select("source", F.col("doc_id").alias("key")).distinct()
    found = card_hits(t).filter("head").groupBy("ask", "key").agg(F.count("*").alias("score")).join(heads, "key")
    first = heads.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy("key"))).filter("at <= 3").drop("at")
    filling = terms_of(t).select("ask").distinct().join(F.broadcast(first), F.lit(True)).withColumn("score", F.lit(0).cast("long"))  # three rows a source
    every = found.select("ask", "source", "key", "score").unionByName(filling.select("ask", "source", "key", "score")).groupBy("ask", "source", "key").agg(F.max("score").alias("score"))
    pos = F.row_number().over(Window.partitionBy("ask", "source").orderBy(F.desc("score"), "key"))
    return every.withColumn("pos", pos).filter("pos <= 3").withColumnRenamed("key", "doc_id")
