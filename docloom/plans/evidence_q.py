"""Evidence checks: quotes against texts, merging, negation, coverage, dominance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import search
from docloom.plans.base import LINES, Tables, lines, norm_sql, query, words_sql
from docloom.plans.text_q import NEGATIONS, _in
from docloom.scratch import Rounds
from docloom.session import spread

N = norm_sql
#: What a word goes on with: letters and numbers of any script.
_WORD_SIGNS = r"[\p{L}\p{N}]*"


def _grams(text, begins: str):
    """The distinct runs of one, two and three characters of a text that begin with a character of a class."""
    at = F.sequence(F.lit(1), F.length(text))
    some = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.filter(at, lambda i: (i + n - 1 <= F.length(text)) & F.substring(text, i, F.lit(1)).rlike(begins)), lambda i: F.substring(text, i, n)))
    return F.array_distinct(F.flatten(some))


def _wordless(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, item_id: texts (doc_id, norm) that hold the rarest run of three characters of a quote without a Latin word (of a shorter quote, all of it).

    Runs begin with a character beyond ASCII, so that texts without one are passed over; quotes of ASCII signs alone
    have runs of their own, for which all texts are read if there is such a quote.
    """
    out = None
    for kind, begins in ((F.col("quote").rlike(r"[^\x00-\x7F]"), r"[^\x00-\x7F]"), (~F.col("quote").rlike(r"[^\x00-\x7F]"), r"[\x00-\x7F]")):
        mine = quotes.filter((F.col("quote") != "") & kind)
        if not mine.take(1):
            continue
        size = F.least(F.lit(3), F.length("quote"))
        runs = mine.select("item_id", size.alias("size"), F.explode(_grams(F.col("quote"), begins)).alias("gram"))
        # a quote that has such a character only at its end has no run of three that begins with one
        longest = Window.partitionBy("item_id")
        runs = runs.withColumn("most", F.max(F.length("gram")).over(longest)).filter(F.length("gram") == F.col("most")).select("item_id", "gram")
        held = spread(texts).filter(F.col("norm").rlike(begins)).select("doc_id", F.explode(_grams(F.col("norm"), begins)).alias("gram")).join(runs.select("gram").distinct(), "gram", "left_semi")
        df = held.groupBy("gram").agg(F.count("*").alias("df"))
        rarest = runs.join(df, "gram", "left").groupBy("item_id").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("gram"))
        found = held.join(rarest, "gram").select("doc_id", "item_id")
        out = found if out is None else out.unionByName(found)
    return out


def quote_places(items: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id, start, length, norm: where each quote stands in a text, by an exact match in normalised form.

    Texts meet quotes on a word of the quote that few texts hold, so that the containment test runs on candidates;
    only the texts of candidates are normalised again. The first and last word of a quote may be parts of longer
    words in a text: quotes without a word between them meet on the words that contain their longest one. Quotes
    without a word are found nowhere.
    """
    quotes = items.select("item_id", tx.normalize(F.col("text")).alias("quote"))
    quotes = quotes.withColumn("w", tx.words(F.col("quote")))
    # kept, as three joins read it and texts are costly to normalise
    held = Rounds(documents.sparkSession, "held").keep(spread(documents.select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(tx.words(tx.normalize(F.col("text"))))).alias("token")))
    asked = quotes.filter(F.size("w") > 2).select("item_id", F.explode(F.array_distinct(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))).alias("token"))
    frequency = held.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    rarest = asked.join(frequency, "token", "left").groupBy("item_id").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    short = quotes.filter(F.size("w").between(1, 2)).select("item_id", longest.alias("term"))
    parts = short.join(search.holders(held, short), "term").select("item_id", "token")
    candidates = held.join(rarest.unionByName(parts), "token").select("doc_id", "item_id")
    other = _wordless(quotes.filter(F.size("w") == 0), documents.select("doc_id", tx.normalize(F.col("text")).alias("norm")))
    if other is not None:
        candidates = candidates.unionByName(other)
    candidates = candidates.distinct().join(quotes.drop("w"), "item_id")
    by_text = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "quote")).alias("asked"))
    met = documents.select("doc_id", "text").join(by_text, "doc_id").select("doc_id", tx.normalize(F.col("text")).alias("norm"), "asked")
    met = met.select("doc_id", "norm", F.explode("asked").alias("q")).select("doc_id", "norm", "q.item_id", "q.quote")
    return met.select("item_id", "doc_id", F.expr("locate(quote, norm)").alias("start"), F.length("quote").alias("length"), "norm").filter("start > 0")


@query(
    "v1_quote_check",
    f"""WITH q AS (SELECT item_id, {N('text')} AS quote FROM benchmark), d AS (SELECT doc_id, {N('text')} AS norm FROM documents),
    m AS (SELECT item_id, count(*) AS n, min(doc_id) AS doc_id FROM q JOIN d ON contains(norm, quote) GROUP BY item_id)
    SELECT q.item_id, CASE WHEN length(quote) < 25 THEN 'too short' WHEN n IS NULL THEN 'not found' WHEN n > 1 THEN 'ambiguous' ELSE 'proven' END AS verdict, CAST(coalesce(n, 0) AS BIGINT) AS n, m.doc_id FROM q LEFT JOIN m ON m.item_id = q.item_id""",
)
def v1(spark, sf):
    """A quote is proven where it stands in exactly one text; too short, missing and ambiguous ones aren't."""
    t = Tables(spark, sf)
    found = quote_places(t.benchmark, t.documents).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    quotes = t.benchmark.select("item_id", F.length(tx.normalize(F.col("text"))).alias("length")).join(found, "item_id", "left")
    verdict = F.when(F.col("length") < 25, "too short").when(F.col("n").isNull(), "not found").when(F.col("n") > 1, "ambiguous").otherwise("proven")
    return quotes.select("item_id", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"), "doc_id")


@query("v2_word_edges", f"WITH q AS (SELECT item_id, {N('text')} AS quote FROM benchmark), d AS (SELECT doc_id, {N('text')} AS norm FROM documents), m AS (SELECT item_id, doc_id, instr(norm, quote) AS s, length(quote) AS n, norm FROM q JOIN d ON contains(norm, quote)) SELECT item_id, doc_id, CAST(s - CASE WHEN regexp_matches(substr(norm, s, 1), '[a-z0-9]') THEN length(regexp_extract(left(norm, s - 1), '[a-z0-9]*$')) ELSE 0 END AS INT) AS first, CAST(s + n - 1 + CASE WHEN regexp_matches(substr(norm, s + n - 1, 1), '[a-z0-9]') THEN length(regexp_extract(substr(norm, s + n), '^[a-z0-9]*')) ELSE 0 END AS INT) AS last FROM m")
def v2(spark, sf):
    """A proven quote's span, widened to whole words of any script."""
    t = Tables(spark, sf)
    return word_edges(quote_places(t.benchmark, t.documents))


def word_edges(places: DataFrame) -> DataFrame:
    """item_id, doc_id, first, last: the span of a quote (item_id, doc_id, start, length, norm), widened to whole words; an edge that isn't in a word stays."""
    edge = lambda at: F.substring(F.col("norm"), at, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    before = F.length(F.regexp_extract(F.substring(F.col("norm"), F.lit(1), F.col("start") - 1), _WORD_SIGNS + "$", 0))
    behind = F.length(F.regexp_extract(F.expr("substring(norm, start + length)"), "^" + _WORD_SIGNS, 0))
    first, last = F.col("start"), F.col("start") + F.col("length") - 1
    return places.select("item_id", "doc_id", (first - F.when(edge(first), before).otherwise(0)).alias("first"), (last + F.when(edge(last), behind).otherwise(0)).alias("last"))


@query("v4_merged_quotes", "SELECT l_orderkey, l_suppkey, CASE WHEN bool_and(l_returnflag <> 'N') THEN CAST(min(l_quantity) AS BIGINT) END AS first, CASE WHEN bool_and(l_returnflag <> 'N') THEN CAST(max(l_quantity) AS BIGINT) END AS last FROM lineitem GROUP BY l_orderkey, l_suppkey")
def v4(spark, sf):
    """Quotes of one claim and block merge to one span, unless one of them wasn't found."""
    whole = F.bool_and(F.col("l_returnflag") != "N")
    return Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.when(whole, F.min("l_quantity").cast("long")).alias("first"), F.when(whole, F.max("l_quantity").cast("long")).alias("last"))


@query(
    "v6_joined_segments",
    "WITH s AS (SELECT conv_id, turn, text, role, lag(role) OVER w AS prev, lower(left(text, 2)) IN ('it', 'th', 'le', 'de') AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(CASE WHEN back AND prev IS NOT NULL AND prev <> 'system' AND role <> 'system' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM s) SELECT conv_id, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS segments, sha256(string_agg(trim(text), ' ' ORDER BY turn)) AS digest FROM g GROUP BY conv_id, run",
)
def v6(spark, sf):
    """Segments that point back join the one before them; those of one role (system) neither join nor are joined."""
    per = Window.partitionBy("conv_id").orderBy("turn")
    s = Tables(spark, sf).conversations.withColumn("prev", F.lag("role").over(per))
    joins = F.lower(F.substring("text", 1, 2)).isin("it", "th", "le", "de") & F.col("prev").isNotNull() & (F.col("prev") != "system") & (F.col("role") != "system")
    runs = s.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("new").over(per))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return runs.groupBy("conv_id", "run").agg(F.count("*").alias("segments"), F.sha2(text.cast("binary"), 256).alias("digest"))


_LINE_WORDS = f"k AS (SELECT doc_id, seq, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, seq, {words_sql(N('line'))} AS w FROM lines)), m AS (SELECT doc_id, token, max(CASE WHEN token IN {_in(NEGATIONS)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seq ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS neg FROM k)"


@query("v8_v9_affirmed_words", f"WITH {LINES}, {_LINE_WORDS} SELECT doc_id, CAST(count(*) FILTER (NOT denied) AS BIGINT) AS affirmed, CAST(count(*) FILTER (denied) AS BIGINT) AS denied FROM (SELECT doc_id, token, bool_and(neg = 1) AS denied FROM m WHERE length(token) > 4 GROUP BY doc_id, token) GROUP BY doc_id")
def v8(spark, sf):
    """Longer words that a text states somewhere, and those of which every use is denied."""
    words = tx.words(tx.normalize(F.col("line")))
    # a lambda's variable holds the words once; a column would be computed again for every word
    zipped = F.flatten(F.transform(F.array(words), lambda w: F.zip_with(w, tx.negation_marks(w, NEGATIONS, 6), lambda a, b: F.struct(a.alias("token"), b.alias("neg")))))
    each = lines(Tables(spark, sf)).select("doc_id", F.explode(zipped).alias("z")).select("doc_id", "z.token", "z.neg").filter(F.length("token") > 4)
    per_word = each.groupBy("doc_id", "token").agg(F.bool_and("neg").alias("denied"))
    return per_word.groupBy("doc_id").agg(F.count_if(~F.col("denied")).alias("affirmed"), F.count_if("denied").alias("denied"))


@query("v11_says_quality", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: NOT contains(lower(p_type || ' small red'), left(w, 3)))) = 0 AS says FROM part")
def v11(spark, sf):
    """Whether every word of a name is met by one of the description."""
    hay = F.lower(F.concat("p_type", F.lit(" small red")))
    return Tables(spark, sf).part.select("p_partkey", F.forall(F.split("p_name", " "), lambda w: F.contains(hay, F.substring(w, 1, 3))).alias("says"))


@query("v13_missing_qualities", "SELECT p_brand, array_to_string(list_sort(list_filter(['blue', 'green', 'large', 'red', 'small'], lambda w: NOT list_contains(w1, w)))[1:3], ',') AS missing FROM (SELECT p_brand, list(DISTINCT split_part(p_name, ' ', 1)) AS w1 FROM part WHERE p_size > 45 GROUP BY p_brand)")
def v13(spark, sf):
    """Qualities of a fixed list that a brand's large parts don't name; three at most."""
    named = Tables(spark, sf).part.filter("p_size > 45").groupBy("p_brand").agg(F.collect_set(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("w"))
    rest = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in ("blue", "green", "large", "red", "small")]), "w"))
    return named.select("p_brand", F.array_join(F.slice(rest, 1, 3), ",").alias("missing"))


@query("v14_gaps", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'partial' END, CASE WHEN o_totalprice < 100000 THEN 'thin' END, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' THEN 'facet' END], lambda x: x IS NOT NULL), ',') AS gaps FROM orders")
def v14(spark, sf):
    """Typed gaps in order; a facet gap excludes a partial one."""
    gaps = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", "partial"), F.when(F.col("o_totalprice") < 100000, "thin"), F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "P"), "facet")))
    return Tables(spark, sf).orders.select("o_orderkey", F.array_join(gaps, ",").alias("gaps"))


@query("v15_dominance", "WITH a AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) SELECT x.l_orderkey FROM a x JOIN a y ON y.l_orderkey = x.l_orderkey + 1 WHERE list_has_all(y.flags, x.flags) AND y.n >= x.n AND y.q >= x.q AND (y.n > x.n OR y.q > x.q OR len(y.flags) > len(x.flags))")
def v15(spark, sf):
    """Answers that the next one dominates: no axis worse, the cited set included, one axis better."""
    a = Tables(spark, sf).lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    b = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("flags").alias("flags2"), F.col("n").alias("n2"), F.col("q").alias("q2"))
    better = (F.col("n2") > F.col("n")) | (F.col("q2") > F.col("q")) | (F.size("flags2") > F.size("flags"))
    return a.join(b, "l_orderkey").filter((F.size(F.array_except("flags", "flags2")) == 0) & (F.col("n2") >= F.col("n")) & (F.col("q2") >= F.col("q")) & better).select("l_orderkey")


@query("v17_carried_claims", "WITH first AS (SELECT DISTINCT l_partkey AS claim FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), second AS (SELECT DISTINCT l_partkey AS claim FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'A') SELECT claim, min(src) AS origin FROM (SELECT claim, 1 AS src FROM first UNION ALL SELECT claim, 2 FROM second) GROUP BY claim")
def v17(spark, sf):
    """Verified claims united with a retry's, none dropped, each with the round it comes from."""
    rows = Tables(spark, sf).lineitem.select(F.col("l_partkey").alias("claim"), "l_shipdate", "l_returnflag")
    old = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")
    origin = F.when(old, 1).when(F.col("l_returnflag") == "A", 2)
    return rows.groupBy("claim").agg(F.min(origin).alias("origin")).filter("origin is not null")


_UNITS = r"(?<=[.!?…])\s+(?=[A-ZÀ-Þ])"


@query(
    "r24_covering_passage",
    f"""WITH {LINES}, phrase AS (SELECT doc_id, list_distinct(list_filter({words_sql(N('line'))}, lambda x: length(x) > 3)) AS w FROM lines WHERE seq = 1),
    cut AS (SELECT doc_id, seq, string_split(regexp_replace(trim(line), '([.!?…])\\s+([A-ZÀ-Þ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM lines WHERE seq > 1),
    u AS (SELECT doc_id, seq, CAST(unnest(generate_series(1, len(p))) AS INT) AS i, unnest(p) AS s FROM cut),
    uw AS (SELECT doc_id, seq, i, s, {words_sql(N('s'))} AS w FROM u),
    found AS (SELECT x.doc_id, x.seq, list_filter(any_value(f.w), lambda w: list_contains(flatten(list(x.w)), w)) AS found, len(any_value(f.w)) AS n FROM uw x JOIN phrase f ON f.doc_id = x.doc_id GROUP BY x.doc_id, x.seq),
    wanted AS (SELECT * FROM found WHERE len(found) > 0 AND len(found) * 4 >= n),
    spans AS (SELECT a.doc_id, a.seq, a.i AS lo, b.i AS hi, list(x.s ORDER BY x.i) AS s, flatten(list(x.w)) AS w FROM wanted k JOIN uw a ON a.doc_id = k.doc_id AND a.seq = k.seq JOIN uw b ON b.doc_id = a.doc_id AND b.seq = a.seq AND b.i >= a.i JOIN uw x ON x.doc_id = a.doc_id AND x.seq = a.seq AND x.i BETWEEN a.i AND b.i GROUP BY a.doc_id, a.seq, a.i, b.i),
    whole AS (SELECT s.doc_id, s.seq, lo, hi, length(array_to_string(s.s, ' ')) AS length, len(found) AS found FROM spans s JOIN wanted k ON k.doc_id = s.doc_id AND k.seq = s.seq WHERE list_has_all(s.w, found)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY length, lo) AS place FROM whole)
    SELECT doc_id, seq, CAST(found AS INT) AS found, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, CAST(length AS INT) AS length FROM r WHERE place = 1""",
)
def r24(spark, sf):
    """For each line the shortest run of its sentences that holds all words of the text's first line found in it, the first on ties.

    Nothing where under a quarter of those words (of four letters or more) are found. From each sentence on, the run
    ends where the last of the words has come up: no pairs of sentences are formed.
    """
    t = Tables(spark, sf)
    words = lambda x: tx.words(tx.normalize(x))
    phrase = lines(t).filter("seq = 1").select("doc_id", F.array_distinct(F.filter(words(F.col("line")), lambda x: F.length(x) > 3)).alias("phrase"))
    cut = lines(t).filter("seq > 1").select("doc_id", "seq", F.split(F.trim("line"), _UNITS).alias("u"))
    cut = cut.select("doc_id", "seq", F.posexplode("u").alias("i", "s")).select("doc_id", "seq", "i", "s", words(F.col("s")).alias("w"))
    cut = cut.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.struct("i", "s", "w"))).alias("u"))
    met = cut.join(phrase, "doc_id").withColumn("found", F.array_intersect("phrase", F.flatten(F.transform("u", lambda x: x["w"]))))
    met = met.filter((F.size("found") > 0) & (F.size("found") * 4 >= F.size("phrase")))
    places = F.transform("found", lambda w: F.transform(F.filter("u", lambda x: F.array_contains(x["w"], w)), lambda x: x["i"]))
    met = met.withColumn("places", places)
    never = F.lit(2**31 - 1)
    last = lambda lo: F.aggregate("places", lo, lambda at, p: F.greatest(at, F.coalesce(F.array_min(F.filter(p, lambda x: x >= lo)), never)))
    runs = F.filter(F.transform("u", lambda x: F.struct(x["i"].alias("lo"), last(x["i"]).alias("hi"))), lambda x: x["hi"] < never)
    length = lambda x: F.length(F.array_join(F.transform(F.slice("u", x["lo"] + 1, x["hi"] - x["lo"] + 1), lambda y: y["s"]), " "))
    best = F.array_min(F.transform(runs, lambda x: F.struct(length(x).alias("length"), x["lo"].alias("lo"), x["hi"].alias("hi"))))
    out = met.select("doc_id", "seq", F.size("found").alias("found"), best.alias("b"))
    return out.select("doc_id", "seq", "found", (F.col("b.lo") + 1).alias("lo"), (F.col("b.hi") + 1).alias("hi"), "b.length")
