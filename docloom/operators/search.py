"""Lexical search over blocks: document frequencies, coverage scores, a total order, top k.

Frames: tokens(corpus, block, token, n_tokens) with one row for each distinct word of a block; forms(question,
group, form, token, form_size) with one row for each distinct word of each form of each group of a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.scratch import Rounds


def document_frequency(tokens: DataFrame) -> DataFrame:
    """corpus, token, df: how many blocks of a corpus hold the word."""
    return tokens.groupBy("corpus", "token").agg(F.count("*").alias("df"))


def form_weights(forms: DataFrame, frequency: DataFrame) -> DataFrame:
    """question, group, form, corpus, weight: the sum of 1 / df over the form's words that the corpus knows."""
    return forms.join(frequency, "token").groupBy("question", "group", "form", "corpus").agg(F.sum(1.0 / F.col("df")).alias("weight"))


def _terms(forms: DataFrame, question_words: DataFrame, frequency: DataFrame) -> DataFrame:
    """What is asked as one table of words with all that a score needs of them; the whole question is a form without a group."""
    groups = forms.groupBy("question").agg(F.countDistinct("group").alias("groups"))
    of_forms = forms.join(frequency, "token").join(form_weights(forms, frequency), ["question", "group", "form", "corpus"]).join(groups, "question")
    of_questions = question_words.join(frequency, "token").withColumnRenamed("question_size", "form_size")
    return of_forms.unionByName(of_questions, allowMissingColumns=True)


def _of_blocks(by_form: DataFrame) -> DataFrame:
    """The scores of blocks from how much of each form they hold."""
    grouped = F.col("group").isNotNull()
    whole = grouped & (F.col("met") == F.col("form_size"))
    by_group = by_form.groupBy("corpus", "block", "question", "group").agg(
        F.max(F.when(whole, 1).otherwise(0)).alias("whole"),
        F.max(F.when(whole & (F.col("form_size") > 1), F.col("form_size") / F.col("n_tokens")).otherwise(0.0)).alias("density"),
        F.max(1.0 / F.col("rarest") / F.col("weight")).alias("hit"),
        F.max("groups").alias("groups"),
        F.max(F.when(~grouped, F.col("met") / F.col("form_size"))).alias("coverage"),
    )
    by_block = by_group.groupBy("corpus", "block", "question").agg(
        F.sum("whole").alias("full"), F.max("density").alias("precision"), F.sum("hit").alias("hits"), F.max("groups").alias("groups"), F.max("coverage").alias("coverage")
    )
    partial = F.when(F.col("full") == 0, F.col("hits") / F.col("groups")).otherwise(0.0)
    out = by_block.filter("groups is not null")
    return out.select("question", "corpus", "block", "full", F.round(partial, 9).alias("partial"), F.round("precision", 9).alias("precision"), F.round(F.coalesce("coverage", F.lit(0.0)), 9).alias("coverage"))


def scores(tokens: DataFrame, forms: DataFrame, question_words: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """question, corpus, block and the score's parts for every block that shares a word with a form.

    full: groups with a wholly covered form; precision: the densest covered form of several words; partial: where
    nothing is full, the mean over groups of the rarest shared word's part of its form's weight; coverage: the part
    of the question's words in the block. Ratios are rounded to 9 places, so that sums of reciprocals tie alike in
    any order.

    What is asked becomes one table of words with all that a score needs of them; up to `most_broadcast` rows of it
    go to every task, beyond that it is joined by shuffles. Blocks are dealt out once, and a block's hits are summed
    where it lies: only the best blocks of a question move on.
    """
    wanted = forms.select("token").union(question_words.select("token")).distinct()
    frequency = document_frequency(tokens.join(wanted, "token", "left_semi"))
    terms = _terms(forms, question_words, frequency).persist()
    few = terms.count() <= most_broadcast
    hits = tokens.repartition("corpus", "block").join(F.broadcast(terms) if few else terms, ["corpus", "token"])
    by_form = hits.groupBy("corpus", "block", "question", "group", "form", "form_size", "n_tokens", "weight", "groups").agg(F.count("*").alias("met"), F.min("df").alias("rarest"))
    return _of_blocks(by_form)


def best(scored: DataFrame, most: int) -> DataFrame:
    """The first `most` blocks of each question, best first; corpus and block end the order, so it is total."""
    order = Window.partitionBy("question").orderBy(F.desc("full"), F.desc("partial"), F.desc("precision"), F.desc("coverage"), "corpus", "block")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def overlapping(sets: DataFrame, asked: DataFrame, keys: list[str], ask: str, share: float = 0.5, most_broadcast: int = 1_000_000) -> DataFrame:
    """ask, keys, shared, size: the sets that hold at least `share` of the words asked for.

    sets: keys, words (distinct); asked: ask, token (distinct words of an ask). A set that holds `need` of an ask's n
    words holds one of its n - need + 1 rarest, whatever else it lacks. Only these bring sets and asks together, so
    that frequent words are never a key; what meets is then counted in full. Where the asks' lists of words, one for each rare
    word, hold at most `most_broadcast` words together, they go to every task and are counted where the sets lie, at the
    first rare word that a set and an ask share; beyond that they meet by shuffles.
    """
    words = asked.groupBy(ask).agg(F.collect_set("token").alias("wanted")).withColumn("size", F.size("wanted")).withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("size") * share)))
    held = sets.select(*keys, F.explode("words").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    order = Window.partitionBy(ask).orderBy(F.coalesce("df", F.lit(0)), "token")
    ranked = asked.join(df, "token", "left").withColumn("place", F.row_number().over(order)).join(words.select(ask, "size", "need"), ask)
    rare = Rounds(sets.sparkSession, "rare").keep(ranked.filter(F.col("place") <= F.col("size") - F.col("need") + 1).select(ask, "token", "size"))
    if (rare.agg(F.sum("size")).first()[0] or 0) <= most_broadcast:
        listed = rare.select(ask, "token").join(rare.groupBy(ask).agg(F.collect_list("token").alias("rares")), ask).join(words, ask)
        near = sets.select(*keys, "words", F.explode("words").alias("token")).join(F.broadcast(listed), "token")
        # most pairs that meet share too little, so that is looked at first
        counted = near.withColumn("both", F.array_intersect("words", "wanted")).withColumn("shared", F.size("both")).filter("shared >= need")
        counted = counted.filter(F.get(F.array_intersect("both", "rares"), F.lit(0)) == F.col("token"))
        return counted.select(ask, *keys, F.col("shared").cast("long").alias("shared"), F.col("size").cast("long").alias("size"))
    rare = rare.select(ask, "token")
    met = held.join(rare, "token").select(ask, *keys).distinct()
    counted = met.join(sets, keys).join(words, ask).withColumn("shared", F.size(F.array_intersect("words", "wanted")))
    return counted.filter("shared >= need").select(ask, *keys, F.col("shared").cast("long").alias("shared"), F.col("size").cast("long").alias("size"))


def _scored(met: DataFrame, sets: DataFrame, terms: DataFrame) -> DataFrame:
    """The scores of `scores` for the pairs (question, corpus, block) in `met` alone."""
    wanted = terms.groupBy("question", "corpus").agg(F.collect_set("token").alias("wanted"))
    shared = met.join(sets, ["corpus", "block"]).join(wanted, ["question", "corpus"])
    shared = shared.select("question", "corpus", "block", F.size("words").alias("n_tokens"), F.explode(F.array_intersect("words", "wanted")).alias("token"))
    hits = shared.join(terms, ["question", "corpus", "token"])
    by_form = hits.groupBy("corpus", "block", "question", "group", "form", "form_size", "n_tokens", "weight", "groups").agg(F.count("*").alias("met"), F.min("df").alias("rarest"))
    return _of_blocks(by_form)


def ranked(sets: DataFrame, forms: DataFrame, question_words: DataFrame, most: int = 20, first: int = 500, growth: int = 8) -> DataFrame:
    """What `best(scores(...), most)` gives, without scoring every block that shares a word with a question.

    sets: corpus, block, words (distinct). Blocks that share one of a question's rarest words are scored: words that
    stand in `first` blocks together at first, `growth` times as many in each further round. What any other block
    could reach follows from the words left: forms made of them alone, the part of the weight that they bring, and
    their share of the question. As soon as `most` scores are above that, no other block can be among the best, and
    the question is settled; rounds end at the latest when no word is left. A round keeps the best of its blocks.
    """
    rounds = Rounds(sets.sparkSession, "search")
    sets = rounds.keep(sets)
    postings = sets.select("corpus", "block", F.explode("words").alias("token"))
    wanted = forms.select("token").union(question_words.select("token")).distinct()
    frequency = rounds.keep(document_frequency(postings.join(wanted, "token", "left_semi")))
    terms = rounds.keep(_terms(forms, question_words, frequency))
    open_now = terms.filter("group is not null").select("question").distinct()
    rarest = Window.partitionBy("question").orderBy("df", "corpus", "token")
    words = terms.join(open_now, "question", "left_semi").select("question", "corpus", "token", "df").distinct()
    words = rounds.keep(words.withColumn("met_before", F.coalesce(F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    placed = rounds.keep(terms.join(words.select("question", "corpus", "token", "met_before"), ["question", "corpus", "token"]))

    scored, done = None, None
    low, budget = 0, first
    while open_now.take(1):
        fresh = words.filter((F.col("met_before") >= low) & (F.col("met_before") < budget)).join(open_now, "question", "left_semi")
        met = postings.join(fresh.select("question", "corpus", "token"), ["corpus", "token"]).select("question", "corpus", "block").distinct()
        if scored is not None:  # the best of earlier rounds are known already
            met = met.join(scored.select("question", "corpus", "block"), ["question", "corpus", "block"], "left_anti")
        part = best(_scored(met, sets, terms), most).drop("rank")
        scored_now = rounds.keep(part)
        scored = scored_now if scored is None else scored.unionByName(scored_now)
        done = best(scored.filter("full is not null"), most)

        left = placed.filter(F.col("met_before") >= budget).join(open_now, "question", "left_semi")
        grouped = F.col("group").isNotNull()
        by_form = left.groupBy("question", "corpus", "group", "form", "form_size", "groups").agg(F.count("*").alias("n"), F.max(1.0 / F.col("df") / F.col("weight")).alias("value"))
        covers = grouped & (F.col("n") == F.col("form_size"))
        by_group = by_form.groupBy("question", "corpus", "group").agg(
            F.max(covers.cast("int")).alias("full"), F.max(F.when(covers & (F.col("form_size") > 1), 1.0).otherwise(0.0)).alias("precision"), F.max("value").alias("value"), F.max("groups").alias("groups"), F.max(F.when(~grouped, F.col("n") / F.col("form_size"))).alias("coverage")
        )
        reach = by_group.groupBy("question", "corpus").agg(F.sum("full").alias("full"), F.coalesce(F.sum("value") / F.max("groups"), F.lit(0.0)).alias("partial"), F.max("precision").alias("precision"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("coverage"))
        reach = reach.select("question", F.struct("full", F.when(F.col("full") > 0, 0.0).otherwise(F.col("partial")).alias("partial"), "precision", "coverage").alias("reach")).groupBy("question").agg(F.max("reach").alias("reach"))
        last = done.filter(F.col("rank") == most).select("question", F.struct("full", "partial", "precision", "coverage").alias("last"))
        above = lambda c: F.col(f"last.{c}") > F.col(f"reach.{c}") + 1e-8  # noqa: E731  scores are rounded to 9 places
        level = lambda c: F.col(f"last.{c}") >= F.col(f"reach.{c}") - 1e-12
        even = (F.col("last.full") == F.col("reach.full")) & (F.col("reach.full") > 0)
        beyond = (F.col("last.full") > F.col("reach.full")) | ((F.col("last.full") == F.col("reach.full")) & above("partial")) | (even & (above("precision") | (level("precision") & above("coverage"))))
        sure = open_now.join(reach, "question", "left").join(last, "question", "left")
        open_now = rounds.keep(sure.filter(F.col("reach").isNotNull() & ~F.coalesce(beyond, F.lit(False))).select("question"))
        low, budget = budget, budget * growth
    return done if done is not None else best(_scored(postings.join(words, ["corpus", "token"]).select("question", "corpus", "block"), sets, terms), most)


def holders(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """term, token: the words of a vocabulary (token) that contain a term (term), be it at their start, end or inside.

    They meet on the term's first three characters (all of a shorter one), among the grams of the words; a vocabulary
    grows far slower than its texts.
    """
    token = F.col("token")
    sizes = F.array(*[F.lit(n) for n in (1, 2, 3)])
    grams = F.flatten(F.transform(sizes, lambda n: F.when(F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - n + 1), lambda i: F.substring(token, i, n))).otherwise(F.array().cast("array<string>"))))
    held = vocabulary.select("token").distinct().select("token", F.explode(F.array_distinct(grams)).alias("gram"))
    asked = terms.select("term").filter("term <> ''").distinct().withColumn("gram", F.substring("term", 1, 3))
    return held.join(asked, "gram").filter(F.contains("token", "term")).select("term", "token")


def term_hits(held: DataFrame, terms: DataFrame) -> DataFrame:
    """term, key, head: the texts (key) that contain a term in one of their words, and whether in their head.

    held: key, token, head (boolean), a word of a text in one row or more. A text contains a term without spaces where one
    of its words does. The words that do are kept as a table first: they are few, and texts needn't be moved to meet them.
    """
    met = Rounds(held.sparkSession, "holders").keep(holders(held, terms))
    return held.join(met, "token").groupBy("term", "key").agg(F.bool_or("head").alias("head"))


def next_alike(documents: DataFrame, reach: int, least: float, most: int) -> DataFrame:
    """doc_id, target, clause, similarity, place: for each line the `most` likest of the lines up to `reach` further on.

    documents: doc_id (a key), text. Lines count from 1; likeness is the Jaccard index of their words, of equals the
    earlier line comes first. A document is one row, so its lines meet where it lies and nothing is shuffled.
    """
    sets = F.transform(F.split("text", "\n"), lambda line: F.array_distinct(tx.words_of(line)))

    def similarity(a: Column, b: Column) -> Column:
        return tx.let(F.size(F.array_intersect(a, b)), lambda n: F.round(n / (F.size(a) + F.size(b) - n), 9))

    def pairs(every: Column, words: Column, i: Column) -> Column:
        met = F.transform(F.slice(every, i + 2, reach), lambda w, k: F.struct((-similarity(words, w)).alias("rank"), (i + k + 2).alias("clause")))
        return F.slice(F.array_sort(F.filter(met, lambda x: x.rank <= -least)), 1, most)

    found = tx.let(sets, lambda every: F.transform(every, lambda words, i: F.when(F.size(words) > 0, pairs(every, words, i))))
    held = documents.select("doc_id", F.posexplode(found).alias("i", "pairs"))
    return held.select("doc_id", (F.col("i") + 1).alias("target"), F.posexplode("pairs").alias("k", "pair")).select(
        "doc_id", "target", F.col("pair.clause").alias("clause"), (-F.col("pair.rank")).alias("similarity"), (F.col("k") + 1).alias("place")
    )
