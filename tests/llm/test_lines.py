import hashlib
import random
import re
from collections import defaultdict

from docloom.llm import lines
from docloom.llm.common import Scratch

WORD = re.compile(r"[^ \t-\r]+")


def brute(docs, min_words):
    """Every window of lines with enough words, in order; a window seen before is cut."""
    seen, cut = {}, defaultdict(set)
    for key in sorted(docs):
        own = [(i, s, len(WORD.findall(s))) for i, s in enumerate(docs[key].split("\n")) if WORD.search(s)]
        for a in range(len(own)):
            for b in range(a, len(own)):
                run = own[a : b + 1]
                if sum(w for *_, w in run) < min_words:
                    continue
                first = seen.setdefault(tuple(s for _, s, _ in run), (key, a))
                if first != (key, a):
                    cut[key].update(i for i, *_ in run)
    return {k: sorted(cut[k]) for k in docs}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    pool = ["a", "b c", "d e f", "g h i j", "k l m n o", "", " ", "p q r s t u v"]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for i in range(40)}
    for words in (1, 5, 9):
        got = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), min_words=words).collect()
        want = brute(docs, words)
        assert {r.doc_id: r.removed for r in got} == want
        for r in got:
            assert r.text == "\n".join(s for i, s in enumerate(docs[r.doc_id].split("\n")) if i not in want[r.doc_id])


def test_ranks_order_suffixes(spark):
    docs = [(1, "x\ny\nz\nx\ny\nw"), (2, "x\ny\nz\nq"), (3, "y\nz\nx\ny")]
    scratch = Scratch(spark, "test")
    numbered = lines._numbered_lines(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    levels = lines.suffix_levels(numbered, scratch)
    ids = {(r.doc, r["at"]): (r.id_a, r.id_b) for r in numbered.collect()}
    for k, level in enumerate(levels):
        ranks = {(r.doc, r["at"]): r["rank"] for r in level.collect()}
        run = {p: tuple(ids[p[0], p[1] + i] for i in range(2**k)) for p in ranks}
        for p in ranks:
            for q in ranks:
                assert (ranks[p] < ranks[q]) == (run[p] < run[q])


def test_awkward_rows(spark, awkward):
    got = {(r.doc_id, r.label): r for r in lines.dedup_lines(awkward).collect()}
    assert got[2, None].text is None and got[2, None].lines == 0
    assert got[3, 3].text == "" and got[4, 4].text == "   \n\t "
    assert got[1, 1].removed == [] and got[None, 7].removed == [0]  # the null id comes last
    assert got[5, 5].removed == [] and got[6, 6].text == ""
    assert got[1, 1].node == 1


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digest(spark):
    import support

    from docloom.llm.queries import op1_line_dedup

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{support.SMALL}/documents.parquet").collect()}
    want = brute(docs, 5)
    for r in op1_line_dedup(spark, support.SMALL).collect():
        kept = "\n".join(s for i, s in enumerate(docs[r.doc_id].split("\n")) if i not in want[r.doc_id])
        assert r.kept_md5 == hashlib.md5(kept.encode()).hexdigest() and r.n_removed == len(want[r.doc_id])


def test_doubling_goes_on_to_the_longest_run(spark):
    """Copies of 70 lines make classes of 64 lines; each of their lines goes, and shifted copies inside one text too."""
    rng = random.Random(6)
    run = [f"line {i} of it" for i in range(70)]
    docs = {1: "\n".join(run), 2: "\n".join(["first", *run, "last"]), 3: "\n".join(run[10:60] + ["between"] + run[30:70]), 4: "\n".join(["same"] * 40), 5: "\n".join(rng.sample(run, 20))}
    numbered = lines._numbered_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text")
    assert len(lines.suffix_levels(numbered, Scratch(spark, "test"))) == 7
    got = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in got} == brute(docs, 5)


def test_ids_of_lines_have_independent_halves(spark):
    """The second half isn't a function of the first: both would collide together otherwise."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.xxhash64(F.lit(1), F.lit("abc")).alias("own"), F.xxhash64(F.lit("abc"), F.lit(1)).alias("chained"), F.xxhash64(F.lit("abc")).alias("a")).first()
    numbered = lines._numbered_lines(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), "doc_id", "text").first()
    assert (numbered.id_a, numbered.id_b) == (row.a, row.own) and row.own != row.chained


def test_very_long_line_and_many_lines(spark):
    docs = [(1, "w " * 1_000_000), (2, "w " * 1_000_000), (3, "\n".join(f"row number {i} of many" for i in range(2_000))), (4, "\n".join(f"row number {i} of many" for i in range(2_000)))]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2].text == "" and got[4].text == "" and len(got[4].removed) == 2_000
    assert got[1].text == docs[0][1] and got[3].removed == []
