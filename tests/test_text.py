"""The normaliser against a plain one over all of Unicode, and its spans."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from docloom.functions import spans
from docloom.functions import text as tx

SUBSTITUTIONS = [(r"(?m)^[ \t]*[-–—][ \t]+", " "), (r"«\s*", '"'), (r"\s*»", '"'), (None, None), (r"-\s*\n\s*", ""), (r"[\s|" + re.escape(tx.BULLETS) + "]+", " ")]


def folded(c):
    plain = "".join(tx.LIGATURES.get(x, x) for x in unicodedata.normalize("NFKD", c))
    return "".join(x for x in plain if not unicodedata.combining(x)).lower().replace(tx.SOFT_HYPHEN, "")


def plain(text):
    out = "".join(map(folded, text))
    for pattern, to in SUBSTITUTIONS:
        if pattern:
            out = re.sub(pattern, to, out)
        else:
            for chars, one in ((tx.APOSTROPHES, "'"), (tx.QUOTES, '"'), (tx.DASHES, "-")):
                out = out.translate({ord(c): one for c in chars})
    return out.strip()


def samples(n=1500):
    rng = random.Random(1)
    pool = [c for c in map(chr, range(1, 0x30000)) if unicodedata.category(c) not in ("Cs", "Cn", "Co")]
    some = ["".join(rng.choice(pool) for _ in range(40)) for _ in range(n)]
    some += ["".join(rng.choice("ab -\n\t«»–—•|’…™½é́İΣß한글ﬁ²\x85\x1c") for _ in range(30)) for _ in range(n)]
    return some + ["", "…", "①②", "ΑΣ ΣΑΣ", "- a\n- b", "porte-\n fenêtre", "L’œuvre « dite » ™", "co­op", "x´y", "″"]


def test_normalize_over_all_of_unicode(spark):
    rows = samples()
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(-1, None)], "i int, s string")
    got = {r.i: r.n for r in frame.select("i", tx.normalize(F.col("s")).alias("n")).collect()}
    assert got.pop(-1) is None
    assert [(r, got[i]) for i, r in enumerate(rows) if got[i] != plain(r)] == []


def test_spans_give_the_same_text_and_its_origins(spark):
    rows = samples(300)
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(-1, None)], "i int, s string")
    got = {r.i: r.x for r in frame.select("i", spans.normalize_spans(F.col("s")).alias("x")).collect()}
    assert got.pop(-1) is None
    for i, r in enumerate(rows):
        x = got[i]
        assert x.norm == plain(r) and len(x.first) == len(x.last) == len(x.norm)
        assert all(0 <= a < b <= len(r) for a, b in zip(x.first, x.last, strict=True))
        assert x.first == sorted(x.first) and x.last == sorted(x.last)
        for c, a, b in zip(x.norm, x.first, x.last, strict=True):
            assert c in " \"'-" or c in folded(r[a]) and b == a + 1


def test_hand_computed_spans(spark):
    texts = {"Été": ("ete", [0, 1, 2], [1, 2, 3]), "a  \n b": ("a b", [0, 1, 5], [1, 5, 6]), "cœur": ("coeur", [0, 1, 1, 2, 3], [1, 2, 2, 3, 4]), "por-\n te": ("porte", [0, 1, 2, 6, 7], [1, 2, 3, 7, 8])}
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in frame.select("s", spans.normalize_spans(F.col("s")).alias("x")).collect():
        assert (r.x.norm, r.x.first, r.x.last) == texts[r.s]


def test_a_proven_quote_maps_back(spark):
    """A normalised interval [a, b) is the raw text from first[a] to last[b - 1]."""
    raw = "Le « Contrat »  couvre\n l’eau-\nforte."
    row = spark.createDataFrame([(raw,)], "s string").select(spans.raw_passage(F.col("s"), F.lit("contrat\" couvre l'eauforte")).alias("p")).first()
    assert row.p == "Contrat »  couvre\n l’eau-\nforte"


def test_readable_title_changes_letters_one_by_one(spark, con):
    titles = ["ßachzu | BESCHIE. ;", "ŉa", "ᾳ X", "ﬁn", "ΟΔΟΣ", "İZ", "a\x0bB", "Été  .", " über ", "x. ", "", " . ", None, "ǆ", "ẞ"]
    sql = "SELECT t, upper(left(b, 1)) || substr(b, 2) AS title FROM (SELECT t, regexp_replace(trim(regexp_replace(lower(t), '\\s+', ' ', 'g')), '[ .:;,]+$', '') AS b FROM (SELECT unnest($1) AS t))"
    expected = dict(con.execute(sql, [titles]).fetchall())
    found = spark.createDataFrame([(t,) for t in titles], "t string").select("t", tx.readable_title(F.col("t")).alias("title"))
    assert {r.t: r.title for r in found.collect()} == expected


def test_lines_of_space_separators_are_blank(spark, tmp_path, con):
    from docloom.plans.base import LINES, Tables, lines

    texts = [" \nb", " 　 \nß x", "\t\nc", " "]
    spark.createDataFrame([(i, "en", "s", x) for i, x in enumerate(texts)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = con.execute(f"WITH documents AS (SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')), {LINES} SELECT doc_id, seq, line FROM lines").fetchall()
    assert {tuple(r) for r in lines(Tables(spark, str(tmp_path))).select("doc_id", "seq", "line").collect()} == set(expected)


def test_latin_texts_take_the_short_way(spark):
    """Texts of ASCII and Latin letters with all white space, marks and accents that these hold; each once alone and in runs."""
    rng = random.Random(11)
    signs = [*map(chr, range(1, 0x180)), tx.MARK]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 20))) for some in ("aB-\n \t«»|·`é\xa0\x85\x1c\xad", signs) for _ in range(1500)] + ["a" + c + " " + c + "\n" + c for c in signs]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize(F.col("t")).alias("n"))
    assert [(r.t, r.n, plain(r.t)) for r in found.collect() if r.n != plain(r.t)][:5] == []


def test_words_of_are_the_normaliser_s(spark):
    """The shorter way to a text's words, over all of Unicode and with line breaks, hyphens and Latin signs."""
    rng = random.Random(12)
    some = samples() + ["".join(rng.choice("aB-\n \t«»|·`é\xa0\x85\xadß½") for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    frame = spark.createDataFrame([(t,) for t in [*some, None]], "t string")
    found = frame.select("t", tx.words_of(F.col("t")).alias("short"), tx.words(tx.normalize(F.col("t"))).alias("long")).filter("not (short <=> long)")
    assert found.collect() == []


def test_digests_are_those_of_the_spans(spark):
    from hashlib import md5

    texts = samples(200) + ["x" * 5000 + "  é½ " + "y" * 5000]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "s string")
    digest = lambda x: md5(x.encode()).hexdigest()
    for r in frame.select("s", spans.normalize_spans(F.col("s")).alias("x"), spans.span_digests(F.col("s")).alias("d")).collect():
        if r.s is None:
            assert r.d is None or r.d.norm is None
            continue
        first, last = (",".join(map(str, x)) for x in (r.x["first"], r.x["last"]))
        assert tuple(r.d) == (len(r.x.norm), digest(r.x.norm), digest(first), digest(last))


def test_titles_of_a_word_repeated_without_end(spark, con):
    """Leading articles go however many they are; a pattern that recurses on each would overflow the task's stack."""
    from docloom.plans.text_q import N

    rng = random.Random(4)
    titles = ["la " * 100_000 + "Maison", "3.1 " + "Les " * 20_000 + "des", "l " * 20_000 + "lesson la", "des", "lesdes", "12. d", "", "42", "Le  la\tDu cas"]
    titles += [" ".join(rng.choice(["le", "la", "les", "l", "de", "des", "du", "d", "dé", "l'", "lard", "de.", "7"]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    sql = f"SELECT t, regexp_replace(b, '^((le|la|les|l|de|des|du|d)( +|$))+', '') AS title FROM (SELECT t, trim(regexp_replace({N('t')}, '^[^a-z]+', '')) AS b FROM (SELECT unnest($1) AS t))"
    expected = dict(con.execute(sql, [titles]).fetchall())
    found = spark.createDataFrame([(t,) for t in titles], "t string").select("t", tx.section_title(F.col("t")).alias("title"))
    assert {r.t: r.title for r in found.collect()} == expected
    assert expected[titles[0]] == "maison"
