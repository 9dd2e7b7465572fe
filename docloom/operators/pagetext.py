"""Lines of pages: running titles, contents pages, outlines, and the proof that no source line is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def template(text: Column) -> Column:
    """A text with each run of digits as one sign: what pages have in common but for their numbers."""
    return F.regexp_replace(text, r"\d+", "#")


def running_lines(lines: DataFrame, band: float = 40.0, share: float = 0.3, caps_size: float = 10.0) -> DataFrame:
    """book, page, line, motive, seen: every line that isn't part of the body, and why.

    lines: book, page, line, y0, y1, height, text, size, turned. In the top and bottom band of a page goes what is
    written in such bands on at least `share` of the book's pages times (twice at the least), a page number, or small
    capitals: `running_band`. Anywhere goes a turned line whose template stands turned on as many pages:
    `turned_title`. seen is how often the text was met in bands, or on how many pages the template.

    Counts are grouped before lines move, and only texts that recur meet the lines again: those in bands or turned, as
    no other line can go.
    """
    of_book = lines.groupBy("book").agg(F.greatest(F.lit(2), F.ceil(F.countDistinct("page") * F.lit(share))).cast("long").alias("least"))
    in_band = (F.col("y0") < band) | (F.col("y1") > F.col("height") - band)
    recurring = lines.filter(in_band).groupBy("book", "text").agg(F.count("*").alias("seen")).join(of_book, "book").filter("seen >= least").select("book", "text", "seen")
    turned = lines.filter("turned").groupBy("book", template(F.col("text")).alias("template")).agg(F.countDistinct("page").alias("pages"))
    turned = turned.join(of_book, "book").filter("pages >= least").select("book", "template", "pages")
    met = lines.filter(in_band | F.col("turned")).withColumn("template", template(F.col("text"))).join(recurring, ["book", "text"], "left").join(turned, ["book", "template"], "left")
    own = F.col("seen").isNotNull() | F.col("text").rlike(r"^\d{1,3}$") | ((F.col("size") <= caps_size) & (F.col("text") == F.upper("text")))
    motive = F.when(in_band & own, "running_band").when(F.col("turned") & F.col("pages").isNotNull(), "turned_title")
    seen = F.when(F.col("motive") == "running_band", F.coalesce("seen", F.lit(1))).otherwise(F.col("pages"))
    return met.withColumn("motive", motive).filter("motive is not null").select("book", "page", "line", "motive", seen.cast("long").alias("seen"))


def conservation(source: DataFrame, carried: DataFrame, removed: DataFrame) -> tuple[DataFrame, Observation]:
    """uid, problem, n_blocks, motive for every line that isn't in exactly one block or one removal; and the counts on the way.

    source: uid; carried: uid, block; removed: uid, motive. Problems: `several` blocks carry it, it is carried and
    removed (`both`), neither (`lost`), or carried without being a source line (`unknown`). Counts of lines, carried
    and removed ones are observed while the result is computed, without a pass of their own.
    """
    blocks = carried.groupBy("uid").agg(F.count("*").alias("n_blocks"))
    motives = removed.groupBy("uid").agg(F.min("motive").alias("motive"))
    known = source.select("uid").distinct().withColumn("known", F.lit(True)).join(motives, "uid", "left")
    met = known.join(blocks, "uid", "full")
    n = F.coalesce("n_blocks", F.lit(0).cast("long"))
    counts = Observation("conservation")
    met = met.observe(counts, F.count_if("known").alias("lines"), F.count_if(F.col("known") & (n > 0)).alias("carried"), F.count_if(F.col("known") & F.col("motive").isNotNull()).alias("removed"))
    problem = F.when(F.col("known").isNull(), "unknown").when(n > 1, "several").when((n == 1) & F.col("motive").isNotNull(), "both").when((n == 0) & F.col("motive").isNull(), "lost")
    return met.select("uid", problem.alias("problem"), n.alias("n_blocks"), "motive").filter("problem is not null"), counts


def contents_pages(pages: DataFrame) -> DataFrame:
    """book, page, is_contents, after: the pages of a printed table of contents, and those behind it.

    pages: book, page (in order), entries (it looks like contents), other (it holds lines that contents don't),
    article (it opens an article). Contents begin on the first page with entries, whatever else is on it, and go on
    while pages have entries and nothing else. A page that opens an article is the last; nothing begins them anew.

    The machine has three states and never goes back, so it is settled by two least pages of a book: where contents
    begin, and where they end. No book is walked page by page, and both are grouped on the map side.
    """
    first = pages.filter("entries").groupBy("book").agg(F.min("page").alias("first"))
    later = pages.join(first, "book").filter("page >= first")
    opening = F.col("page") == F.col("first")
    refused = ~opening & (~F.col("entries") | F.col("other"))
    ends = later.filter(refused | F.col("article")).groupBy("book").agg(F.min(F.struct("page", (~refused).cast("int").alias("kept"))).alias("end"))
    met = pages.join(first, "book", "left").join(ends, "book", "left")
    last = F.when(F.col("end").isNull(), True).otherwise((F.col("page") < F.col("end.page")) | ((F.col("page") == F.col("end.page")) & (F.col("end.kept") == 1)))
    inside = F.coalesce((F.col("page") >= F.col("first")) & last, F.lit(False))
    after = F.coalesce((F.col("page") >= F.col("end.page")) & ~inside, F.lit(False))
    return met.select("book", "page", inside.alias("is_contents"), after.alias("after"))


def outline(headings: DataFrame, chunk: int = 10_000) -> DataFrame:
    """book, ord, level, parent, depth: the nearest earlier heading of a smaller level, and how many stand above.

    headings: book, ord (gapless from 0 in a book), level (from 1). For each level the last heading so far is known by
    a running maximum; the parent is the latest of the lower levels, and the others on the way up are those later than
    all of still lower levels. Running maxima are taken within chunks of a book and carried on from chunk to chunk, so
    a book of any length is the work of many tasks. As many maxima are kept as there are levels.
    """
    top = headings.agg(F.max("level")).first()[0] or 0
    h = headings.withColumn("chunk", F.floor(F.col("ord") / chunk))
    last = [F.max(F.when(F.col("level") == k, F.col("ord"))).alias(f"k{k}") for k in range(1, top + 1)]
    before = Window.partitionBy("book").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = h.groupBy("book", "chunk").agg(*last)
    carry = chunks.select("book", "chunk", F.array(*[F.max(f"k{k}").over(before) for k in range(1, top + 1)]).cast("array<long>").alias("carry"))
    inside = Window.partitionBy("book", "chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    own = F.array(*[F.max(F.when(F.col("level") == k, F.col("ord"))).over(inside) for k in range(1, top + 1)]).cast("array<long>")
    met = h.withColumn("own", own).join(carry, ["book", "chunk"])
    seen = F.slice(F.zip_with("own", "carry", lambda a, b: F.coalesce(a, b)), F.lit(1), F.col("level") - 1)
    start = F.struct(F.lit(-1).cast("long").alias("latest"), F.lit(0).alias("depth"))
    step = lambda s, x: F.when(x > s["latest"], F.struct(x.alias("latest"), (s["depth"] + 1).alias("depth"))).otherwise(s)
    up = F.aggregate(seen, start, step)
    return met.withColumn("up", up).select("book", "ord", "level", F.when(F.col("up.latest") >= 0, F.col("up.latest")).alias("parent"), F.col("up.depth").alias("depth"))


#: A heading with its number; a number of up to three digits; a heading that ends in leaders or spaces and a page number. Fixed values.
HEADING, PAGE_NUMBER, PRINTED_ENTRY = r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", r"^\d{1,3}$", r"^\s*(\d+(?:\.\d+)*)\.?\s+(.+?)(?:\s+\.{2,}\s*|\s+)(\d{1,3})\s*$"


def printed_entries(lines: DataFrame, height: float, column: float = 80.0, indent: float = 5.0, baseline: float = 8.0, gap: float = 1.5, bucket: float = 60.0) -> DataFrame:
    """page, box, number, title, parts: the entries of printed contents, with titles that go on over several lines.

    lines: page, box, x0, y0, x1, y1, text. A line that ends in its page number is an entry of its own. Another
    numbered line is one if a page number stands to its right on its baseline; its title goes on with the lines
    between it and the next numbered line of its column, not left of it and left of the page number, as long as no
    gap between them is wider than `gap` times the next line's height.

    All bounds are met by equality on buckets first: heights between two starts in strips of `bucket`, columns and
    baselines in bands of their tolerance and the bands beside; no line meets all lines of its page.
    """
    bare = lines.withColumn("bare", F.trim("text"))
    printed = F.col("bare").rlike(PRINTED_ENTRY)
    clean = lambda c: F.expr(f"trim(BOTH ' .' FROM {c})")
    whole = bare.filter(printed).select("page", "box", F.regexp_extract("bare", PRINTED_ENTRY, 1).alias("number"), F.regexp_extract("bare", PRINTED_ENTRY, 2).alias("t"))
    whole = whole.select("page", "box", "number", clean("t").alias("title"), F.lit(1).alias("parts"))
    rest = bare.filter(~printed)
    starts = rest.filter(F.col("bare").rlike(HEADING)).withColumn("number", F.regexp_extract("bare", HEADING, 1)).withColumn("t", F.regexp_extract("bare", HEADING, 2))
    beside = lambda c, width: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(c) / width) + d))

    numbers = rest.filter(F.col("bare").rlike(PAGE_NUMBER)).select("page", F.col("x0").alias("nx"), F.col("y0").alias("ny"), F.floor(F.col("y0") / baseline).alias("band"))
    right = starts.select("page", "box", "x0", "y0", beside("y0", baseline).alias("band")).join(numbers, ["page", "band"])
    right = right.filter((F.col("nx") > F.col("x0")) & (F.abs(F.col("ny") - F.col("y0")) <= baseline)).groupBy("page", "box").agg(F.min("nx").alias("edge"))
    below = starts.select("page", F.col("x0").alias("ox"), F.col("y0").alias("oy"), F.floor(F.col("x0") / column).alias("band"))
    following = starts.select("page", "box", "x0", "y0", beside("x0", column).alias("band")).join(below, ["page", "band"])
    following = following.filter((F.col("oy") > F.col("y0")) & (F.abs(F.col("ox") - F.col("x0")) <= column)).groupBy("page", "box").agg(F.min("oy").alias("until"))
    opened = starts.join(right, ["page", "box"]).join(following, ["page", "box"], "left").withColumn("until", F.coalesce("until", F.lit(height)))

    strips = F.sequence(F.floor(F.col("y0") / bucket), F.floor(F.col("until") / bucket))
    reach = opened.filter("until > y0").select("page", "box", "x0", "y0", "y1", "edge", "until", F.explode(strips).alias("strip"))
    plain = rest.filter(~F.col("bare").rlike(PAGE_NUMBER) & ~F.col("bare").rlike(HEADING))
    plain = plain.select("page", F.col("box").alias("of"), F.col("x0").alias("cx"), F.col("y0").alias("cy"), F.col("x1").alias("cx1"), F.col("y1").alias("cy1"), "bare", F.floor(F.col("y0") / bucket).alias("strip"))
    met = reach.join(plain, ["page", "strip"]).filter((F.col("cy") > F.col("y0")) & (F.col("cy") < F.col("until")) & (F.col("cx") >= F.col("x0") - indent) & (F.col("cx1") < F.col("edge")))
    down = Window.partitionBy("page", "box").orderBy("cy", "cx", "of")
    near = F.col("cy") - F.coalesce(F.lag("cy1").over(down), F.col("y1")) <= gap * F.greatest(F.col("cy1") - F.col("cy"), F.lit(1.0))
    met = met.withColumn("near", near).withColumn("kept", F.min("near").over(down.rowsBetween(Window.unboundedPreceding, 0))).filter("kept")
    more = met.groupBy("page", "box").agg(F.array_sort(F.collect_list(F.struct("cy", "cx", "of", clean("bare").alias("t")))).alias("more"))
    titled = opened.join(more, ["page", "box"], "left").withColumn("more", F.coalesce(F.transform("more", lambda m: m["t"]), F.array().cast("array<string>")))
    pieces = F.filter(F.concat(F.array(clean("t")), F.col("more")), lambda p: p != "")
    return whole.unionByName(titled.select("page", "box", "number", F.array_join(pieces, " ").alias("title"), (1 + F.size("more")).alias("parts")))


def grid_cells(lines: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """page, row, column, text: the lines of a table in the cells of the grid that their left and upper edges make.

    lines: page, box, x0, y0, text. Edges that follow each other by at most `tolerance` are one rule of the grid;
    rows and columns are the ranks of rules, from 1. Lines of a cell are joined from top to bottom, left to right.
    """

    def ruled(frame: DataFrame, edge: str, name: str) -> DataFrame:
        order = Window.partitionBy("page").orderBy(edge)
        fresh = F.coalesce(F.col(edge) - F.lag(edge).over(order) > tolerance, F.lit(True)).cast("int")
        rules = frame.select("page", edge).distinct().withColumn("fresh", fresh)
        ranks = rules.withColumn(name, F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("fresh")
        return frame.join(ranks, ["page", edge])

    placed = ruled(ruled(lines, "x0", "column"), "y0", "row")
    cells = placed.groupBy("page", "row", "column").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "box", "text"))).alias("held"))
    return cells.select("page", "row", "column", F.array_join(F.transform("held", lambda h: h["text"]), "\n").alias("text"))
