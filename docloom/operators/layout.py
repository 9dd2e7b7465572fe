"""Pages of boxes: gutters between columns, reading order, baselines, numbers that stand alone.

Frame: boxes(page, box, x0, y0, x1, y1, src, is_line). A box is a written line (is_line) or a table's row; src is the
run of text that a line was extracted with, null where unknown. y grows downwards.

A candidate gutter is the left edge of a box. All that decides on it (boxes on both sides and across, their extents,
lines with a partner on their baseline, runs of text that lie on both sides) changes only at edges, so one sweep over
the edges of a page gives it for all candidates at once; no box meets a candidate in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.scratch import Rounds


@dataclass(frozen=True)
class Columns:
    """What makes a gutter. Four boxes on each side, 18 points of white, sides of at least 35 % of the
    written height; at most half of the lines paired on baselines, at least 60 % of the width filled; baselines
    agree within 3 points."""

    min_boxes: int = 4
    gutter: float = 18.0
    span: float = 0.35
    pairing: float = 0.5
    fill: float = 0.6
    baseline: float = 3.0


RULES = Columns()
REGION = ["page", "region"]

# Places of an event at one x: what ends or begins with it included, the candidate, what begins or ends behind it.
_AT, _CANDIDATE, _BEHIND = 0, 1, 2
_SUMS = ("ended", "started", "across", "lines_ended", "lines_started", "named_ended", "named_started", "paired_left", "paired_right", "both", "mixed")
_LOW = {"left_top": "y0", "left_from": "x0"}
_HIGH = {"left_bottom": "y1", "left_to": "x1", "left_edge": "x1"}


#: Boxes of one task: a sweep holds several wide rows of each.
TASK_BOXES = 100_000


def dealt(boxes: DataFrame, page: str, count: int) -> DataFrame:
    """Whole pages dealt out to as many tasks as `count` boxes need, so that a task's memory doesn't grow with the table."""
    return boxes.repartition(max(boxes.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_BOXES)), page)


def _event(x: Column, place: int, when: Column | None = None, **values: Column) -> Column:
    """A struct of the sweep; null, and left out, where `when` doesn't hold."""
    number = lambda name: F.coalesce(values.get(name, F.lit(0)), F.lit(0)).cast("long").alias(name)
    measure = lambda name: values.get(name, F.lit(None)).cast("double").alias(name)
    names = ("left_edge", "left_top", "left_bottom", "left_from", "left_to", "right_top", "right_bottom", "right_from", "right_to")
    made = F.struct(x.cast("double").alias("x"), F.lit(place).alias("place"), *[number(n) for n in _SUMS], *[measure(n) for n in names])
    return made if when is None else F.when(when, made)


def _sweep(regions: DataFrame, rules: Columns) -> DataFrame:
    """page, region, height, x, place and the deltas of every event."""
    band = f"(partition by page, region, is_line order by y0 range between {rules.baseline}D preceding and {rules.baseline}D following)"
    of_src = Window.partitionBy("page", "region", "src")
    named = F.col("is_line") & F.col("src").isNotNull()
    on = lambda column: F.when(F.col("is_line"), F.col(column))
    b = (
        regions.withColumn("far", F.expr(f"max(x0) over {band}"))
        .withColumn("near", F.expr(f"min(x1) over {band}"))
        .withColumn("src_end", F.when(named, F.min(F.when(named, F.col("x1"))).over(of_src)))
        .withColumn("src_start", F.when(named, F.max(F.when(named, F.col("x0"))).over(of_src)))
        .withColumn("first_of_src", named & (F.row_number().over(of_src.orderBy(F.desc("is_line"), "box")) == 1))
    )
    x0, x1, line, one, less = F.col("x0"), F.col("x1"), F.col("is_line"), F.lit(1), F.lit(-1)
    as_one = lambda c: F.when(c, 1).otherwise(0)
    wide, two_sided = x1 > x0, F.col("src_end") <= F.col("src_start")
    to_far, from_near = line & (x1 <= F.col("far")), line & (F.col("near") <= x0)
    shared, before, behind = named & two_sided, named & ~two_sided & (x0 < F.col("src_start")), named & ~two_sided & (F.col("src_end") < x1)
    events = [
        _event(x0, _CANDIDATE),
        _event(x0, _BEHIND, started=one, lines_started=as_one(line), named_started=as_one(named), right_top=F.col("y0"), right_bottom=F.col("y1"), right_from=on("x0"), right_to=on("x1"),
               across=as_one(wide), paired_right=-as_one(from_near), mixed=as_one((shared & wide) | before)),
        _event(x1, _AT, ended=one, lines_ended=as_one(line), named_ended=as_one(named), left_edge=x1, left_top=F.col("y0"), left_bottom=F.col("y1"), left_from=on("x0"), left_to=on("x1"),
               across=-as_one(wide), paired_left=as_one(to_far), mixed=-as_one((shared & wide) | behind)),
        # a line on the left has a partner as long as the farthest line of its baseline is on the right, and the other way round
        _event(F.col("far"), _BEHIND, to_far, paired_left=less), _event(F.col("near"), _AT, from_near, paired_right=one),
        # a run of text lies on both sides from its first end to its last start; a line lies across while its run is on a side too
        _event(F.col("src_end"), _AT, (F.col("first_of_src") & two_sided) | behind, both=as_one(F.col("first_of_src") & two_sided), mixed=as_one(behind)),
        _event(F.col("src_start"), _BEHIND, (F.col("first_of_src") & two_sided) | before, both=-as_one(F.col("first_of_src") & two_sided), mixed=-as_one(before)),
    ]
    return b.select(*REGION, "height", F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))


def candidates(regions: DataFrame, rules: Columns = RULES) -> DataFrame:
    """page, region, candidate, crossing, gutter, sound: every left edge of a region's boxes as a gutter.

    regions: boxes with region and height, the page's written height. `sound` says whether the gutter stands:
    enough boxes on both sides, tall enough; white enough, or, where it is tight, runs of text that keep to their
    sides, starts apart and sides that fill their width; no run of text on both sides unless paired and full; and not
    the look of labels with amounts (paired on baselines, a side that doesn't fill its width).
    """
    swept = _sweep(regions, rules)
    # events of one place of one x are one row: what a candidate sees doesn't depend on how many boxes share an edge
    sums = [F.sum(n).alias(n) for n in _SUMS]
    lows, highs = ("left_top", "left_from", "right_top", "right_from"), ("left_edge", "left_bottom", "left_to", "right_bottom", "right_to")
    edges = swept.groupBy(*REGION, "x", "place").agg(F.first("height").alias("height"), *sums, *[F.min(n).alias(n) for n in lows], *[F.max(n).alias(n) for n in highs])
    ahead = Window.partitionBy(*REGION).orderBy("x", "place").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*REGION).orderBy(F.desc("x"), F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*REGION)
    seen = edges.select(
        *REGION, "x", "place", "height",
        *[F.sum(n).over(ahead).alias(n) for n in _SUMS],
        *[F.sum(n).over(whole).alias(f"all_{n}") for n in ("started", "lines_started", "named_started")],
        *[F.min(n).over(ahead).alias(n) for n in lows if n.startswith("left")], *[F.max(n).over(ahead).alias(n) for n in highs if n.startswith("left")],
        *[F.min(n).over(back).alias(n) for n in lows if n.startswith("right")], *[F.max(n).over(back).alias(n) for n in highs if n.startswith("right")],
        F.least(F.min("left_from").over(whole), F.min("right_from").over(whole)).alias("margin_left"), F.greatest(F.max("left_to").over(whole), F.max("right_to").over(whole)).alias("margin_right"),
    ).filter(F.col("place") == _CANDIDATE)
    c = seen.withColumn("right", F.col("all_started") - F.col("started")).withColumn("lines_right", F.col("all_lines_started") - F.col("lines_started")).withColumn("named_right", F.col("all_named_started") - F.col("named_started"))
    gutter = F.col("x") - F.col("left_edge")
    lines = (F.col("lines_ended") > 0) & (F.col("lines_right") > 0)
    pairing = F.least(F.try_divide("paired_left", "lines_ended"), F.try_divide("paired_right", "lines_right"))
    room_left, room_right = F.col("right_from") - F.col("margin_left"), F.col("margin_right") - F.col("left_to")
    filled = lambda a, b, room: F.when(room > 0, (F.col(b) - F.col(a)) / room).otherwise(1.0)
    fill = F.least(filled("left_from", "left_to", room_left), filled("right_from", "right_to", room_right))
    c = c.withColumn("gutter", gutter).withColumn("pairing", F.coalesce(pairing, F.lit(0.0))).withColumn("fill", fill).withColumn("lines_both", lines)
    enough = (F.col("ended") >= rules.min_boxes) & (F.col("right") >= rules.min_boxes) & (F.col("all_started") >= 2 * rules.min_boxes)
    split = (F.col("both") > 0) & F.col("lines_both") & ((F.col("pairing") <= rules.pairing) | (F.col("fill") < rules.fill))
    apart = (F.col("named_ended") > 0) & (F.col("named_right") > 0) & (F.col("both") == 0) & (F.col("mixed") == 0) & F.col("lines_both")
    tight = apart & (F.col("right_from") - F.col("left_from") >= rules.gutter) & (F.col("fill") >= rules.fill)
    tall = F.least(F.col("left_bottom") - F.col("left_top"), F.col("right_bottom") - F.col("right_top")) >= rules.span * F.col("height")
    amounts = F.col("lines_both") & (F.col("pairing") > rules.pairing) & (F.col("fill") < rules.fill)
    sound = enough & ~split & ((F.col("gutter") >= rules.gutter) | tight) & tall & ~amounts
    return c.select(*REGION, F.col("x").alias("candidate"), F.col("across").alias("crossing"), "gutter", F.coalesce(sound, F.lit(False)).alias("sound"))


def best_gutters(regions: DataFrame, rules: Columns = RULES) -> DataFrame:
    """page, region, boundary, crossing, gutter: the sound gutter that crosses fewest boxes, then the widest, then the leftmost."""
    merit = F.struct(-F.col("crossing"), F.col("gutter"), -F.col("candidate"))
    best = candidates(regions, rules).filter("sound").groupBy(*REGION).agg(F.max_by(F.struct("candidate", "crossing", "gutter"), merit).alias("b"))
    return best.select(*REGION, F.col("b.candidate").alias("boundary"), F.col("b.crossing").alias("crossing"), F.col("b.gutter").alias("gutter"))


def whole_pages(boxes: DataFrame) -> DataFrame:
    """Every page as one region, with its written height."""
    page = Window.partitionBy("page")
    return boxes.withColumn("region", F.lit("")).withColumn("height", F.max("y1").over(page) - F.min("y0").over(page))


def boundaries(boxes: DataFrame, rules: Columns = RULES) -> DataFrame:
    """page, boundary: all gutters, found by splitting every region of every page at its best one until none has any.

    A round splits all open regions of all pages, so there are as many rounds as the most columns that lie side by
    side in one half of a page, not as pages. Boxes across a gutter belong to neither side.
    """
    rounds = Rounds(boxes.sparkSession, "columns")
    regions, found = rounds.keep(whole_pages(boxes)), None
    while True:
        best = rounds.keep(best_gutters(dealt(regions, "page", regions.count()), rules).select(*REGION, "boundary"))
        found = best if found is None else found.unionByName(best)
        if not best.take(1):
            return found.select("page", "boundary")
        sides = F.array(F.when(F.col("x1") <= F.col("boundary"), "L"), F.when(F.col("x0") >= F.col("boundary"), "R"))
        split = regions.join(best, REGION).withColumn("side", F.explode(F.array_compact(sides)))
        regions = rounds.keep(split.withColumn("region", F.concat("region", "side")).drop("side", "boundary"))


def column_of(x0: Column, x1: Column, gutters: Column) -> Column:
    """0 for what crosses all of a page's gutters, else the number of the column in which it begins, from 1."""
    full = (F.size(gutters) > 0) & F.forall(gutters, lambda g: (x0 < g) & (g < x1))
    return F.when(full, 0).otherwise(1 + F.size(F.filter(gutters, lambda g: x0 >= g)))


def reading_order(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """page, box, column, band, place: boxes by band, column, height and left edge.

    A box that crosses all gutters of its page is read before the columns below it: it opens a band unless the one
    before it, from the top, crosses them too. Pages without a gutter keep the order of `box`, in column 1, band 0.
    """
    gutters = found.groupBy("page").agg(F.array_sort(F.collect_list("boundary")).alias("gutters"))
    b = boxes.join(gutters, "page", "left").withColumn("gutters", F.coalesce("gutters", F.array().cast("array<double>")))
    b = b.withColumn("column", column_of(F.col("x0"), F.col("x1"), F.col("gutters")))
    down = Window.partitionBy("page").orderBy("y0", "x0", "box")
    full = F.col("column") == 0
    opens = full & ~F.lag(full, 1, True).over(down)
    b = b.withColumn("opens", opens.cast("int")).withColumn("band", F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    plain = F.size("gutters") == 0
    keys = [F.when(~plain, F.col(c)) for c in ("band", "column", "y0", "x0")]
    return b.select("page", "box", "column", "band", F.row_number().over(Window.partitionBy("page").orderBy(*keys, "box")).alias("place"))


def baseline_pairing(lines: DataFrame, tolerance: float = RULES.baseline) -> DataFrame:
    """page, lines_left, lines_right, pairing: the smaller share of lines with a partner on their baseline beyond the gutter.

    lines: page, side (L or R), y0. Heights are put into bands of the tolerance's height; a line meets what the other
    side has in its band and the two beside it, of which the lowest and highest are enough, so however many lines
    share a height, a line meets three rows.
    """
    keyed = lines.withColumn("key", F.floor(F.col("y0") / tolerance))
    other = keyed.groupBy("page", F.when(F.col("side") == "L", "R").otherwise("L").alias("side"), "key").agg(F.min("y0").alias("low"), F.max("y0").alias("high"))
    other = other.select("page", "side", "low", "high", F.explode(F.array(F.col("key") - 1, F.col("key"), F.col("key") + 1)).alias("key"))
    met = keyed.groupBy("page", "side", "key", "y0").agg(F.count("*").alias("n")).join(other, ["page", "side", "key"], "left")
    near = F.coalesce((F.abs(F.col("y0") - F.col("low")) <= tolerance) | (F.abs(F.col("y0") - F.col("high")) <= tolerance), F.lit(False))
    at = met.groupBy("page", "side", "y0").agg(F.max("n").alias("n"), F.bool_or(near).alias("paired"))
    shares = at.groupBy("page").agg(*[F.coalesce(F.sum(F.when((F.col("side") == s) & extra, F.col("n"))), F.lit(0)).alias(name) for s, extra, name in (("L", F.lit(True), "lines_left"), ("R", F.lit(True), "lines_right"), ("L", F.col("paired"), "l"), ("R", F.col("paired"), "r"))])
    both = (F.col("lines_left") > 0) & (F.col("lines_right") > 0)
    return shares.select("page", "lines_left", "lines_right", F.when(both, F.least(F.try_divide("l", "lines_left"), F.try_divide("r", "lines_right"))).otherwise(0.0).alias("pairing"))


def merged_numbers(lines: DataFrame, found: DataFrame, max_x: float = 70.0, baseline: float = RULES.baseline, gap: float = 1.0) -> DataFrame:
    """page, box, parts, text, x0, y0, x1, y1: lines, with a number that stands alone at the left joined to the next line.

    lines: page, box (the order of extraction), x0, y0, x1, y1, text, bullet. A number joins the next line on its
    baseline that begins behind it and is no bullet, unless a gutter of the page lies between: that is a barrier. A
    line that was joined can't join its own next, so in a run of lines that could all join, every other one does.
    """
    gutters = found.groupBy("page").agg(F.collect_list("boundary").alias("gutters"))
    order = Window.partitionBy("page").orderBy("box")
    number = F.rtrim(F.regexp_extract("text", r"^(\d+(?:\.\d+)*)\s*$", 1))
    after = F.lead(F.struct("text", "x0", "y0", "x1", "y1", "bullet")).over(order)
    b = lines.join(gutters, "page", "left").withColumn("number", number).withColumn("next", after)
    barred = F.exists(F.coalesce("gutters", F.array().cast("array<double>")), lambda g: (F.col("x1") <= g) & (g <= F.col("next.x0")))
    alone = (F.col("number") != "") & (F.col("x0") < max_x)
    joins = alone & F.col("next").isNotNull() & ~F.col("next.bullet") & (F.abs(F.col("next.y0") - F.col("y0")) <= baseline) & (F.col("next.x0") >= F.col("x1") - gap) & ~barred
    b = b.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("at", F.row_number().over(order))
    # the last line that couldn't join ends an island; the distance to it has the parity
    stop = F.max(F.when(~F.col("joins"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    b = b.withColumn("takes", F.col("joins") & ((F.col("at") - F.coalesce(stop, F.lit(0))) % 2 == 1))
    b = b.withColumn("taken", F.lag("takes", 1, False).over(order)).filter("NOT taken")
    both = lambda c, best: F.when(F.col("takes"), best(F.col(c), F.col(f"next.{c}"))).otherwise(F.col(c)).alias(c)
    shown = F.when(alone, F.col("number")).otherwise(F.col("text"))
    return b.select(
        "page", "box", F.when(F.col("takes"), 2).otherwise(1).alias("parts"), F.when(F.col("takes"), F.concat(F.col("number"), F.lit(" "), F.col("next.text"))).otherwise(shown).alias("text"),
        both("x0", F.least), both("y0", F.least), both("x1", F.greatest), both("y1", F.greatest),
    )
