"""Layout against plain versions that compare every candidate with every box and every page on its own."""

import math
import random
from collections import defaultdict

import pytest

from docloom.operators import layout, pagetext

R = layout.RULES
BOX = "page long, box int, x0 double, y0 double, x1 double, y1 double, src long, is_line boolean, text string, bullet boolean"


def page(seed):
    """Columns of lines with indents, boxes across, tables' rows, labels with amounts, runs of text that cross or not."""
    rnd = random.Random(seed)
    cols, rows = rnd.randint(1, 4), []
    for box in range(rnd.randint(0, 45)):
        k = rnd.randrange(cols)
        x0 = 40 + k * 150 + rnd.choice([0, 0, 0, 4, 9])
        x1 = x0 + rnd.choice([100, 118, 127, 131, 135])
        if rnd.random() < 0.06:
            x0, x1 = 40, 40 + 150 * rnd.randint(1, cols)
        if seed % 5 == 0 and k == cols - 1:
            x0, x1 = x0 + 60, x0 + 85
        if rnd.random() < 0.03:
            x1 = x0
        y0 = 12 * rnd.randrange(25) + rnd.choice([0, 0, 1, 3, 4])
        src = None if seed % 4 == 0 or rnd.random() < 0.05 else (100 * k + y0 // 90 if seed % 4 < 3 else y0 // 90)
        text = rnd.choice(["3.1", "7 ", "12", "words", "3.1 x", "a"])
        rows.append((seed, box, float(x0), float(y0), float(x1), float(y0 + 10), src, rnd.random() > 0.1, text, rnd.random() < 0.1))
    return rows


class Box:
    def __init__(self, row):
        self.page, self.box, self.x0, self.y0, self.x1, self.y1, self.src, self.line, self.text, self.bullet = row


def pairing(left, right):
    def part(side, other):
        return sum(any(abs(o.y0 - b.y0) <= R.baseline for o in other) for b in side) / len(side) if side else 0.0

    return min(part(left, right), part(right, left))


def fill(lines, left, right):
    out = []
    for side, room in ((left, min(b.x0 for b in right) - min(b.x0 for b in lines)), (right, max(b.x1 for b in lines) - max(b.x1 for b in left))):
        out.append((max(b.x1 for b in side) - min(b.x0 for b in side)) / room if room > 0 else 1.0)
    return min(out)


def plain_best(boxes, height):
    lines, found = [b for b in boxes if b.line], []
    for c in {b.x0 for b in boxes} if len(boxes) >= 2 * R.min_boxes else ():
        left, right, across = [b for b in boxes if b.x1 <= c], [b for b in boxes if b.x0 >= c], [b for b in boxes if b.x0 < c < b.x1]
        if min(len(left), len(right)) < R.min_boxes:
            continue
        ll, rl = [b for b in left if b.line], [b for b in right if b.line]
        runs = [{b.src for b in side if b.line and b.src is not None} for side in (left, right, across)]
        gutter = min(b.x0 for b in right) - max(b.x1 for b in left)
        both = bool(ll and rl)
        if runs[0] & runs[1] and both and (pairing(ll, rl) <= R.pairing or fill(lines, ll, rl) < R.fill):
            continue
        if gutter < R.gutter:
            if not (runs[0] and runs[1]) or runs[0] & runs[1] or runs[2] & (runs[0] | runs[1]) or not both:
                continue
            if min(b.x0 for b in rl) - min(b.x0 for b in ll) < R.gutter or fill(lines, ll, rl) < R.fill:
                continue
        if any(max(b.y1 for b in s) - min(b.y0 for b in s) < R.span * height for s in (left, right)):
            continue
        if both and pairing(ll, rl) > R.pairing and fill(lines, ll, rl) < R.fill:
            continue
        found.append((-len(across), gutter, -c))
    return max(found) if found else None


def plain_boundaries(boxes, height):
    best = plain_best(boxes, height)
    if best is None:
        return []
    c = -best[2]
    return sorted([*plain_boundaries([b for b in boxes if b.x1 <= c], height), c, *plain_boundaries([b for b in boxes if b.x0 >= c], height)])


def written(boxes):
    return max(b.y1 for b in boxes) - min(b.y0 for b in boxes)


def plain_order(boxes, bounds):
    def column(b):
        if bounds and all(b.x0 < g < b.x1 for g in bounds):
            return 0
        return 1 + sum(b.x0 >= g for g in bounds)

    band, was_full, out = 0, True, {}
    for b in sorted(boxes, key=lambda b: (b.y0, b.x0, b.box)):
        full = column(b) == 0
        band += full and not was_full
        was_full = full
        out[b.box] = (column(b), band)
    key = (lambda b: (out[b.box][1], out[b.box][0], b.y0, b.x0, b.box)) if bounds else (lambda b: b.box)
    return {(b.page, b.box, *out[b.box], i) for i, b in enumerate(sorted(boxes, key=key), 1)}


@pytest.fixture(scope="module")
def pages():
    return {seed: [Box(r) for r in page(seed)] for seed in range(300) if page(seed)}


@pytest.fixture(scope="module")
def frame(spark, pages):
    return spark.createDataFrame([(b.page, b.box, b.x0, b.y0, b.x1, b.y1, b.src, b.line, b.text, b.bullet) for boxes in pages.values() for b in boxes], BOX).cache()


@pytest.fixture(scope="module")
def bounds(pages):
    return {p: plain_boundaries(boxes, written(boxes)) for p, boxes in pages.items()}


def test_best_gutter(frame, pages):
    got = {r.page: (-r.crossing, r.gutter, -r.boundary) for r in layout.best_gutters(layout.whole_pages(frame)).collect()}
    expected = {p: best for p, boxes in pages.items() if (best := plain_best(boxes, written(boxes)))}
    assert got == expected and len(got) > 40


def test_boundaries_and_order(frame, pages, bounds):
    found = layout.boundaries(frame).cache()
    got = defaultdict(list)
    for r in found.collect():
        got[r.page].append(r.boundary)
    assert {p: sorted(g) for p, g in got.items()} == {p: b for p, b in bounds.items() if b}
    assert {len(b) for b in bounds.values()} >= {0, 1, 2, 3}
    order = {tuple(r) for r in layout.reading_order(frame, found).select("page", "box", "column", "band", "place").collect()}
    assert order == {r for p, boxes in pages.items() for r in plain_order(boxes, bounds[p])}


def test_pairing(spark, pages):
    rows, expected = [], {}
    for p, boxes in pages.items():
        left, right = [b for b in boxes if b.x1 <= 190], [b for b in boxes if b.x0 >= 190]
        rows += [(p, s, b.y0) for s, side in (("L", left), ("R", right)) for b in side]
        if left or right:
            expected[p] = (len(left), len(right), pairing(left, right) if left and right else 0.0)
    rows += [(999, "L", 7.0)] * 3_000 + [(999, "R", 10.0)] * 3_000 + [(999, "R", 14.0)]  # no pair of lines is met one by one
    expected[999] = (3_000, 3_001, 3_000 / 3_001)
    result = layout.baseline_pairing(spark.createDataFrame(rows, "page long, side string, y0 double"))
    assert {r.page: (r.lines_left, r.lines_right, pytest.approx(r.pairing)) for r in result.collect()} == expected
    assert "NestedLoop" not in result._jdf.queryExecution().toString() and "Cartesian" not in result._jdf.queryExecution().toString()


def test_number_lines(spark, frame, pages, bounds):
    import re

    expected = set()
    for p, boxes in pages.items():
        i = 0
        while i < len(boxes):
            b, n = boxes[i], boxes[i + 1] if i + 1 < len(boxes) else None
            m = re.match(r"^(\d+(?:\.\d+)*)\s*$", b.text)
            alone = bool(m) and b.x0 < 70
            if alone and n and not n.bullet and abs(n.y0 - b.y0) <= 3 and n.x0 >= b.x1 - 1 and not any(b.x1 <= g <= n.x0 for g in bounds[p]):
                expected.add((p, b.box, 2, f"{m.group(1)} {n.text}", min(b.x0, n.x0), max(b.x1, n.x1)))
                i += 1
            else:
                expected.add((p, b.box, 1, m.group(1) if alone else b.text, b.x0, b.x1))
            i += 1
    got = {(r.page, r.box, r.parts, r.text, r.x0, r.x1) for r in layout.merged_numbers(frame, layout.boundaries(frame)).collect()}
    assert got == expected


def test_numbers_take_every_other(spark):
    """Five numbers on one baseline: the first joins the second, the third the fourth; a gutter is a barrier."""
    rows = [(1, i, 40.0 + 5 * i, 0.0, 44.0 + 5 * i, 10.0, None, True, str(i), False) for i in range(5)]
    found = spark.createDataFrame([(1, 56.0)], "page long, boundary double")
    f = spark.createDataFrame(rows, BOX)
    got = [(r.box, r.text) for r in layout.merged_numbers(f, found.limit(0)).orderBy("box").collect()]
    assert got == [(0, "0 1"), (2, "2 3"), (4, "4")]
    assert [(r.box, r.text) for r in layout.merged_numbers(f, spark.createDataFrame([(1, 44.5)], "page long, boundary double")).orderBy("box").collect()] == [(0, "0"), (1, "1 2"), (3, "3 4")]


def test_empty_pages(spark):
    none = spark.createDataFrame([], BOX)
    assert layout.boundaries(none).collect() == [] and layout.reading_order(none, layout.boundaries(none)).collect() == []


def test_running_lines(spark):
    rnd, rows = random.Random(3), []
    for p in range(40):
        for line in range(12):
            y0 = rnd.choice([10, 30, 39, 40, 300, 755, 790])
            text = rnd.choice(["HOME", "Guide 2020", f"Page {p} of 40", f"{p}", "1234", "body text", "caps", "CAPS"])
            rows.append(("b" if p % 4 else "c", p, line, y0, y0 + 8, 800, text, rnd.choice([8, 12]), rnd.random() < 0.3))
    expected = set()
    for book in "bc":
        mine = [r for r in rows if r[0] == book]
        least = max(2, math.ceil(len({r[1] for r in mine}) * 0.3))
        in_band = lambda r: r[3] < 40 or r[4] > r[5] - 40
        mask = lambda t: "".join("#" if k else s for k, s in runs(t))
        seen, turned = defaultdict(int), defaultdict(set)
        for r in mine:
            seen[r[6]] += in_band(r)
            if r[8]:
                turned[mask(r[6])].add(r[1])
        for r in mine:
            if in_band(r) and (seen[r[6]] >= least or (r[6].isdigit() and len(r[6]) <= 3) or (r[7] <= 10 and r[6] == r[6].upper())):
                expected.add((*r[:3], "running_band"))
            elif r[8] and len(turned[mask(r[6])]) >= least:
                expected.add((*r[:3], "turned_title"))
    f = spark.createDataFrame(rows, "book string, page long, line int, y0 int, y1 int, height int, text string, size int, turned boolean")
    assert {(r.book, r.page, r.line, r.motive) for r in pagetext.running_lines(f).collect()} == expected


def runs(text):
    out = []
    for ch in text:
        if ch.isdigit() and out and out[-1][0]:
            out[-1] = (True, out[-1][1] + ch)
        else:
            out.append((ch.isdigit(), ch))
    return out


def test_conservation(spark):
    source = spark.createDataFrame([(u,) for u in "abcdefg"], "uid string")
    carried = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "3"), ("z", "4"), ("y", "4"), ("y", "5")], "uid string, block string")
    removed = spark.createDataFrame([("c", "band"), ("d", "band"), ("b", "turned")], "uid string, motive string")
    found, counts = pagetext.conservation(source, carried, removed)
    got = {tuple(r) for r in found.collect()}
    assert got == {("b", "several", 2, "turned"), ("c", "both", 1, "band"), ("e", "lost", 0, None), ("f", "lost", 0, None), ("g", "lost", 0, None), ("z", "unknown", 1, None), ("y", "unknown", 2, None)}
    assert counts.get == {"lines": 7, "carried": 3, "removed": 3}


def test_contents_pages(spark):
    rnd, rows, expected = random.Random(9), [], set()
    for book in range(120):
        state = 0
        for p in range(rnd.randint(1, 9)):
            entries, other, article = rnd.random() < 0.6, rnd.random() < 0.3, rnd.random() < 0.25
            rows.append((book, p, entries, other, article))
            inside = entries if state == 0 else state == 1 and entries and not other
            if state == 0 and entries or state == 1:
                state = 2 if not inside or article else 1
            expected.add((book, p, inside, state == 2 and not inside))
    f = spark.createDataFrame(rows, "book long, page long, entries boolean, other boolean, article boolean")
    assert {tuple(r) for r in pagetext.contents_pages(f).collect()} == expected


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_outline(spark, chunk):
    rnd, rows, expected = random.Random(4), [], set()
    for book in range(15):
        stack = []
        for o in range(rnd.randint(1, 60)):
            level = rnd.choice([1, 2, 2, 3, 3, 3, 5, 8])
            rows.append((book, o, level))
            while stack and stack[-1][1] >= level:
                stack.pop()
            expected.add((book, o, level, stack[-1][0] if stack else None, len(stack)))
            stack.append((o, level))
    got = {tuple(r) for r in pagetext.outline(spark.createDataFrame(rows, "book long, ord long, level int"), chunk).collect()}
    assert got == expected


def test_printed_entries(spark, frame, pages):
    import re

    rnd, rows, expected = random.Random(6), [], set()
    for p, boxes in pages.items():
        texts = {b.box: rnd.choice(["1.2 Cover ..... 14", "3 Short 7", "2.1 Title of", "4. Another .", "12", "31", "goes on", "and on.", ". .", "words"]) for b in boxes}
        lines = [(p, b.box, 500.0 if texts[b.box].isdigit() and rnd.random() < 0.8 else b.x0, b.y0, b.x1, b.y1, texts[b.box]) for b in boxes]
        rows += lines
        starts = []
        for r in lines:
            if m := re.match(r"^\s*(\d+(?:\.\d+)*)\.?\s+(.+?)(?:\s+\.{2,}\s*|\s+)(\d{1,3})\s*$", r[6]):
                expected.add((p, r[1], m.group(1), m.group(2).strip(" ."), 1))
            elif m := re.match(r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", r[6]):
                starts.append((r, m))
        heads = {r[1] for r, _ in starts}
        entries = {k[1] for k in expected if k[0] == p}
        for r, m in starts:
            until = min([o[3] for o, _ in starts if o[3] > r[3] and abs(o[2] - r[2]) <= 80], default=800.0)
            edges = [n[2] for n in lines if n[6].isdigit() and n[2] > r[2] and abs(n[3] - r[3]) <= 8]
            if not edges:
                continue
            title, bottom = [m.group(2).strip(" .")], r[5]
            below = [c for c in lines if r[3] < c[3] < until and c[2] >= r[2] - 5 and c[4] < min(edges) and not c[6].isdigit() and c[1] not in heads and c[1] not in entries]
            for c in sorted(below, key=lambda c: (c[3], c[2], c[1])):
                if c[3] - bottom > 1.5 * max(c[5] - c[3], 1.0):
                    break
                title.append(c[6].strip(" ."))
                bottom = c[5]
            expected.add((p, r[1], m.group(1), " ".join(t for t in title if t), len(title)))
    f = spark.createDataFrame(rows, "page long, box int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [tuple(r) for r in pagetext.printed_entries(f, 800.0).select("page", "box", "number", "title", "parts").collect()]
    assert len(got) == len(set(got)) and set(got) == expected and max(r[4] for r in got) > 2
    assert set(map(tuple, pagetext.printed_entries(f, 800.0, bucket=7.0).select("page", "box", "number", "title", "parts").collect())) == expected


def test_grid_cells(spark, frame, pages):
    expected = set()
    for p, boxes in pages.items():
        rank = {}
        for edge in ("x0", "y0"):
            n, last = 0, None
            for v in sorted({getattr(b, edge) for b in boxes}):
                n += last is None or v - last > 3
                last = v
                rank[edge, v] = n
        cells = defaultdict(list)
        for b in sorted(boxes, key=lambda b: (b.y0, b.x0, b.box)):
            cells[p, rank["y0", b.y0], rank["x0", b.x0]].append(b.text)
        expected |= {(*k, "\n".join(v)) for k, v in cells.items()}
    assert {tuple(r) for r in pagetext.grid_cells(frame).collect()} == expected


def test_tool_calls(spark):
    from docloom.operators import calls

    nodes = spark.createDataFrame([("w", None), ("a", "w"), ("b", "w"), ("c", "a")], "node_id string, parent_id string")
    blocks = spark.createDataFrame([("a", 7, 2), ("a", 9, 1), ("c", 4, 1)], "node_id string, block_id long, ord long")
    lines = spark.createDataFrame([("1", ["fire", "loss"]), ("2", ["loss"]), ("3", ["water", "fire"])], "line string, words array<string>")
    asked = [(1, "contents", "w"), (2, "contents", "c"), (3, "contents", "zz"), (4, "open", "a"), (5, "open", "b"), (6, "open", None), (7, "search", "fire"), (8, "search", "hail"), (9, "search", ""), (10, "search", None), (11, "definitions", "loss"), (12, "fetch", "x"), (13, None, "x"), (4, "open", "a")]
    got = sorted(tuple(r) for r in calls.answered(spark.createDataFrame(asked, "call long, tool string, arg string"), nodes, blocks, lines).select("call", "ok", "n", "first", "error").collect())
    assert got == [
        (1, True, 2, "a", None), (2, True, 0, None, None), (3, False, None, None, "unknown node"), (4, True, 2, "9", None), (4, True, 2, "9", None), (5, True, 0, None, None), (6, False, None, None, "unknown node"),
        (7, True, 2, "1", None), (8, True, 0, None, None), (9, False, None, None, "empty word"), (10, False, None, None, "empty word"), (11, True, 1, "2", None), (12, False, None, None, "unknown tool"), (13, False, None, None, "unknown tool"),
    ]


def test_body_lines_meet_no_counts(spark):
    from docloom.operators import pagetext

    rows = spark.createDataFrame([("b", 1, 0, 10, 20, 800, "head", 11, False), ("b", 2, 0, 10, 20, 800, "head", 11, False), ("b", 1, 1, 100, 110, 800, "head", 11, False)], "book string, page int, line int, y0 int, y1 int, height int, text string, size int, turned boolean")
    found = pagetext.running_lines(rows)
    assert sorted((r.page, r.line, r.motive, r.seen) for r in found.collect()) == [(1, 0, "running_band", 2), (2, 0, "running_band", 2)]
    assert "OR turned#" in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_hold_a_bounded_number_of_boxes(spark):
    from docloom.operators import layout

    pages = spark.range(10).withColumnRenamed("id", "page")
    assert layout.dealt(pages, "page", 12 * layout.TASK_BOXES).rdd.getNumPartitions() == 12
    assert layout.dealt(pages, "page", 0).count() == 10
