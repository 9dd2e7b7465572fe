"""Operators on hand-made rows that the supplied tables don't have."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import intervals, search, tree
from docloom.plans.evidence_q import quote_places
from docloom.plans.shapes_q import union_area
from docloom.plans.verify_q import found_across_breaks, joined_leads, resolved_definitions
from docloom.scratch import Rounds


def test_closure_of_a_deep_tree(spark):
    """A chain of 40 nodes with a side branch at each: every ancestor counts, however far up."""
    rows = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 40)] + [(f"s{i}", f"n{i}") for i in range(40)]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string")
    parent = dict(rows)
    want = set()
    for node in parent:
        up, distance = node, 0
        while up is not None:
            want.add((up, node, distance))
            up, distance = parent[up], distance + 1
    got = [tuple(r) for r in tree.closure(nodes).collect()]
    assert len(got) == len(want) and set(got) == want


def test_closure_of_no_tree_and_of_a_cycle(spark):
    empty = spark.createDataFrame([], "node_id string, parent_id string")
    assert tree.closure(empty).count() == 0
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], empty.schema)
    assert ("a", "a") in {(r.ancestor, r.descendant) for r in tree.closure(cycle).filter("distance > 0").collect()}


def test_holders(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc1") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    terms = ["a", "ab", "abc", "bca1", "1", "zz", "cabab"]
    got = {(r.term, r.token) for r in search.holders(spark.createDataFrame([(w,) for w in words], "token string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(t, w) for t in terms for w in set(words) if t in w}


def test_quotes_of_few_words(spark):
    """Quotes without an inner word are found too, inside words as well; those without any word aren't."""
    texts = {1: "The incomprehensibilities Characterizing it", 2: "nothing of the kind", 3: "re-characterizing it", 4: None}
    quotes = {1: "incomprehensibilities characterizing", 2: "comprehensib", 3: "it", 4: "kind nothing", 5: "!!", 6: "ITIES char", 7: "of the kind", 8: None, 9: "acterizing it"}
    found = quote_places(spark.createDataFrame(list(quotes.items()), "item_id long, text string"), spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {(r.item_id, r.doc_id): r.start for r in found.collect()}
    want = {(i, d): t.lower().find(q.lower()) + 1 for i, q in quotes.items() if q and q != "!!" for d, t in texts.items() if t and q.lower() in t.lower()}
    assert got == want


def test_quotes_across_line_breaks(spark):
    """Only spaces born of a line break may be missing; the span is the normalised text's."""
    rows = [("food in the freezer and/\nor the fridge", "and/or the fridge"), ("food in the freezer and/ or the fridge", "and/or the fridge"), ("a\n b\tc", "ab c"), ("a\n b\tc", "abc"), ("- one\n- two three", "onetwo three"), ("x |\n y z", "xy z"), ("soft-\nened here", "softened here")]
    frame = spark.createDataFrame(rows, "text string, quote string")
    got = [r.x for r in frame.select(found_across_breaks(F.col("text"), F.col("quote")).alias("x")).collect()]
    assert [(x.first, x.last) if x else None for x in got] == [(21, 38), None, (1, 5), None, (1, 13), (1, 5), (1, 13)]


def test_definitions_by_the_deepest_scope(spark):
    up = tree.closure(spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "r")], "node_id string, parent_id string"))
    definitions = spark.createDataFrame([(1, "t", "r", None, 1), (2, "t", "a", None, 2), (3, "t", None, None, 3), (4, "t", "b", 2, 4), (5, "u", None, None, 5), (6, "u", None, 5, 6), (7, "v", "a", None, 7)], "block_id long, term string, scope string, overrides long, rank long")
    contexts = spark.createDataFrame([("t", "b"), ("t", "a"), ("t", "c"), ("u", "c"), ("v", "c"), ("v", "b"), ("t", None), ("v", None), ("w", None)], "term string, node_id string")
    got = {(r.term, r.node_id): r.block_id for r in resolved_definitions(definitions, contexts, up).collect()}
    assert got == {("t", "b"): 4, ("t", "a"): 2, ("t", "c"): 1, ("u", "c"): 6, ("v", "b"): 7, ("t", None): 3, ("v", None): 7}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_definitions_against_every_pair(spark, seed):
    """Scopes settled once give what comparing every definition with every node below it gives."""
    rnd = random.Random(seed)
    parent = {0: None, **{i: rnd.randrange(max(0, i - 6), i) for i in range(1, 30)}}
    above = {i: [i] for i in parent}
    for i in parent:
        while parent[above[i][-1]] is not None:
            above[i].append(parent[above[i][-1]])
    up = spark.createDataFrame([(f"n{a}", f"n{i}", k) for i, chain in above.items() for k, a in enumerate(chain)], "ancestor string, descendant string, distance int")
    rows = [(i, rnd.choice("tuv"), rnd.choice([None, *parent, *parent]), rnd.choice([None, rnd.randrange(200)]), rnd.randrange(10_000) * 200 + i) for i in range(200)]
    rows = [(b, t, None if s is None else f"n{s}", o, r) for b, t, s, o, r in rows]
    expected = {}
    for t in "tuv":
        mine = [x for x in rows if x[1] == t]
        hidden = {x[3] for x in mine if x[2] is None}
        common = min(((x[4], x[0]) for x in mine if x[2] is None and x[0] not in hidden), default=None)
        for i, chain in above.items():
            depth = {f"n{a}": k for k, a in enumerate(chain)}
            covering = [x for x in mine if x[2] in depth]
            out = {x[3] for x in covering}
            kept = min(((depth[x[2]], x[4], x[0]) for x in covering if x[0] not in out), default=None)
            found = kept if covering else common
            if found:
                expected[t, f"n{i}"] = found[-1]
    definitions = spark.createDataFrame(rows, "block_id long, term string, scope string, overrides long, rank long")
    contexts = spark.createDataFrame([(t, f"n{i}") for t in "tuv" for i in parent], "term string, node_id string")
    assert {(r.term, r.node_id): r.block_id for r in resolved_definitions(definitions, contexts, up).collect()} == expected


def test_definitions_of_a_scope_meet_its_nodes_once(spark, monkeypatch):
    """However many definitions a scope has, only its first goes to the nodes below."""
    kept = []
    keep = Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, frame: kept.append(keep(self, frame)) or kept[-1])
    up = spark.createDataFrame([("r", "r", 0), *[("r", f"n{i}", 1) for i in range(50)], *[(f"n{i}", f"n{i}", 0) for i in range(50)]], "ancestor string, descendant string, distance int")
    definitions = spark.createDataFrame([(i, "t", "r", None, i) for i in range(400)], "block_id long, term string, scope string, overrides long, rank long")
    found = resolved_definitions(definitions, spark.createDataFrame([("t", f"n{i}") for i in range(50)], "term string, node_id string"), up)
    assert {r.block_id for r in found.collect()} == {0} and found.count() == 50
    assert [f.count() for f in kept if "partly" in f.columns] == [1]


def test_lead_ins_join_once_and_add_no_second_kind(spark):
    cited = spark.createDataFrame([("k", 1, "guarantee", 1), ("k", 2, "paragraph", 2), ("m", 3, "paragraph", 1), ("m", 4, "paragraph", 2), ("n", 5, "guarantee", 1), ("n", 6, "exclusion", 2), ("o", 7, "paragraph", 1), ("o", 10, "guarantee", 2)], "claim string, block_id long, kind string, ord long")
    leads = spark.createDataFrame([(1, 10), (2, 11), (3, 11), (4, 10), (5, 10), (7, 10), (6, 12)], "block_id long, lead_id long")
    kinds = spark.createDataFrame([(10, "guarantee"), (11, "condition"), (12, "paragraph")], "lead_id long, lead_kind string")
    got = {tuple(r) for r in joined_leads(cited, leads, kinds.select("lead_id"), kinds).collect()}
    assert got == {("k", 1, 10), ("m", 3, 11), ("n", 6, 12)}


def test_area_of_a_union(spark):
    rows = [(1, 0, 0, 4, 4), (1, 2, 2, 6, 6), (1, 2, 2, 3, 3), (1, 9, 9, 9, 12), (2, 0, 0, 1, 1), (2, 5, 5, 7, 6), (3, 0, 0, 10, 1), (3, 0, 0, 1, 10), (3, 4, 0, 5, 9)]
    got = {r.page: r.area for r in union_area(spark.createDataFrame(rows, "page long, x0 long, y0 long, x1 long, y1 long")).collect()}
    assert got == {1: 28, 2: 3, 3: 27}


def test_area_of_full_pages(spark):
    """Pages of many rectangles, long ones across and small ones, against counted cells."""
    rng, rows = random.Random(5), []
    for page, n in ((1, 150), (2, 60), (3, 2)):
        for _ in range(n):
            x, y = rng.randrange(100), rng.randrange(100)
            wide, high = rng.choice([(1, 5), (60, 2), (2, 60), (9, 9), (0, 4), (90, 1)])
            rows.append((page, x, y, x + wide, y + high))
    want = {p: len({(x, y) for q, x0, y0, x1, y1 in rows if q == p for x in range(x0, x1) for y in range(y0, y1)}) for p in (1, 2, 3)}
    schema = "page long, x0 long, y0 long, x1 long, y1 long"
    assert {r.page: r.area for r in union_area(spark.createDataFrame(rows, schema)).collect()} == want
    assert {r.page: r.area for r in union_area(spark.createDataFrame(rows + rows, schema).repartition(7)).collect()} == want
    assert union_area(spark.createDataFrame([], schema)).collect() == []


def test_intervals_that_hold_points(spark):
    rng = random.Random(11)
    spans = [(rng.randrange(3), i, lo, lo + rng.choice([-1, 0, 1, 2, 3, 7, 8, 60, 1000])) for i in range(300) for lo in [rng.randrange(-50, 400)]]
    points = [(rng.randrange(4), i, rng.randrange(-60, 500)) for i in range(200)]
    found = intervals.holding(spark.createDataFrame(points, "owner long, uid long, at long"), spark.createDataFrame(spans, "owner long, span long, lo long, hi long"))
    got = sorted((r.uid, r.span) for r in found.collect())
    assert got == sorted((u, s) for o, u, at in points for p, s, lo, hi in spans if o == p and lo <= at <= hi)


def test_one_owner_with_many_intervals(spark):
    """100,000 intervals of one owner and as many points: no pairs of an owner are made."""
    spans = spark.range(100_000).select(F.lit(1).alias("owner"), F.col("id").alias("span"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 1 + F.col("id") % 8).alias("hi"))
    points = spans.select("owner", F.col("span").alias("uid"), (F.col("lo") + 1).alias("at"))
    found = intervals.holding(points, spans)
    assert found.count() == 100_000 and found.filter("uid <> span").count() == 0


def test_subtrees_that_hang_together_otherwise_differ(spark):
    """A{B} isn't A, B; a chain isn't a root with two children; order counts."""
    rows = [("w", None, 0, 0), ("a1", "w", 1, 1), ("b1", "a1", 2, 1), ("a2", "w", 1, 2), ("b2", "w", 1, 3), ("a3", "w", 1, 4), ("b3", "a3", 2, 9), ("c1", "w", 1, 5), ("x1", "c1", 2, 1), ("y1", "c1", 2, 2), ("c2", "w", 1, 6), ("y2", "c2", 2, 1), ("x2", "c2", 2, 2), ("c3", "w", 1, 7), ("x3", "c3", 2, 1), ("y3", "x3", 3, 1)]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, level int, key long")
    own = nodes.select("node_id", F.substring("node_id", 1, 1).alias("h"))
    digest = {r.node_id: r.digest for r in tree.subtree_digests(nodes, own).collect()}
    assert digest["a1"] == digest["a3"] != digest["a2"] and digest["b1"] == digest["b2"] == digest["b3"]
    assert len({digest[c] for c in ("c1", "c2", "c3")}) == 3 and digest["x1"] == digest["x2"] != digest["x3"]


def test_structure_bytes_of_whole_bases(spark, tmp_path):
    """A base of more than 40 parts is one text, as are the others."""
    from docloom.plans.catalog import QUERIES

    parts = [(i, "Brand#11" if i % 3 else "Brand#24", i % 50) for i in range(300)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.p_brand: (r.bytes, r.nodes, r.total) for r in QUERIES["s18_structure_bytes"](spark, str(tmp_path)).collect()}
    text = lambda b: '{"doc": "' + b + '", "nodes": [' + ", ".join(f'{{"id": {i}, "size": {s}}}' for i, x, s in parts if x == b)
    own = [s for _, b, s in parts if b == "Brand#11"]
    assert found == {"Brand#11": (len(text("Brand#11")) + 2, 200, sum(own)), "Brand#24": (len(text("Brand#24")), None, None)}


def test_exclusions_of_section_form_no_pairs(spark):
    """Sections of one parent meet its exclusions as a count, never one by one."""
    import support

    from docloom.plans.catalog import QUERIES

    plan = QUERIES["t11_exclusions_of_section"](spark, support.SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "of#" in line and "exclusion#" in line.replace("is_exclusion#", "")]


def test_places_nearby_meet_once(spark, tmp_path, monkeypatch):
    """Points and shops that share their place meet as one pair of places."""
    from docloom.plans import joins_q

    spark.range(3000).selectExpr("id * 211 * 307 as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2000).selectExpr("id * 97 * 89 as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    pairs, meet = [], joins_q.nearby
    monkeypatch.setattr(joins_q, "nearby", lambda *a: pairs.append(meet(*a)) or pairs[-1])
    rows = joins_q.j10(spark, str(tmp_path)).collect()
    assert len(rows) == 3000 and {(r.n, r.nearest, r.metres) for r in rows} == {(2000, 0, 0.0)}
    assert pairs[0].count() == 1


def test_first_after_in_one_pass(spark):
    """The next value behind each row, with a frame that only grows, as one that reaches to the end is read again for every row."""
    rows = [(i % 2, i, None if i % 5 else i) for i in range(60)]
    found = spark.createDataFrame(rows, "k int, at int, v int").withColumn("next", tree.first_after(F.col("v"), F.col("at"), ["k"]))
    want = {i: next((v for k, j, v in rows if k == i % 2 and j > i and v is not None), None) for _, i, _ in rows}
    assert {r["at"]: r["next"] for r in found.collect()} == want
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
