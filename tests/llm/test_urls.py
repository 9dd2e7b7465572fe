import math
from collections import Counter

from docloom.llm import urls


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    stop = next((i for i, c in enumerate(rest) if i >= end and c in "?#"), len(rest))
    lower = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return "".join(lower.get(c, c) for c in rest[:end]), rest[end:stop]


def rule_of(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def brute(rows, held_out, order=4):
    """page -> (host, path, rule, verdict) with models counted in dictionaries, but for the pages held out."""
    parsed = {k: parse(u) for k, u in rows}
    ruled = {k: rule_of(*hp) for k, hp in parsed.items()}
    grams = {True: Counter(), False: Counter()}
    letters = set()
    for k, (h, p) in parsed.items():
        text = urls.START * order + h + p + urls.STOP
        letters |= set(text[order:])
        if ruled[k] and k not in held_out:
            for i in range(order, len(text)):
                for n in range(order + 1):
                    grams[ruled[k].verdict == "allow"][text[i - n : i + 1]] += 1

    following = {side: Counter() for side in grams}
    kinds = {side: Counter() for side in grams}
    for side, counted in grams.items():
        for g, n in counted.items():
            following[side][g[:-1]] += n
            kinds[side][g[:-1]] += 1

    def probability(side, gram):
        below = 1 / len(letters) if len(gram) == 1 else probability(side, gram[1:])
        n, t = following[side][gram[:-1]], kinds[side][gram[:-1]]
        return (grams[side][gram] + t * below) / (n + t) if n else below

    scores = {}
    for k, (h, p) in parsed.items():
        text = urls.START * order + h + p + urls.STOP
        each = [math.log2(probability(True, text[i - order : i + 1]) / probability(False, text[i - order : i + 1])) for i in range(order, len(text))]
        scores[k] = sum(each) / len(each)
    return parsed, ruled, scores


def test_matches_brute_force(spark):
    import support

    rows = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    rows += [(9001, None), (9002, "no scheme"), (9003, "HTTP://Ex.ORG"), (9004, "http://a.b?x=/en/"), (9005, "http://COM/en/x"), (9006, "http://xcom/en/"), (9007, "x://y://z/q#://")]
    del support
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    strings = spark.createDataFrame([(k, "".join(parse(u))) for k, u in rows], "page_id long, string string")
    held_out = {r.page_id for r in strings.filter(f"pmod(xxhash64(string), {urls.HELD_OUT}) = 0").collect()}
    parsed, ruled, scores = brute(rows, held_out)
    for k, _ in rows:
        assert (got[k].host, got[k].path) == parsed[k]
        assert got[k].rule == (ruled[k].name if ruled[k] else None)
        assert abs(got[k].score - scores[k]) < 1e-6
    free = [r for r in got.values() if r.rule is None]
    assert {r.verdict for r in free} == {"allow", "block"}
    assert min(r.score for r in free if r.verdict == "allow") >= max(r.score for r in free if r.verdict == "block")
    assert all(got[k].verdict == r.verdict for k, r in ruled.items() if r)
    steps = {True: [], False: []}
    for k in held_out:
        if ruled[k]:
            steps[ruled[k].verdict == "allow"].append(got[k].score)
    bound = max(r.score for r in free if r.verdict == "block")
    errors = lambda b: sum(x < b for x in steps[True]) / len(steps[True]) + sum(x >= b for x in steps[False]) / len(steps[False])
    assert errors(bound + 1e-9) <= min(errors(b) for b in [*steps[True], *steps[False]]) + 0.05


def test_no_rule_and_empty(spark):
    some = spark.createDataFrame([(1, "http://q.io/"), (1, "http://q.io/"), (None, None)], "page_id long, url string").selectExpr("*", "1 as host", "2 as score", "3 as string")
    got = urls.judge_urls(some).collect()
    assert len(got) == 3 and {r.verdict for r in got} == {"allow"} and {r.score for r in got} == {0.0}
    assert urls.judge_urls(some.limit(0)).count() == 0


def test_main_path_is_native(spark):
    import support

    frame = urls.judge_urls(spark.read.parquet(f"{support.SMALL}/pages.parquet"))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
