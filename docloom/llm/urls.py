"""URL filters: rules first, then the ratio of two character language models.

URLs that a rule allows or blocks train an accepted and a rejected model. Both are variable-order Markov models:
Witten-Bell smoothing blends each context with its shorter ones, and a context that a class never showed leaves
the word to the shorter one. The verdict on other URLs is the difference of log-likelihoods per character against
a threshold. Of the URLs that rules decided one in HELD_OUT isn't counted by the models: these calibrate it.

Everything is DataFrame functions; the counts are a table that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, lower_ascii

START, STOP = "\x02", "\x03"
#: Of the strings that rules decided, those whose hash is 0 modulo this are kept for the calibration.
HELD_OUT = 5


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with its path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def with_rules(pages: DataFrame, rules: Sequence[Rule], id_column: str, url_column: str) -> DataFrame:
    """id, host, path, and of the longest fitting rule its name (`rule`) and verdict (`ruled`), else nulls."""
    host, path = host_and_path(F.col(url_column))
    parts = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    longest = sorted(rules, key=lambda r: -len(r.name))
    name = ruled = F.lit(None).cast("string")
    for rule in reversed(longest):
        fits = rule.fits(F.col("host"), F.col("path"))
        name = F.when(fits, rule.name).otherwise(name)
        ruled = F.when(fits, rule.verdict).otherwise(ruled)
    return parts.select("page_id", "host", "path", name.alias("rule"), ruled.alias("ruled"))


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of `string` and its end: the character with its `order` predecessors, START before the first."""
    padded = F.concat(F.lit(START * order), F.col("string"), F.lit(STOP))
    starts = F.sequence(F.lit(1), F.length("string") + 1)
    return urls.withColumn("padded", padded).withColumn("at", F.explode(starts)).withColumn("gram", F.substring(F.col("padded"), F.col("at"), F.lit(order + 1))).drop("padded", "at")


def model_table(labelled: DataFrame, scratch: Scratch, order: int = 4) -> DataFrame:
    """gram and llr: log2 of its last character's probability after the others, accepted against rejected.

    labelled: string, accepted (rows that hold it and are accepted), rejected. Strings without either count as
    zeros, so that every gram of the corpus has its row. Counts of shorter grams are sums of the longer ones'.
    """
    counted = _grams(labelled, order).groupBy("gram").agg(F.sum("accepted").alias("n_accepted"), F.sum("rejected").alias("n_rejected"))
    levels = [scratch.keep(counted, "grams")]
    for length in range(order, 0, -1):
        shorter = levels[0].groupBy(F.substring("gram", 2, length).alias("gram")).agg(F.sum("n_accepted").alias("n_accepted"), F.sum("n_rejected").alias("n_rejected"))
        levels.insert(0, scratch.keep(shorter, "grams"))
    classes = ("accepted", "rejected")
    alphabet = levels[0].count() or 1  # at most as many as there are characters in Unicode
    below = None
    for length, grams in enumerate(levels, 1):
        context = F.substring("gram", 1, length - 1)
        stats = grams.groupBy(context.alias("context")).agg(*[f(c) for c in classes for f in (lambda c: F.sum(f"n_{c}").alias(f"all_{c}"), lambda c: F.count_if(F.col(f"n_{c}") > 0).alias(f"kinds_{c}"))])
        joined = grams.withColumn("context", context).join(stats, "context")
        if below is None:
            joined = joined.withColumns({f"below_{c}": F.lit(1.0 / alphabet) for c in classes})
        else:
            joined = joined.withColumn("suffix", F.substring("gram", 2, length - 1)).join(below.withColumnRenamed("gram", "suffix"), "suffix")
        blend = {c: (F.col(f"n_{c}") + F.col(f"kinds_{c}") * F.col(f"below_{c}")) / (F.col(f"all_{c}") + F.col(f"kinds_{c}")) for c in classes}
        probability = {f"p_{c}": F.when(F.col(f"all_{c}") > 0, blend[c]).otherwise(F.col(f"below_{c}")) for c in classes}
        kept = scratch.keep(joined.select("gram", *[p.alias(n) for n, p in probability.items()]), "probabilities")
        below = kept.select("gram", *[F.col(f"p_{c}").alias(f"below_{c}") for c in classes])
    # neither probability is 0: each context leaves something to the shorter one, the shortest to the whole alphabet
    return kept.select("gram", F.log2(F.col("p_accepted") / F.col("p_rejected")).alias("llr"))


def calibrated_threshold(scored: DataFrame) -> float:
    """The score bound with the least sum of both classes' error rates on labelled rows; 0 where a class is absent.

    Scores are counted in steps of 0.01 from -40 to 40: at most 8,001 rows reach the driver. Of equal bounds the
    one nearest 0 is taken.
    """
    step = F.round(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("score"))) * 100).cast("int")
    bins = scored.groupBy(step.alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).orderBy("bin").collect()
    accepted, rejected = sum(x["a"] or 0 for x in bins), sum(x["r"] or 0 for x in bins)
    if not accepted or not rejected:
        return 0.0
    best, lost, kept = (2.0, 0.0, 0.0), 0, rejected
    for x in bins:  # the bound lies just below this bin
        error = lost / accepted + kept / rejected
        best = min(best, (round(error, 12), abs(x["bin"] / 100 - 0.005), x["bin"] / 100 - 0.005))
        lost, kept = lost + (x["a"] or 0), kept - (x["r"] or 0)
    return best[2]


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, order: int = 4, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every URL.

    The verdict is the longest fitting rule's, else allow where the score (log2-likelihood difference per character
    of host + path and their end) is at least the calibrated threshold. Null URLs and URLs without `://` have an
    empty host and path and are scored as the empty string; repeated rows stay and get equal verdicts; with no
    URL decided by a rule all scores are 0 and the rest are allowed; where the held-out URLs lack a class the
    threshold is 0; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    ruled = scratch.keep(with_rules(pages, rules, id_column, url_column).withColumn("string", F.concat("host", "path")), "ruled")
    strings = ruled.groupBy("string").agg(F.count_if(F.col("ruled") == "allow").alias("accepted"), F.count_if(F.col("ruled") == "block").alias("rejected"))
    strings = scratch.keep(strings, "strings")
    held_out = F.pmod(F.xxhash64("string"), F.lit(HELD_OUT)) == 0
    counted = {c: F.when(held_out, 0).otherwise(F.col(c)) for c in ("accepted", "rejected")}
    table = scratch.keep(model_table(strings.withColumns(counted), scratch, order), "model")
    parts = _grams(strings, order).join(table, "gram")
    score = F.round(F.sum("llr") / F.count("*"), 9)
    scored = scratch.keep(parts.groupBy("string").agg(score.alias("score"), F.first("accepted").alias("accepted"), F.first("rejected").alias("rejected")), "scored")
    bound = calibrated_threshold(scored.filter(held_out))
    method = F.when(F.col("score") >= bound, "allow").otherwise("block")
    return ruled.join(scored.select("string", "score"), "string", "left").select("page_id", "host", "path", F.when(F.col("rule").isNotNull(), F.col("rule")).alias("rule"), F.coalesce("ruled", method).alias("verdict"), "score")
