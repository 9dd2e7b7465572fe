"""Toxicity as graded severity: cumulative-link ordinal regression on sparse word features.

One weight vector serves all thresholds: P(grade <= k) = logistic(cut_k - w.x) with ordered cuts. The expected
severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, pieces

_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def telling_words(labelled: DataFrame, evidence: float = 20.0) -> list[str]:
    """Words that raise the share of toxic texts among labelled ones (toxic, text).

    A word's presence and the label are dependent with a likelihood ratio statistic (G) of at least `evidence`;
    chance words of a large vocabulary stay below it. All of them reach the driver: each stands in several toxic texts
    of the bounded sample, so they are far fewer than its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = [list(word_counts(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])

    sizes = labelled.agg(F.count_if("toxic").alias("n"), F.count_if(~F.col("toxic")).alias("m")).first()
    n, m = sizes["n"], sizes["m"]
    if not n or not m:
        return []
    counted = labelled.mapInArrow(run, "toxic boolean, words array<string>").select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (n + m)
    cells = [(a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share))]
    g = 2 * sum((F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    found = counted.withColumn("g", g).filter((F.col("g") >= evidence) & (a * m > b * n))
    return sorted(r["word"] for r in found.select("word").collect())


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    cuts: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[dict[str, int], int]], words: Iterable[str], levels: int = 3, penalty: float = 3e-6, rounds: int = 800) -> OrdinalModel:
        """Penalised maximum likelihood on (word counts, grade) by Adam.

        A word's value is 1 + log of its count, its weight at least 0: nothing in a text makes up for a slur.

        Grades beyond 1 are learnt as they are, in their order. Where labels are yes or no, a toxic text's grade is
        its place among the toxic ones by the uses of such words: 1 in the lowest of `levels` equal parts (or without
        any), `levels` in the highest; other texts have grade 0.
        """
        toxic = np.array([bool(t) for _, t in rows])
        n_toxic = int(toxic.sum())
        if n_toxic in (0, len(rows)):
            return cls({}, np.full(1, -35.0 if n_toxic else 35.0))
        vocabulary = {w: i for i, w in enumerate(sorted(words))}
        uses = np.array([sum(n for w, n in counts.items() if w in vocabulary) for counts, _ in rows])
        some = np.sort(uses[toxic & (uses > 0)])
        bounds = sorted({int(some[len(some) * k // levels]) for k in range(1, levels)} - {int(some[0])}) if len(some) else []
        grades = np.where(toxic, 1 + np.searchsorted(bounds, uses, "right"), 0)
        top = 1 + len(bounds)
        given = np.array([int(t) for _, t in rows])
        if given.max() > 1:
            kinds = np.unique(np.append(given, 0))
            grades, top = np.searchsorted(kinds, given), len(kinds) - 1
        entries = [(r, vocabulary[w], 1 + np.log(n)) for r, (counts, _) in enumerate(rows) for w, n in counts.items() if w in vocabulary]
        row, column, value = (np.array(x) for x in zip(*entries, strict=True)) if entries else (np.array([], int), np.array([], int), np.array([]))
        n, d = len(rows), len(vocabulary)
        # cuts are the first one and the logs of the gaps after it, which keeps them ordered
        share = np.clip([(grades <= k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        gaps = np.log(np.maximum(np.diff(start), 0.05))
        theta = np.concatenate([np.zeros(d), start[:1], gaps])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            w, cuts = theta[:d], np.concatenate([theta[d : d + 1], theta[d] + np.cumsum(np.exp(theta[d + 1 :]))])
            score = np.bincount(row, weights=value * w[column], minlength=n)
            upto = _sigmoid(np.concatenate([np.full((n, 1), -1e3), cuts[None, :] - score[:, None], np.full((n, 1), 1e3)], axis=1))
            slope = upto * (1 - upto)
            each = np.arange(n)
            p = np.maximum(upto[each, grades + 1] - upto[each, grades], 1e-12)
            by_score = (slope[each, grades + 1] - slope[each, grades]) / p / n
            by_cut = np.zeros((n, top + 2))
            np.add.at(by_cut, (each, grades + 1), -slope[each, grades + 1] / p / n)
            np.add.at(by_cut, (each, grades), slope[each, grades] / p / n)
            cut_gradient = by_cut[:, 1 : top + 1].sum(axis=0)
            later = np.cumsum(cut_gradient[::-1])[::-1]
            gradient = np.concatenate([np.bincount(column, weights=value * by_score[row], minlength=d) + penalty * w, later[:1], later[1:] * np.exp(theta[d + 1 :])])
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            theta[:d] = np.maximum(theta[:d], 0)
        cuts = np.concatenate([theta[d : d + 1], theta[d] + np.cumsum(np.exp(theta[d + 1 :]))])
        return cls({x: float(theta[i]) for x, i in vocabulary.items()}, cuts)

    def score(self, words: dict[str, int]) -> float:
        known = self.weights
        return sum(known[w] * (1 + math.log(n)) for w, n in words.items() if w in known)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return 1 - _sigmoid(self.cuts[None, :] - scores[:, None])


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> OrdinalModel:
    """Fit on a bounded sample: at most about `most_rows` labelled documents.

    The sample's ids and labels go to the tasks that read the documents, its words are counted there, and the
    telling words' counts in its texts reach the driver, of rows with one id those of one row. Learned from are documents whose crc32(doc_id as text)
    mod 4 is not 2, so that the rest can tell the accuracy; of several labels of a document the worst counts, null
    labels and ids don't. Labels are grades: 0 or 1, or further ones of growing severity.
    """
    known = labels.filter("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 != 2").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("grade"))
    share = most_rows / max(1, known.count())
    sample = known.filter(F.abs(F.xxhash64("doc_id") % 1_000_003) < share * 1_000_003) if share < 1 else known
    scratch = Scratch(documents.sparkSession, "toxicity")
    sample = F.broadcast(scratch.keep(sample, "sample"))  # most_rows rows of an id and a flag
    labelled = documents.select("doc_id", "text").filter("text is not null").join(sample, "doc_id")
    words = telling_words(labelled.select((F.col("grade") > 0).alias("toxic"), "text"))
    telling = labelled.sparkSession.sparkContext.broadcast(frozenset(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            counts = [{w: n for w, n in word_counts(t).items() if w in telling.value} for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([list(c.keys()) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["doc_id", "grade", "words", "times"])

    counted = labelled.selectExpr("cast(doc_id as long) doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, words array<string>, times array<int>")
    # an id counts once, however many rows have it, so that the sample keeps its bound
    got = counted.groupBy("doc_id").agg(F.max(F.struct("grade", "words", "times")).alias("x")).select("x.*").toArrow()
    rows = [(dict(zip(w, n, strict=True)), t) for t, w, n in zip(got["grade"].to_pylist(), got["words"].to_pylist(), got["times"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[1], sorted(r[0].items())))
    return OrdinalModel.fit(rows, words)


def severity(documents: DataFrame, model: OrdinalModel, bound: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), grade (the most probable), p_toxic (of grade 1 or more), toxic (p_toxic >= bound).

    Whole texts count. Null and empty texts and texts without a known word have score 0, which is the model's base
    rate; repeated rows stay; a model fitted without toxic rows gives severity 0; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = np.array([model.score(word_counts(t)) if t else 0.0 for t in batch.column("text").to_pylist()])
            above = model.above(scores)
            each = -np.diff(np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1), axis=1)
            columns = [np.round(above.sum(axis=1), 6), each.argmax(axis=1).astype("i4"), np.round(above[:, 0], 6), above[:, 0] >= bound]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return documents.selectExpr(f"cast(`{id_column}` as long) doc_id", f"`{text_column}` text").mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
