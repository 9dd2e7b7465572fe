"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it.

Texts become normalised counts of hashed byte pairs and triples. Linear support vector machines (squared hinge,
L2) separate the families pairwise, and inside each family every pair of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import pieces

# Language families of common ISO 639-1 codes. A code that isn't listed is a family by itself.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
}
UNKNOWN = "und"
BINS = 4096
_LETTER = regex.compile(r"\p{L}")


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes.split()), language)


def _byte_table() -> np.ndarray:
    """Bytes as the features see them: letters in lower case, other ASCII as a space."""
    table = np.arange(256, dtype=np.uint32)
    table[:128] = 32
    for a in range(26):
        table[97 + a] = table[65 + a] = 97 + a
    return table


_TABLE = _byte_table()


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text, in lower case: square roots of its counts of hashed byte pairs and triples, of length one."""
    joined = np.frombuffer(b"  ".join([b"", *texts, b""]), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.repeat(np.arange(len(texts)), lengths + 2)[: len(joined) - 2]
    b = _TABLE[joined]
    pair = b[:-1] << np.uint32(8) | b[1:]
    triple = pair[:-1] << np.uint32(8) | b[2:]
    offset = at.astype(np.int64) * BINS
    counts = np.zeros(len(texts) * BINS)
    for code, keep in ((triple * np.uint32(2654435761) >> np.uint32(20), None), (pair[:-1] * np.uint32(2246822519) >> np.uint32(20), pair[:-1] != 0x2020)):
        code = code.astype(np.int64) + offset
        counts += np.bincount(code if keep is None else code[keep], minlength=len(counts))
    x = np.sqrt(counts.reshape(len(texts), BINS)).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge SVM (y is +1 or -1, classes weighted alike), by Adam on the whole sample."""
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, rounds + 1):
        slack = np.maximum(np.float32(0), 1 - y * (x @ w + b))
        push = -2 * weight * slack * y
        grad = np.append(push @ x + np.float32(penalty) * w, push.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = (0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)).astype(np.float32)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@dataclass
class Pairwise:
    """One-versus-one SVMs over some classes: votes decide, then the sum of margins."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    biases: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Pairwise:
        classes = sorted(set(labels.tolist()))
        model = cls(classes, list(combinations(range(len(classes)), 2)))
        if model.pairs:
            fitted = []
            for i, j in model.pairs:
                rows = (labels == classes[i]) | (labels == classes[j])
                fitted.append(linear_svm(x[rows], np.where(labels[rows] == classes[i], 1.0, -1.0)))
            model.weights = np.array([w for w, _ in fitted], dtype=np.float32).T
            model.biases = np.array([b for _, b in fitted])
        return model

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class's place for each row, and how sure: the least logistic margin of its pairs."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights + self.biases
        votes = np.zeros((len(x), len(self.classes)))
        sure = np.ones((len(x), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            m = margins[:, k]
            p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
            votes[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, j] += (m < 0) - 1e-3 * np.tanh(m)
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
        best = votes.argmax(axis=1)
        return best, sure[np.arange(len(x)), best]


@dataclass
class LanguageModel:
    families: Pairwise
    within: dict[str, Pairwise]

    @classmethod
    def fit(cls, x: np.ndarray, languages: np.ndarray) -> LanguageModel:
        groups = np.array([family_of(x) for x in languages])
        return cls(Pairwise.fit(x, groups), {g: Pairwise.fit(x[groups == g], languages[groups == g]) for g in sorted(set(groups.tolist()))})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.families.predict(x)
        names = np.empty(len(x), dtype=object)
        score = sure.copy()
        for k, g in enumerate(self.families.classes):
            rows = family == k
            if rows.any():
                best, inner = self.within[g].predict(x[rows])
                names[rows] = np.array(self.within[g].classes, dtype=object)[best]
                score[rows] *= inner
        return names.tolist(), score


def training_rows(documents: DataFrame, most_per_language: int = 600) -> DataFrame:
    """The rows to learn from: text and non-null lang where crc32(doc_id as text) mod 4 is not 2.

    At most `most_per_language` rows of a language, those with the least hash of id and text. Rows that agree in both
    share a hash and are taken one by one, so that the bound holds however often an id or a row is repeated. A null
    doc_id is never learned from.
    """
    labelled = documents.select("doc_id", "text", "lang").filter("text is not null and lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
    counts = labelled.groupBy("lang").count().collect()  # one row a language
    share = {r["lang"]: min(1.0, 2 * most_per_language / r["count"] + 1e-5) for r in counts}
    if not share:
        return labelled.limit(0)
    rate = F.create_map(*[x for lang, s in sorted(share.items()) for x in (F.lit(lang), F.lit(s))])
    drawn = labelled.withColumn("draw", F.xxhash64("doc_id", "text"))
    # twice as many as wanted by the hash alone, so that few texts are sorted; then exactly as many
    likely = F.pmod("draw", F.lit(1_000_003)) < F.element_at(rate, F.col("lang")) * 1_000_003
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1_000_003)), "draw"))
    return drawn.filter(likely).withColumn("place", place).filter(F.col("place") <= most_per_language).select("doc_id", "text", "lang")


def fit(documents: DataFrame, most_per_language: int = 600) -> LanguageModel | None:
    """Fit on a bounded sample: feature counts of at most `most_per_language` rows a language reach the driver."""
    schema = "lang string, x binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_000_000, 256):
            x = features([t.lower().encode() for t in batch.column("text").to_pylist()])
            rows = [np.round(r * 65535).astype("<u2").tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "x"])

    got = training_rows(documents, most_per_language).select("lang", "text").mapInArrow(run, schema).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "x"])
    x = np.frombuffer(b"".join(got.x), "<u2").reshape(len(got), BINS).astype(np.float32) / 65535
    return LanguageModel.fit(x, got.lang.to_numpy(dtype=object).astype(str))


def identify(documents: DataFrame, model: LanguageModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every whole text; nothing but the text decides.

    Null texts, texts without a letter, and every text where nothing could be learned get `und` with score 0.
    held_out is whether crc32(doc_id as text) mod 4 is 2 (false for a null id); repeated rows stay.
    """
    schema = "doc_id long, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000, 512):
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                found, sure = model.predict(features([texts[i].lower().encode() for i in known]))
                for i, name in zip(known, found, strict=True):
                    names[i] = name
                scores[known] = sure
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    found = documents.selectExpr(f"cast(`{id_column}` as long) doc_id", f"`{text_column}` text").mapInArrow(run, schema)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, model: LanguageModel | None, text_column: str = "text", min_score: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least `min_score`; all columns stay as they are.

    Rejected are null texts, texts without a letter and those scored below the bound: at 0.5 a pair of languages or
    of families is left open, as in texts of a word or two.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_column, 2_000_000, 512):
            texts = batch.column(text_column).to_pylist()
            keep = np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
            if known:
                keep[known] = model.predict(features([texts[i].lower().encode() for i in known]))[1] >= min_score
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(judge, documents.schema)
