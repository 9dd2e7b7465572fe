"""The normaliser with origins: for every character of the normalised text the part of the raw text it comes from.

What Spark's string functions give as `text.normalize` is here computed in Arrow batches, with two arrays of offsets
carried along; a proven quote is taken back to the raw passage with them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as tx

SCHEMA = "norm string, first array<int>, last array<int>"
_ONE_TO_ONE = {ord(c): one for chars, one in ((tx.APOSTROPHES, "'"), (tx.QUOTES, '"'), (tx.DASHES, "-")) for c in chars}
#: Patterns, what becomes of a match, and of which characters a text must hold one, in order; the unification of quotes and
#: dashes stands before the fourth. The last passes over a space that stands alone, as it stays what it is.
_RULES = [
    (re.compile(p), to, signs)
    for p, to, signs in ((r"(?m)^[ \t]*[-–—][ \t]+", " ", "-–—"), (r"«\s*", '"', "«"), (r"\s*»", '"', "»"), (r"-\s*\n\s*", "", "\n"), (r"[\s|" + re.escape(tx.BULLETS) + r"]{2,}|(?! )[\s|" + re.escape(tx.BULLETS) + "]", " ", ""))
]


class _Folds(dict):
    """Character to what it folds to, found once for each character of Unicode that is met."""

    def __missing__(self, c: str) -> str:
        self[c] = found = _folded(c)
        return found


def _folded(c: str) -> str:
    if c.isascii():
        return c.lower()
    plain = "".join(tx.LIGATURES.get(x, x) for x in unicodedata.normalize("NFKD", c))
    return "".join(x for x in plain if not unicodedata.combining(x)).lower().replace(tx.SOFT_HYPHEN, "")


_FOLDS = _Folds()


def _replaced(text: str, first: np.ndarray, last: np.ndarray, pattern: re.Pattern, to: str) -> tuple[str, np.ndarray, np.ndarray]:
    """pattern.sub with offsets: what replaces a match comes from the whole of it."""
    found = [m.span() for m in pattern.finditer(text)]
    if not found:
        return text, first, last
    begin, end = np.array(found).T
    keep = np.ones(len(text), bool)
    for a, b in found:
        keep[a:b] = False
    if to:  # one character, which takes the place of the match's first
        keep[begin] = True
        last = last.copy()
        last[begin] = last[end - 1]
    return pattern.sub(to, text), first[keep], last[keep]


def normalized(raw: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The normalised text, and of each of its characters where its origin begins and ends in `raw`."""
    first = np.arange(len(raw))
    if raw.isascii():
        text = raw.lower()
    else:
        each = [_FOLDS[c] for c in raw]
        text = "".join(each)
        if any(len(_FOLDS[c]) != 1 for c in set(raw)):
            first = np.repeat(first, [len(x) for x in each])
    last = first + 1
    for k, (pattern, to, signs) in enumerate(_RULES):
        if k == 3:
            text = text.translate(_ONE_TO_ONE)
        if not signs or any(c in text for c in signs):
            text, first, last = _replaced(text, first, last, pattern, to)
    bare = text.strip()
    at = len(text) - len(text.lstrip()) if bare else 0
    return bare, first[at : at + len(bare)], last[at : at + len(bare)]


#: "0,1,2,...": the digits that lists of offsets are cut from, and the longest text that they are kept for.
_MOST_DIGITS = 1 << 20


@lru_cache(maxsize=2)
def _digits(count: int) -> tuple[str, np.ndarray]:
    """0 to count - 1 joined by commas, and where each begins (one more at the end)."""
    each = [str(i) for i in range(count)]
    return ",".join(each), np.concatenate([[0], np.cumsum([len(x) + 1 for x in each])])


def joined(offsets: np.ndarray) -> str:
    """Offsets as digits joined by commas; each run of successive ones is cut out of one text as a whole."""
    if not len(offsets):
        return ""
    top = int(offsets.max()) + 1
    if top > _MOST_DIGITS:
        return ",".join(map(str, offsets.tolist()))
    digits, at = _digits(max(1 << 12, 1 << (top - 1).bit_length()))
    breaks = np.flatnonzero(np.diff(offsets) != 1) + 1
    begin, end = offsets[np.concatenate([[0], breaks])], offsets[np.concatenate([breaks - 1, [len(offsets) - 1]])]
    return ",".join([digits[a : b - 1] for a, b in zip(at[begin].tolist(), at[end + 1].tolist(), strict=True)])


def span_digests(text: Column) -> Column:
    """chars, norm, first, last: how long the normalised text is, and MD5 of it and of the offsets of `normalize_spans`, joined by commas. Null for null."""

    @F.pandas_udf("chars int, norm string, first string, last string")
    def run(texts: pd.Series) -> pd.DataFrame:
        digest = lambda x: md5(x.encode(), usedforsecurity=False).hexdigest()
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None, None, None))
            else:
                norm, first, last = normalized(t)
                rows.append((len(norm), digest(norm), digest(joined(first)), digest(joined(last))))
        return pd.DataFrame(rows, columns=["chars", "norm", "first", "last"]).astype({"chars": "Int32"})

    found = run(text)
    return F.when(text.isNotNull(), found)


def normalize_spans(text: Column) -> Column:
    """norm, first, last: for character i of `norm` its origin is the raw text's [first[i], last[i]). Null for null."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else normalized(t) for t in texts]
        return pd.DataFrame(rows, columns=["norm", "first", "last"])

    found = run(text)
    return F.when(text.isNotNull(), found)


def raw_passage(text: Column, quote: Column) -> Column:
    """The raw passage behind the first place of a normalised quote in a text's normalised form; null where it isn't."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, quotes: pd.Series) -> pd.Series:
        out = []
        for t, q in zip(texts, quotes, strict=True):
            at = -1
            if t is not None and q:
                norm, first, last = normalized(t)
                at = norm.find(q)
            out.append(t[first[at] : last[at + len(q) - 1]] if at >= 0 else None)
        return pd.Series(out, dtype=object)

    return run(text, quote)
