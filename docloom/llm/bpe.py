"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that lies inside no vocabulary token can be crossed by no merge, so it marks a certain cut: a word
falls into fragments that are encoded on their own, and the ids of a text are the fragments' ids in a row. Far
fewer fragments than words exist, which keeps the memo small and the quadratic part of the merging short.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm.common import pieces

#: Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin letters for which the standard library's lower() and letter ranges agree with Unicode's classes.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_NEVER = 1 << 62


class Memo(dict):
    """A memo of a function of one argument, bounded by the bytes that it holds; when full it starts anew.

    `size` gives the bytes of a key; values are bytes. What alone would fill a good part of it isn't kept.
    """

    def __init__(self, function, size, most: int):
        super().__init__()
        self.function, self.size, self.most, self.held = function, size, most, 0

    def __missing__(self, key):
        value = self.function(key)
        cost = self.size(key) + len(value) + 160
        if cost * 64 > self.most:
            return value
        if self.held + cost > self.most:
            self.clear()
            self.held = 0
        self.held += cost
        self[key] = value
        return value


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizers JSON file's text.

    The file must normalise by NFC, white space to one space and lower case, and split by a pattern whose matches
    are the words; other kinds of file are refused.
    """

    def __init__(self, definition: str, memo: int = 112_000_000):
        spec = json.loads(definition)
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"].get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("not a word-end BPE file of the known kind")
        self.end = model["end_of_word_suffix"]
        self.ids = dict(model["vocab"])
        if max(self.ids.values()) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"\s", SPACE))
        self.split_plain = re.compile(pattern.replace(r"\s", SPACE).replace(r"\p{L}", r"a-z\xdf-\xf6\xf8-\u017f").replace(r"\p{N}", "0-9"))
        self.spaces = re.compile(f"[{SPACE}]+")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        by_id = {i: x for x, i in (self.ids | self.special).items()}
        self.names = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.characters = byte_characters()
        pairs = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        # a pair of ids as one number, and its rank with the new id below it: the least such number is the next merge
        self.merges = {self.ids[a] << 16 | self.ids[b]: rank << 16 | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        back = {c: b for b, c in enumerate(self.characters)}
        self.joined = set()
        for token in self.ids:
            inner = token.removesuffix(self.end)
            code = [back[c] for c in inner]
            self.joined.update(zip(code, code[1:], strict=False))
        # a character of a word takes four bytes at most
        self.fragments = Memo(lambda x: array("I", self._merge(x)).tobytes(), lambda x: len(x[0]) + 60, memo * 3 // 7)
        self.words = Memo(self._word, lambda x: 4 * len(x) if not x.isascii() else len(x), memo * 4 // 7)

    def cuts(self, word: bytes) -> list[bytes]:
        """The word's fragments between certain cuts."""
        at = [0, *(i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _merge(self, fragment: tuple[bytes, bool]) -> list[int]:
        """Merge by rank, leftmost first, until no pair is left to merge."""
        data, last = fragment
        names = [self.characters[b] for b in data]
        if last:
            names[-1] += self.end
        ids = [self.ids[x] for x in names]
        if len(ids) > 256:
            return self._merge_long(ids)
        find = self.merges.get
        ranks = [find(a << 16 | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [least & 0xFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = find(ids[i] << 16 | ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = find(ids[i - 1] << 16 | ids[i], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a linked list and a heap of (merge, place); stale entries are known by their units."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        alive = [True] * len(ids)
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                key = ids[i] << 16 | ids[after[i]]
                if key in self.merges:
                    heapq.heappush(heap, (self.merges[key], i, key))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            merge, i, key = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= len(ids) or ids[i] << 16 | ids[j] != key:
                continue
            ids[i], alive[j], after[i] = merge & 0xFFFF, False, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            push(i)
            push(before[i])
        return [x for x, keep in zip(ids, alive, strict=True) if keep]

    def _word(self, word: str) -> bytes:
        """A word's ids, packed as 32-bit integers."""
        parts = self.cuts(word.encode())
        return b"".join([self.fragments[part, i == len(parts) - 1] for i, part in enumerate(parts)])

    def _encode_plain(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            words = self.split_plain.findall(self.spaces.sub(" ", unicodedata.normalize("NFC", text)).lower())
        else:
            text = self.spaces.sub(" ", unicodedata.normalize("NFC", text))
            words = self.split.findall(text.replace("Σ", "σ").lower())
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> array:
        ids = array("I")
        parts = self.special_split.split(text) if self.special_split else [text]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids.frombytes(self._encode_plain(part))
        return ids

    def decode(self, ids: array) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=1)
def _loaded(definition: str) -> WordBpe:
    """One encoder for all tasks of a Python worker, with what it has already merged."""
    return WordBpe(definition)


def encode_table(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids and the decoded text of every whole text: id, ids (array, where asked for), n_tokens, ids_sha256, decoded_sha256.

    `vocabulary` is the path of a tokenizers JSON file on the driver; its text (a few MB) goes to the tasks. Null
    texts count as empty and have no tokens; repeated rows stay; columns other than the two named are not read.
    """
    with open(vocabulary, encoding="utf-8") as file:
        definition = df.sparkSession.sparkContext.broadcast(file.read())
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            bpe = _loaded(definition.value)
            columns: list[list] = [[] for _ in fields]
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = bpe.encode(text or "")
                row = [key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()]
                for column, value in zip(columns, [*row, ids] if with_ids else row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return df.selectExpr(f"cast(`{id_column}` as long) id", f"`{text_column}` text").mapInArrow(run, schema)
