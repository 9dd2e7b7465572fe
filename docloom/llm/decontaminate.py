"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts and items are compared in lower case with single spaces. An item of n characters tolerates k = ratio * n
edits. Cut into k + 1 pieces, one piece of it stands unchanged in every passage within k edits, so the pieces say
where item-sized windows of a document are worth embedding. k edits leave at least n - q + 1 - k * q of the item's
q-grams in place, so windows with fewer of them are left out too. Neither loses a passage within k edits.

CGK's random walk reads a string with random pauses that depend on the character under the head. Two strings that
are few edits apart fall into step again after each edit, so their walks differ in few places: edit distance
becomes Hamming distance. Tables of sampled places of a few walks put windows and items into buckets. Walks drift
apart with length, so each class of lengths is measured: where the tables bring at least the target recall of its
items with k random edits, windows that meet are verified first, and most passages are settled by them. Edits may be
such that no table meets (one in each piece, all of a kind), so the windows left that no match lies beside are
verified too, as all are in other classes: no passage within k edits is lost. What is verified is the exact edit
distance between the item and the best substring around the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import Scratch, pieces

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
PAD = 255
#: Items of a length class differ in length by this factor at most.
CLASS = 1.25
#: Length of the q-grams that windows are counted by, and bits of the filter that holds those of an item.
Q, FILTER = 5, 4096
#: Longer items are not walked: no number of tables brings them to a recall worth having.
WALKED = 1_000


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _classes(codes: np.ndarray) -> np.ndarray:
    """Characters as one of 255 classes; the last value is kept for the padding."""
    return (codes % np.uint32(255)).astype(np.uint8)


def _gram_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every window of `length` characters."""
    values = codes.astype(_U) + _U(1)
    values *= values * _U(0xD6E8FEB86659FD93) + _U(0xA0761D6478BD642F)
    n = len(values) - length + 1
    out = np.zeros(max(n, 0), _U)
    for k in range(length if n > 0 else 0):
        out *= _U(_BASE)
        out += values[k : k + n]
    out ^= out >> _U(29)
    out *= _U(0xBF58476D1CE4E5B9)
    return out


def _filter_codes(codes: np.ndarray) -> np.ndarray:
    """The place in an item's filter of every q-gram."""
    return (_gram_hashes(codes, Q) >> _U(64 - FILTER.bit_length() + 1)).astype(np.int16)


class Walks:
    """Random walks: for each step and character class, whether the head moves on."""

    def __init__(self, count: int, steps: int, seed: int):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, size=(count, steps, 256), dtype=np.uint8)
        self.moves[:, :, PAD] = 0

    def embed(self, which: int, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
        """The characters that walk `which` reads of each string classes[start : start + length]."""
        out = np.empty((steps, len(starts)), np.uint8)
        at, ends = starts.astype(np.int64), (starts + lengths).astype(np.int64)
        last = len(classes) - 1
        for j in range(steps):
            c = classes[np.minimum(at, last)]
            c = np.where(at < ends, c, PAD).astype(np.uint8)
            out[j] = c
            at = at + self.moves[which, j][c]
        return out.T


def edits_near(patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray, reach: int, most: np.ndarray | None = None) -> np.ndarray:
    """For each row the least edit distance of its pattern to a substring of its text.

    patterns: rows of codes, `lengths` of them used; texts: rows of codes that begin `reach` before the place where
    the pattern is looked for and go on `reach` beyond its end (unused places hold a code of their own). The table
    is kept by diagonals, for all rows at once; a diagonal more than `reach` off the allowed starts isn't. A row
    whose least value is over its `most` can't come down again: it is left with a distance too large to count.
    """
    n, width = patterns.shape[1], 4 * reach + 1
    kind = np.int16 if reach < 2_000 else np.int32
    steps = np.arange(width, dtype=kind)
    big = kind(10_000 if kind is np.int16 else 1 << 29)
    padded = np.full((len(texts), reach + n + width), -1, np.int32)
    padded[:, reach : reach + texts.shape[1]] = texts
    row = np.where(steps >= reach, 0, big).astype(kind) + np.zeros((len(texts), 1), kind)
    best, live = np.full(len(texts), big), np.arange(len(texts))
    for i in range(1, n + 1):
        differ = padded[:, i - 1 : i - 1 + width] != patterns[:, i - 1 : i]
        row += differ
        row[:, :-1] = np.minimum(row[:, :-1], (row[:, 1:] - differ[:, 1:]) + 1)
        row -= steps
        np.minimum.accumulate(row, axis=1, out=row)
        row += steps
        ends = lengths[live] == i
        if ends.any():
            best[live[ends]] = row[ends].min(axis=1)
        if most is not None and i % 16 == 0:
            keep = (row.min(axis=1) <= most[live]) & (lengths[live] > i)
            if not keep.all():
                row, padded, patterns, live = row[keep], padded[keep], patterns[keep], live[keep]
            if not len(live):
                break
    return best


@dataclass
class Plan:
    """What a task needs of a block of items: pieces, length classes, walks, sampled places and bucket keys."""

    ids: list[int | None]
    texts: list[str]
    edits: np.ndarray
    gram: int
    gram_hash: np.ndarray
    gram_item: np.ndarray
    gram_offset: np.ndarray
    walks: Walks
    places: list[np.ndarray]
    keys: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    begins: np.ndarray
    group: np.ndarray
    tables: dict[int, int]
    bits: int
    grams: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int | None, str]], ratio: float, recall: float, bits: int = 4, walks: int = 3, most_tables: int = 256, seed: int = 11) -> Plan:
        ids, texts = [i for i, _ in items], [t for _, t in items]
        lengths = np.array([len(t) for t in texts])
        edits = (ratio * lengths).astype(int)
        gram = int((lengths // (edits + 1)).min())
        hashes, owners, offsets = [], [], []
        for i, t in enumerate(texts):
            codes, size = _codes(t), len(t) // (edits[i] + 1)
            for p in range(edits[i] + 1):
                hashes.append(_gram_hashes(codes[p * size : p * size + gram], gram)[0])
                owners.append(i)
                offsets.append(p * size)
        order = np.argsort(np.array(hashes, _U), kind="stable")
        rng = np.random.default_rng(seed)
        walked = lengths <= WALKED
        walk = Walks(walks, int(2 * lengths[walked].max(initial=0)) + 1, seed)
        shares = rng.random((most_tables, bits))
        group = np.floor(np.log(lengths) / np.log(CLASS)).astype(int)
        codes, begins = _codes("".join(texts)), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        held = np.zeros((len(texts), FILTER // 8), np.uint8)
        if len(codes) >= Q:
            at, owner = _filter_codes(codes), np.repeat(np.arange(len(texts)), lengths)
            inside = np.arange(len(at)) + Q <= (begins + lengths)[owner[: len(at)]]
            np.bitwise_or.at(held, (owner[: len(at)][inside], at[inside] >> 3), np.left_shift(1, at[inside] & 7).astype(np.uint8))
        plan = cls(ids, texts, edits, gram, np.array(hashes, _U)[order], np.array(owners)[order], np.array(offsets)[order], walk, [shares] * walks, np.zeros((len(texts), most_tables), f"<u{bits}"), lengths, codes, begins, group, {}, bits, held)
        for g in np.unique(group).tolist():
            members = np.flatnonzero(group == g)
            if walked[members].all():
                for a in range(0, len(members), 4096):
                    some = members[a : a + 4096]
                    plan.keys[some] = plan._sampled(_classes(codes), begins[some], some, most_tables)
                plan.tables[g] = most_tables if plan._reaches(members, recall, most_tables, rng) else 0
            else:
                plan.tables[g] = 0
        return plan

    def _sampled(self, classes: np.ndarray, starts: np.ndarray, item: np.ndarray, tables: int) -> np.ndarray:
        """Bucket keys (window, table): the sampled places of item-sized windows; tables take the walks in turn."""
        lengths = self.lengths[item]
        out = np.empty((len(starts), tables, self.bits), np.uint8)
        for w in range(len(self.places)):
            mine = np.arange(w, tables, len(self.places))
            steps = int(2 * lengths.max()) if len(lengths) else 0
            read = self.walks.embed(w, classes, starts, lengths, steps)
            at = (self.places[w][mine][None] * (2 * lengths)[:, None, None]).astype(int)
            out[:, mine] = np.take_along_axis(read, at.reshape(len(starts), -1), axis=1).reshape(at.shape)
        return out.view(f"<u{self.bits}")[:, :, 0]

    def _reaches(self, members: np.ndarray, recall: float, most: int, rng: np.random.Generator, trials: int = 400) -> bool:
        """Whether at least `recall` of a length class is met by `most` tables.

        Each trial puts an item of the class with all its edits, at random places, between other letters, and looks
        at the windows that its unchanged pieces name: these begin where the edits before a piece have shifted them.
        """
        pick = members[rng.integers(0, len(members), trials)]
        letters = sorted(set("".join(self.texts[i] for i in set(pick.tolist()))))
        own: dict[int, list[tuple[int, int]]] = {i: [] for i in pick.tolist()}
        for g in np.flatnonzero(np.isin(self.gram_item, members)).tolist():
            if (i := int(self.gram_item[g])) in own:
                own[i].append((int(self.gram_hash[g]), int(self.gram_offset[g])))
        whole, starts, trial, held = [], [], [], 0
        for n, i in enumerate(pick.tolist()):
            t, k = list(self.texts[i]), int(self.edits[i])
            for _ in range(k):
                p, kind = int(rng.integers(0, len(t))), int(rng.integers(0, 3))
                letter = letters[int(rng.integers(0, len(letters)))]
                t[p : p + (kind != 1)] = [] if kind == 2 and len(t) > 1 else [letter]
            around = ["".join(letters[j] for j in rng.integers(0, len(letters), 2 * k)) for _ in range(2)]
            text = around[0] + "".join(t) + around[1]
            found: dict[int, list[int]] = {}
            for at, h in enumerate(_gram_hashes(_codes(text), self.gram).tolist()):
                found.setdefault(h, []).append(at)
            for s in sorted({at - offset for h, offset in own[i] for at in found.get(h, ()) if abs(at - offset - 2 * k) <= k}):
                starts.append(held + s)
                trial.append(n)
            whole.append(text)
            held += len(text)
        classes, met = _classes(_codes("".join(whole))), np.zeros(trials, bool)
        for a in range(0, len(starts), 4096):
            n = np.array(trial[a : a + 4096])
            meets = self._sampled(classes, np.array(starts[a : a + 4096]), pick[n], most) == self.keys[pick[n]]
            met[n[meets.any(axis=1)]] = True
        return bool(met.mean() >= recall)

    def _may_hold(self, grams: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether enough of the item's q-grams stand in or near each window for a passage within the item's edits."""
        n, k = self.lengths[item], self.edits[item]
        need = n - Q + 1 - k * Q
        low = np.maximum(start - k, bounds[text])
        high = np.minimum(start + n + k, bounds[text + 1] - 1) - Q + 1
        out = need <= 0
        todo = np.flatnonzero(~out & (high > low))
        step = int(np.clip(2_000_000 // ((n + 2 * k).max(initial=1)), 1, 8192))
        for a in range(0, len(todo), step):
            rows = todo[a : a + step]
            at = low[rows, None] + np.arange(int((high - low)[rows].max()))
            inside = at < high[rows, None]
            code = grams[np.where(inside, at, 0)]
            hit = self.grams[item[rows, None], code >> 3] >> (code & 7).astype(np.uint8) & 1
            out[rows] = (hit.astype(bool) & inside).sum(axis=1) >= need[rows]
        return out

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, least edits) of every match in some texts."""
        clean = [normalized(t) for t in texts]
        codes = _codes("\uffff".join([*clean, ""]))
        if len(codes) < self.gram:
            return []
        hashes = _gram_hashes(codes, self.gram)
        seen = np.zeros(1 << 18, bool)
        seen[self.gram_hash >> _U(46)] = True
        hit = np.flatnonzero(seen[hashes >> _U(46)])
        low = np.searchsorted(self.gram_hash, hashes[hit], "left")
        high = np.searchsorted(self.gram_hash, hashes[hit], "right")
        hit, low, high = hit[high > low], low[high > low], high[high > low]
        many = high - low
        at = np.repeat(hit, many)
        gram = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item = self.gram_item[gram]
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in clean])])
        text = np.searchsorted(bounds, at, "right") - 1
        start = np.maximum(at - self.gram_offset[gram], bounds[text])
        if not len(start):
            return []
        windows = np.unique(np.stack([text, item, start]), axis=1)
        windows = windows[:, np.argsort(self.lengths[windows[1]], kind="stable")]
        grams = _filter_codes(codes)
        windows = np.concatenate([w[:, self._may_hold(grams, bounds, *w)] for w in (windows[:, a : a + 65_536] for a in range(0, windows.shape[1], 65_536))], axis=1)
        classes = np.append(_classes(codes), np.full(1, PAD, np.uint8))
        best: dict[tuple[int, int], int] = {}
        group = self.group[windows[1]]
        for g in np.unique(group).tolist():
            mine, tables = windows[:, group == g], self.tables[g]
            left = mine
            if tables:
                meets = np.concatenate([(self._sampled(classes, start, item, tables) == self.keys[item, :tables]).any(axis=1) for _, item, start in (mine[:, a : a + 4096] for a in range(0, mine.shape[1], 4096))])
                settled: dict[tuple[int, int], list[int]] = {}
                for t, i, start in self._verify_all(codes, bounds, mine[:, meets], best):
                    settled.setdefault((t, i), []).append(start)
                left = mine[:, ~meets]
                beside = [any(abs(start - s) <= self.edits[i] for s in settled.get((t, i), ())) for t, i, start in left.T.tolist()]
                left = left[:, ~np.array(beside, bool)]
            self._verify_all(codes, bounds, left, best)
        return [(t, i, e) for (t, i), e in sorted(best.items())]

    def _verify_all(self, codes: np.ndarray, bounds: np.ndarray, windows: np.ndarray, best: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
        """Verify windows in parts of bounded size; those that match."""
        found, a = [], 0
        while a < windows.shape[1]:
            most = 2 * int(self.lengths[windows[1, a : a + 256]].max())
            rows = int(np.clip(4_000_000 // most, 1, 256))
            found += self._verify(codes, bounds, *windows[:, a : a + rows], best)
            a += rows
        return found

    def _verify(self, codes: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, start: np.ndarray, best: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
        """Note the least edits of the windows' items in the text around them, where they are few enough; the windows that match."""
        reach, longest = max(1, int(self.edits[item].max())), int(self.lengths[item].max())
        at = start[:, None] - reach + np.arange(longest + 2 * reach)
        inside = (at >= bounds[text][:, None]) & (at < bounds[text + 1][:, None] - 1)
        around = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)].astype(np.int32), np.int32(-1))
        at = np.arange(longest)
        used = at < self.lengths[item][:, None]
        patterns = np.where(used, self.codes[np.where(used, self.begins[item][:, None] + at, 0)].astype(np.int32), np.int32(-2))
        edits = edits_near(patterns, self.lengths[item], around, reach, self.edits[item])
        found = []
        for t, i, s, e in zip(text.tolist(), item.tolist(), start.tolist(), edits.tolist(), strict=True):
            if e <= self.edits[i]:
                best[t, i] = min(e, best.get((t, i), e))
                found.append((t, i, s))
        return found


def item_blocks(items: DataFrame, id_column: str, text_column: str, most_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The normalised items in blocks of at most most_chars characters, read one by one; empty and null items have none."""
    block, held = [], 0
    for row in items.select(id_column, text_column).filter(f"`{text_column}` is not null").distinct().orderBy(text_column, id_column).toLocalIterator():
        text = normalized(row[1])
        if text:
            size = max(len(text), 200)  # each item costs keys and a filter, however short
            if block and held + size > most_chars:
                yield block
                block, held = [], 0
            block.append((row[0], text))
            held += size
    if block:
        yield block


def _plans(spark: SparkSession, items: DataFrame, id_column: str, text_column: str, ratio: float, recall: float, most_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """A broadcast plan for each block of items, and whether it is the last; a plan that isn't is gone when the next is made."""
    waiting = None
    for block in item_blocks(items, id_column, text_column, most_chars):
        groups: dict[int, list] = {}
        for key, text in block:
            groups.setdefault(0 if len(text) >= 40 else len(text), []).append((key, text))
        for group in groups.values():
            if waiting is not None:
                plan = spark.sparkContext.broadcast(Plan.of(waiting, ratio, recall))
                yield plan, False
                plan.destroy()
            waiting = group
    if waiting is not None:
        yield spark.sparkContext.broadcast(Plan.of(waiting, ratio, recall)), True


def contaminated(documents: DataFrame, items: DataFrame, ratio: float = 0.1, recall: float = 0.98, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", most_chars: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, edits: documents that hold a benchmark item within ratio * length edits.

    Edits are counted in characters after lower-casing and joining white space, against the item's best substring of
    the document. Items go to the tasks in blocks of at most `most_chars` characters, each in its own pass over the
    documents, and only one block is held by the driver at a time, so that what is sent is bounded however many items
    there are; items of very unlike lengths (under 40 characters) get passes of their own. All passages within the
    bound are found; `recall` is what tables must bring to be looked at first. Null and empty texts and items match
    nothing; repeated rows give repeated matches; an item text under several ids is reported under each; an empty
    table on either side gives no rows; other columns are not read.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "leaks")
    texts = documents.selectExpr(f"cast(`{id_column}` as long) doc_id", f"`{text_column}` text").filter("text is not null")
    schema = "doc_id long, item_id long, edits long"
    out = spark.createDataFrame([], schema)
    for plan, last in _plans(spark, items, item_id_column, item_text_column, ratio, recall, most_chars):

        def run(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", 1_000_000, 1_000):
                ids = batch.column("doc_id").to_pylist()
                found = plan.value.find(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, _, _ in found], pa.int64()), pa.array([plan.value.ids[i] for _, i, _ in found], pa.int64()), pa.array([e for _, _, e in found], pa.int64())], ["doc_id", "item_id", "edits"])

        matches = texts.mapInArrow(run, schema)
        out = out.unionByName(matches if last else scratch.keep(matches, "matches"))
    return out


def drop_contaminated(documents: DataFrame, items: DataFrame, ratio: float = 0.1, recall: float = 0.98, text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", most_chars: int = 2_000_000) -> DataFrame:
    """The documents that hold no benchmark item; columns stay as they are.

    Rows are judged one by one by their own text, so that ids don't matter: a leak without an id goes, and a clean
    document that shares its id with a leak stays. Null texts stay.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "clean")
    for plan, last in _plans(spark, items, item_id_column, item_text_column, ratio, recall, most_chars):

        def clean(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_column, 1_000_000, 1_000):
                held = {t for t, _, _ in plan.value.find([t or "" for t in batch.column(text_column).to_pylist()])}
                yield batch.filter(pa.array([t not in held for t in range(batch.num_rows)]))

        kept = documents.mapInArrow(clean, documents.schema)
        documents = kept if last else scratch.keep(kept, "kept")
    return documents
