"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document is the set of its word shingles. SuperMinHash draws a random permutation of the signature's slots for
each element step by step, adds the step's number to a fresh uniform value, and stops as soon as no slot can fall
further; ranks of one element are correlated, which lowers the variance against independent hashes.

Texts with equal sets are one node from the start. Bands of the signature put nodes into buckets, and every bucket
has a leader, the node that meets most others. Links are found in three rounds, with a union-find after each, and
buckets whose nodes are all in one group are done:

1. each node is compared with the weightiest of its leaders, its base;
2. in buckets still in several groups each node is compared with the bucket's leader;
3. what is left are nodes of such buckets beside the leader. Those that share a base (else the leader) are compared
   by their edits, the symmetric difference to it: two sets differ by as much as their edits do. Tasks get two blocks
   of bounded size and give back links only, one for a pair of groups. Nodes that belong to the base's own group are
   held only against those that don't.

So every two nodes that meet in a bucket are compared or already in one group, and no group is expanded into pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, groups_of, pieces
from docloom.llm.graph import components

BANDS, ROWS = 24, 4
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


@lru_cache(maxsize=4)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up, down = np.full(length, _U(_BASE)), np.full(length, _U(pow(_BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and where each text's words begin (one more entry than texts)."""
    data = _LOWER[np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)]
    blank = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]) + 1)
    return hashes, bounds


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle make one of them all."""
    hashes, bounds = word_hashes(texts)
    n = len(hashes) - words + 1
    rolled = np.zeros(max(n, 0), _U)
    for k in range(words if n > 0 else 0):
        rolled = rolled * _U(0xD6E8FEB86659FD93) + hashes[k : k + n]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            value = int(b - a)
            for h in hashes[a:b].tolist():
                value = (value * 0xA0761D6478BD642F + h) & _MASK
            sets.append(mix(np.array([value], _U)))
        else:
            sets.append(np.array([], _U))
    return sets


def super_minhash(elements: np.ndarray, owner: np.ndarray, owners: int, slots: int) -> np.ndarray:
    """A row of `slots` values for each owner of elements (owners without elements keep infinities)."""
    values = np.full(owners * slots, np.inf)
    step, held = 0, None
    while len(elements):
        draw = mix(elements + _U((step + 1) * _BASE & _MASK))
        uniform = (draw >> _U(32)).astype(np.float64) / 2.0**32 + step
        pick = (step + ((draw & _U(0xFFFFFFFF)) * _U(slots - step) >> _U(32)).astype(np.int64)).astype(np.int64)
        rows = np.arange(len(elements))
        if held is None:
            slot = pick
        else:
            slot = held[rows, pick].astype(np.int64)
        np.minimum.at(values, owner * slots + slot, uniform)
        step += 1
        if step == slots:
            break
        worst = values.reshape(owners, slots).max(axis=1)
        on = (worst > step)[owner]
        elements, owner = elements[on], owner[on]
        if held is None:
            held = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
        else:
            held = held[on]
        rows, pick, slot = np.arange(len(elements)), pick[on], slot[on]
        held[rows, pick] = held[rows, step - 1]
        held[rows, step - 1] = slot
    return values.reshape(owners, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band: its rows' values and its number."""
    bits = np.ascontiguousarray(signature).view(_U).reshape(len(signature), bands, rows)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=_U)), (len(signature), 1))
    for r in range(rows):
        key = mix(key * _U(_BASE) + bits[:, :, r])
    return key.view(np.int64)


def signatures(documents: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, part, n (set size), node (128-bit digest of the set, null if empty), keys (of its bands)."""
    names = ["doc_id", "part", "n", "node", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_000_000, 1_000):
            sets = shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], words)
            sizes = np.array([len(s) for s in sets])
            signature = super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), bands * rows)
            keys = band_keys(signature, bands, rows)
            nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), lists], names)

    return documents.mapInArrow(run, "doc_id long, part long, n long, node binary, keys array<long>")


def _node_sets(documents: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n, shingles (sorted 64-bit values) of the nodes, each from the text of its `rep`, a doc_id and hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_000_000, 1_000):
            sets = [s.tobytes() for s in shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], words)]
            digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            keep = pa.array([n == w for n, w in zip(digests, batch.column("node").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["node", "n", "shingles"]).filter(keep)

    wanted = nodes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.part").alias("rep_part"))
    same = (documents.part == wanted.rep_part) & documents.doc_id.eqNullSafe(wanted.rep_id)
    found = documents.join(wanted, same).select("node", "text").mapInArrow(run, "node binary, n long, shingles binary")
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))  # repeated rows


def _against_hub(pairs: DataFrame, sets: DataFrame, with_edits: bool = False, slice_rows: int = 1024) -> DataFrame:
    """For pairs (hub, node): n_hub, n, common (size of the intersection), and the edits (symmetric difference) if wanted.

    A hub's nodes are dealt into slices; its set goes once to each slice, ahead of the nodes, which stream past it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.array([], _U)
        for batch in batches:
            member, n_hub, common, edits = batch.column("member").to_pylist(), [], [], []
            for is_member, values in zip(member, batch.column("shingles"), strict=True):
                values = np.frombuffer(values.as_buffer(), _U)
                if not is_member:
                    hub = values
                    continue
                both = np.concatenate([hub, values])
                both.sort(kind="stable")
                twice = both[1:] == both[:-1]
                n_hub.append(len(hub))
                common.append(int(twice.sum()))
                if with_edits:
                    single = np.ones(len(both), bool)
                    single[1:] &= ~twice
                    single[:-1] &= ~twice
                    edits.append(both[single].tobytes())
            kept = batch.select(["hub", "node", "n"]).filter(batch.column("member"))
            columns = [*kept.columns, pa.array(n_hub, pa.int64()), pa.array(common, pa.int64())]
            names = ["hub", "node", "n", "n_hub", "common"]
            if with_edits:
                columns, names = [*columns, pa.array(edits, pa.binary())], [*names, "edits"]
            yield pa.RecordBatch.from_arrays(columns, names)

    slices = pairs.groupBy("hub").agg(F.ceil(F.count("*") / slice_rows).alias("slices"))
    members = pairs.select("hub", "node").join(slices, "hub").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices"))).join(sets, "node")
    hubs = slices.join(sets, slices.hub == sets.node).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    columns = ["hub", "slice", "node", "n", "shingles"]
    dealt = hubs.select(*columns, F.lit(False).alias("member")).unionByName(members.select(*columns, F.lit(True).alias("member")))
    streams = dealt.repartition("hub", "slice").sortWithinPartitions("hub", "slice", "member")
    return streams.mapInArrow(run, "hub binary, node binary, n long, n_hub long, common long" + (", edits binary" if with_edits else ""))


def _alike(numerator: int, denominator: int) -> Column:
    return F.col("common") * denominator >= (F.col("n") + F.col("n_hub") - F.col("common")) * numerator


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of `left` shares with each of `right`: frequent values by products of 0-1 matrices, others by their pairs."""
    own_l, own_r = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    values, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    code_l, code_r = code[: len(own_l)], code[len(own_l) :]
    n_l, n_r = np.bincount(code_l, minlength=len(values)), np.bincount(code_r, minlength=len(values))
    many = n_l * n_r
    counts = np.zeros((len(left), len(right)), np.float32)
    heavy = np.flatnonzero(many > 4096)
    for a in range(0, len(heavy), 512):
        column = np.full(len(values), -1)
        column[heavy[a : a + 512]] = np.arange(len(heavy[a : a + 512]))
        sides = []
        for own, code, n in ((own_l, code_l, len(left)), (own_r, code_r, len(right))):
            at = column[code]
            bits = np.zeros((n, 512), np.float32)
            bits[own[at >= 0], at[at >= 0]] = 1
            sides.append(bits)
        counts += sides[0] @ sides[1].T
    order_l, order_r = np.argsort(code_l, kind="stable"), np.argsort(code_r, kind="stable")
    first_l, first_r = np.cumsum(n_l) - n_l, np.cumsum(n_r) - n_r
    light = np.flatnonzero((many > 0) & (many <= 4096))
    passes = np.cumsum(many[light]) // 4_000_000
    for k in range(int(passes[-1]) + 1 if len(light) else 0):
        own = light[passes == k]
        pair = np.arange(many[own].sum()) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        token = np.repeat(own, many[own])
        x = own_l[order_l[first_l[token] + pair // n_r[token]]]
        y = own_r[order_r[first_r[token] + pair % n_r[token]]]
        counts += np.bincount(x * len(right) + y, minlength=counts.size).reshape(counts.shape)
    return counts.astype(np.int64)


def _links_in_blocks(groups: DataFrame, sets: DataFrame, numerator: int, denominator: int, scratch: Scratch, block_rows: int, block_bytes: int = 8_000_000) -> DataFrame:
    """Links (a, b) between nodes of groups (hub, node, label, own: the hub's label) that have different labels.

    Nodes whose label isn't the hub's are dealt into blocks, and all nodes into others; a task compares one of
    either. Blocks hold about `block_rows` nodes or `block_bytes` of edits.
    """
    found = scratch.keep(groups.join(_against_hub(groups, sets, with_edits=True), ["hub", "node"]).select("hub", "node", "label", "n", "edits", (F.col("label") != F.col("own")).alias("apart")), "edits")

    def blocks(of: Column) -> Column:
        return F.greatest(F.ceil(F.sum(F.when(of, 1)) / block_rows), F.ceil(F.sum(F.when(of, F.length("edits"))) / block_bytes))

    sizes = found.groupBy("hub").agg(blocks(F.col("apart")).alias("blocks_i"), blocks(F.lit(True)).alias("blocks_j")).filter("blocks_i > 0")
    mine, zero = found.join(sizes, "hub"), F.lit(0).cast("long")
    own_i, own_j = (F.pmod(F.xxhash64("node"), F.col(c)) for c in ("blocks_i", "blocks_j"))
    left = mine.filter("apart").withColumn("i", own_i).withColumn("j", F.explode(F.sequence(zero, F.col("blocks_j") - 1)))
    right = mine.withColumn("j", own_j).withColumn("i", F.explode(F.sequence(zero, F.col("blocks_i") - 1)))
    columns = ["hub", "i", "j", "node", "label", "n", "edits"]
    dealt = left.select(*columns, F.lit(0).alias("side")).unionByName(right.select(*columns, F.lit(1).alias("side")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, ["hub", "i", "j"]):
            nodes, labels = rows.column("node").to_pylist(), rows.column("label").to_pylist()
            code = {x: k for k, x in enumerate(dict.fromkeys(labels))}
            label, n = np.array([code[x] for x in labels]), rows.column("n").to_numpy()
            edits = [np.frombuffer(x.as_buffer(), _U) for x in rows.column("edits")]
            size = np.array([len(e) for e in edits])
            split = int((rows.column("side").to_numpy() == 0).sum())
            apart = (n - size)[:split, None] + (n - size)[None, split:]
            common = apart // 2 + shared_counts(edits[:split], edits[split:])
            linked = common * denominator >= (n[:split, None] + n[None, split:] - common) * numerator
            x, y = np.nonzero(linked & (label[:split, None] != label[None, split:]))
            first = np.unique(label[x] * len(code) + label[split + y], return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in x[first]], pa.binary()), pa.array([nodes[split + k] for k in y[first]], pa.binary())], ["a", "b"])

    links = scratch.keep(dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side").mapInArrow(compare, "a binary, b binary"), "links")
    scratch.drop(found)
    return links


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, base, label) after joining the groups that links (a, b) connect."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    found = components(between, scratch).toDF("old", "new")
    merged = scratch.keep(labels.join(found, labels.label == found.old, "left").select("node", "base", F.coalesce("new", "label").alias("label")), "labels")
    scratch.drop(found, labels)
    return merged


def _mixed(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, hub, base, label, own (the hub's label) of the buckets whose nodes are in several groups."""
    labelled = placed.join(labels, "node")
    several = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("node") == F.col("hub"), F.col("label"))).alias("own"))
    return labelled.join(several.filter("low <> high").select("key", "own"), "key")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS, block_rows: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Words are runs of other bytes than space, tab and line breaks, A-Z lower-cased; sets hold `words`-word shingles,
    the whole sequence where there are fewer words. Rows link where intersection / union reaches `similarity`;
    component_id is the least id that a row reaches, kept whether that is its own.

    With the standard bands a pair at the bound of 0.8 would be missed with probability (1 - 0.8 ** 4) ** 24 < 4e-6 if
    hashes were independent, one above it less often; the tests measure it. Rows without words or text have an empty
    set, link with nothing and are kept; equal sets link; null ids are never the least unless alone; rows that share
    an id count separately, by their texts; ties don't occur, as ids decide. An empty table gives an empty result.
    Other columns are not read.
    """
    numerator, denominator = similarity
    scratch = Scratch(df.sparkSession, "near")
    documents = df.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text_column)).alias("part"), F.col(text_column).alias("text"))
    signed = scratch.keep(signatures(documents, words, bands, rows), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part")).alias("rep")
    nodes = scratch.keep(signed.filter("node is not null").groupBy("node").agg(rep, F.first("keys").alias("keys")), "nodes")
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.keep(banded.join(shared, "key"), "members")
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = members.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", F.col("node").alias("hub"))).alias("first"))
    placed = scratch.keep(members.join(leaders, "key").select("key", "node", F.col("first.hub").alias("hub"), F.col("first.weight").alias("weight")), "placed")
    labels = scratch.keep(placed.groupBy("node").agg(F.max(F.struct("weight", "hub")).alias("first")).select("node", F.col("first.hub").alias("base"), F.col("node").alias("label")), "labels")
    sets = scratch.keep(_node_sets(documents, labels.select("node").join(nodes, "node"), words), "sets")
    scratch.drop(members)

    def linked(pairs: DataFrame) -> DataFrame:
        kept = scratch.keep(pairs, "pairs")
        met = _against_hub(kept, sets).filter(_alike(numerator, denominator))
        links = scratch.keep(met.select(F.col("hub").alias("a"), F.col("node").alias("b")), "links")
        scratch.drop(kept)
        return links

    labels = _merged(labels, linked(labels.filter("base <> node").select(F.col("base").alias("hub"), "node")), scratch)
    unlike = (F.col("hub") != F.col("node")) & (F.col("label") != F.col("own"))
    labels = _merged(labels, linked(_mixed(placed, labels).filter(unlike & (F.col("hub") != F.col("base"))).select("hub", "node").distinct()), scratch)

    rest = scratch.keep(_mixed(placed.filter("hub <> node"), labels).select("key", "node", "hub", "base", "label"), "rest")
    common = rest.groupBy("key").agg(F.min("base").alias("low"), F.max("base").alias("high"))
    hub = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("hub"))
    groups = rest.join(common, "key").select(hub.alias("hub"), "node", "label").distinct()
    own = labels.select(F.col("node").alias("hub"), F.col("label").alias("own"))
    groups = scratch.keep(groups.join(own, "hub"), "groups")
    labels = _merged(labels, _links_in_blocks(groups, sets, numerator, denominator, scratch, block_rows), scratch)
    scratch.drop(sets, placed, rest, groups)

    ids = nodes.select("node", F.col("rep.doc_id").alias("rep_id"))
    least = scratch.keep(ids.join(labels, "node").groupBy("label").agg(F.min("rep_id").alias("least")), "least")  # as a table, so that a large group's rows can be split in the join
    of_node = ids.join(labels, "node", "left").join(least, "label", "left").select("node", F.coalesce("least", "rep_id").alias("component_id"))
    of_node = scratch.keep(of_node, "components")
    scratch.drop(nodes, labels, least)
    out = signed.select("doc_id", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of df that `near_duplicates` keeps: of every group the one with the least id; columns stay as they are.

    Rows that agree in id and text fare alike; rows that share an id with a kept and a dropped text stay.
    """
    found = near_duplicates(df, id_column, text_column, words, similarity)
    dropped = found.groupBy(F.col("doc_id").alias("__dropped")).agg(F.bool_or("kept").alias("any")).filter("not any").select("__dropped")
    return df.join(dropped, F.col(id_column).eqNullSafe(F.col("__dropped")), "left_anti")
