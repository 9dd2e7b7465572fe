"""A prefix trie of conversations as a burst trie.

Turns become ids (half a SHA-256 of role and text), conversations sequences of them, and copies of a sequence are
counted once. The root's container holds all sequences. A container with more than `most` of them (or, with at least
two, more than `most_turns` turns) bursts: its head becomes an inner node, and its sequences go to one container for
each next turn id. What is left are small containers: each is sorted and swept into nodes in one task. A container of
a single sequence is a chain and needs no sorting. At last what the containers hold is added up along the heads.

Sequences lie in rows of at most 64 turns, so a long conversation is no long row. Bursting takes a round for each
turn that an oversized container shares; a round moves one row a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, gapless, groups_of

WORD = r"[^\x20\x09-\x0D]+"
#: Turns in one row of a sequence, and the span of conversation ids (as a power of two) whose ends are packed in a row.
CHUNK, PACK = 64, 12
NO_ENDS = sha256(b"").hexdigest()
#: Rebuilding: conversations of a block of ids borrow up to three turns from its first.
FAMILY, BORROWED = 20, 4

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n (turns of the conversation), tid (16 bytes), words.

    Turns stand by turn number, null first, then role, then id. Null role or text is empty. Rows without a conv_id
    belong to no conversation and are left out; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32)).alias("tid"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return scratch.keep(gapless(scratch, turns, ["conv_id"], ["turn", "role", "tid"], "turns").select("conv_id", "pos", "n", "tid", "words"), "ordered")


def rebuilt(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first one, as (turns, ids of all conversations).

    Conversation c begins with the first h = crc32(c) % 4 turns of conversation c - c % 20 (all, if it has fewer, none
    if there is no such conversation) and goes on with its own turns after its first h.
    """
    whole = turns.filter("pos = 0").select("conv_id", "n")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).alias("h")
    wanted = whole.select("conv_id", h, (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("base"))
    first = turns.filter(F.col("pos") < BORROWED - 1).select(F.col("conv_id").alias("base"), "pos", "tid", "words")
    lent = wanted.join(first, "base").filter("pos < h").select("conv_id", "pos", "tid", "words")
    size = whole.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shift = wanted.join(size, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("got"))
    own = turns.join(shift, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "tid", "words")
    return scratch.keep(lent.unionByName(own), "rebuilt"), whole.select("conv_id")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences from packs of ids in order: the hash runs on from pack to pack, so any number of copies takes no memory."""
    names = ("a", "b", "len", "weight", "seq", "ends")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    last = None
    for batch in batches:
        done = []
        for a, b, n, ids, count, first in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "len", "ids", "count", "first")], strict=True):
            if (a, b, n) != last:
                if last is not None:
                    done.append((*last, weight, seq, state.hexdigest()))
                last, weight, seq, state = (a, b, n), 0, first, sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
            weight += count
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*last, weight, seq, state.hexdigest()), kinds, strict=True)], names)


def distinct_sequences(scratch: Scratch, turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a distinct sequence: seq (its least conv_id), len, weight (conversations), ends (hash of their ids).

    Two halves of an MD5 of place and turn id, each added up by exclusive or, tell sequences apart: 128 bits that
    are aggregated on the map side and need no sequence in one place.
    """
    mixed = F.md5(F.concat(F.hex("tid"), F.col("pos").cast("string")).cast("binary"))
    halves = [F.conv(F.substring(mixed, at, 16), 16, -10).cast("long") for at in (1, 17)]
    marked = turns.select("conv_id", halves[0].alias("a"), halves[1].alias("b"))
    whole = marked.groupBy("conv_id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("len"))
    whole = ids.join(whole, "conv_id", "left").na.fill(0, ["a", "b", "len"])
    packs = whole.groupBy("a", "b", "len", F.shiftright("conv_id", PACK).alias("pack")).agg(F.sort_array(F.collect_list("conv_id")).alias("of"))
    packs = packs.select("a", "b", "len", "pack", F.array_join(F.col("of").cast("array<string>"), ",").alias("ids"), F.size("of").cast("long").alias("count"), F.element_at("of", 1).alias("first"))
    packs = packs.repartition("a", "b", "len").sortWithinPartitions("a", "b", "len", "pack")
    found = packs.mapInArrow(_ends, "a long, b long, len long, weight long, seq long, ends string")
    return scratch.keep(found.select("seq", "len", "weight", "ends"), "sequences")


def sweep(container: list[tuple[list[bytes], list[int], int, int, str]], head: int, depth: int) -> tuple[list[tuple], tuple[int, int, int]]:
    """Nodes below a head from the sorted sequences of its container, and the head's children, leaves and saved tokens.

    A sequence is (turn ids, words, seq, weight, ends), all from the head's depth on and not empty.
    """
    container.sort(key=lambda s: s[0])
    rep, parent, at, convs, children, leaves, saved, ends, last_words = ([] for _ in range(9))
    open_nodes: list[int] = []
    before: list[bytes] = []
    for tids, words, seq, weight, end in container:
        same = 0
        for x, y in zip(before, tids):  # noqa: B905
            if x != y:
                break
            same += 1
        del open_nodes[same:]
        for k in range(same, len(tids)):
            for column, value in zip((rep, parent, at, convs, children, leaves, saved, ends, last_words), (seq, open_nodes[-1] if k else -1, depth + k + 1, 0, 0, 0, 0, NO_ENDS, words[k]), strict=True):
                column.append(value)
            open_nodes.append(len(rep) - 1)
        for i in open_nodes:
            convs[i] += weight
            rep[i] = min(rep[i], seq)
        ends[open_nodes[-1]] = end
        before = tids
    total = [0, 0, 0]
    for i in range(len(rep) - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] or 1
        saved[i] += (convs[i] - 1) * last_words[i]
        if parent[i] < 0:
            total = [total[0] + 1, total[1] + leaves[i], total[2] + saved[i]]
        else:
            up = parent[i]
            children[up], leaves[up], saved[up] = children[up] + 1, leaves[up] + leaves[i], saved[up] + saved[i]
    above = [head if p < 0 else rep[p] for p in parent]
    return list(zip(rep, at, above, convs, children, leaves, saved, ends, strict=True)), tuple(total)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of each container, and one row with what it adds to its head (parent_conv_id and n_convs are null)."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string()]
    rows: list[tuple] = []
    for found in groups_of(batches, ["depth", "head"]):
        depth, head = found.column("depth")[0].as_py(), found.column("head")[0].as_py()
        container: list = []
        for seq, weight, end, turns in zip(*[found.column(c).to_pylist() for c in ("seq", "weight", "ends", "turns")], strict=True):
            if not container or container[-1][2] != seq:
                container.append(([], [], seq, weight, end))
            container[-1][0].extend(t["tid"] for t in turns if t["pos"] >= depth)
            container[-1][1].extend(t["words"] for t in turns if t["pos"] >= depth)
        nodes, (children, leaves, saved) = sweep(container, head, depth)
        rows += nodes
        rows.append((head, depth, None, None, children, leaves, saved, None))
        if len(rows) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _chains(solo: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of containers with one sequence, and what these add to their heads."""
    turns = solo.join(chunks, "seq").select("seq", "len", "weight", "ends", "head", "depth", F.explode("turns").alias("t")).filter("t.pos >= depth")
    turns = turns.withColumn("cost", (F.col("weight") - 1) * F.col("t.words"))
    onwards = Window.partitionBy("seq").orderBy(F.col("t.pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    alone, copied = turns.filter("weight = 1").withColumn("saved", F.lit(0).cast("long")), turns.filter("weight > 1").withColumn("saved", F.sum("cost").over(onwards))
    place = F.col("t.pos") + 1
    nodes = alone.unionByName(copied).select(
        F.col("seq").alias("conv_id"), place.alias("depth"), F.when(place == F.col("depth") + 1, F.col("head")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        (place < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(place == F.col("len"), F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    added = turns.groupBy("head", "depth").agg(F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.sum("cost").alias("saved"))
    return nodes, added


def _oversized(n: Column, turns: Column, most: int, most_turns: int) -> Column:
    return (n > most) | ((n > 1) & (turns > most_turns))


def burst_trie(scratch: Scratch, turns: DataFrame, ids: DataFrame, most: int = 512, most_turns: int = 65_536) -> DataFrame:
    """The trie of all sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` holds conv_id, pos, tid, words, without gaps in pos; `ids` every conv_id once, those without turns too. A
    node is known by its depth and its least member. No conversations, no nodes: a root has members.
    """
    spark = turns.sparkSession
    seqs = distinct_sequences(scratch, turns, ids)
    top = seqs.agg(F.min("seq"), F.sum("weight"), F.count_if(F.col("len") > 0), F.sum("len"), F.max(F.when(F.col("len") == 0, F.col("ends")))).first()
    if top[0] is None:
        return spark.createDataFrame([], _NODE)
    held = turns.join(seqs.select(F.col("seq").alias("conv_id")), "conv_id").groupBy(F.col("conv_id").alias("seq"), F.floor(F.col("pos") / CHUNK).cast("long").alias("chunk"))
    chunks = scratch.keep(held.agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "words"))).alias("turns")), "chunks")

    head_row = "head long, rep long, n_convs long, words long, n_open long, open_turns long, ends string"
    levels = [spark.createDataFrame([(None, top[0], top[1], 0, top[2], top[3], top[4])], head_row)]
    big = top[2] > most or (top[2] > 1 and top[3] > most_turns)
    moved = scratch.keep(seqs.filter("len > 0").select("seq", "len", "weight", "ends", F.lit(top[0]).alias("head"), F.lit(0).cast("long").alias("depth"), F.lit(big).alias("big"), F.lit(top[2] == 1).alias("solo")), "held")
    contained, depth = [moved.filter("NOT big")], 0
    active = moved.filter("big")
    while big:
        if depth % CHUNK == 0:
            active = active.drop("turns").join(chunks.filter(F.col("chunk") == depth // CHUNK).select("seq", "turns"), "seq")
        step = active.withColumn("turn", F.element_at("turns", depth % CHUNK + 1)).withColumn("tid", F.col("turn.tid"))
        below = F.col("len") > depth + 1
        kids = step.groupBy("head", "tid").agg(
            F.min("seq").alias("rep"), F.sum("weight").alias("n_convs"), F.max("turn.words").alias("words"), F.count_if(below).alias("n_open"),
            F.sum(F.col("len") - (depth + 1)).alias("open_turns"), F.max(F.when(~below, F.col("ends"))).alias("ends"),
        )
        kids = scratch.keep(kids, "heads")
        levels.append(kids.drop("tid"))
        marks = kids.filter("n_open > 0").select("head", "tid", "rep", _oversized(F.col("n_open"), F.col("open_turns"), most, most_turns).alias("burst"), (F.col("n_open") == 1).alias("alone"))
        depth += 1
        moved = step.filter(below).join(marks, ["head", "tid"]).select(
            "seq", "len", "weight", "ends", F.col("rep").alias("head"), F.lit(depth).cast("long").alias("depth"), F.col("burst").alias("big"), F.col("alone").alias("solo"), F.when(F.col("burst"), F.col("turns")).alias("turns")
        )
        moved = scratch.keep(moved, "held")
        contained.append(moved.filter("NOT big").drop("turns"))
        active = moved.filter("big")
        big = bool(kids.filter(_oversized(F.col("n_open"), F.col("open_turns"), most, most_turns)).take(1))

    small = contained[0]
    for more in contained[1:]:
        small = small.unionByName(more)
    chains, chained = _chains(small.filter("solo"), chunks)
    rows = small.filter("NOT solo").select("seq", "weight", "ends", "head", "depth").join(chunks, "seq").filter(F.col("chunk") >= F.floor(F.col("depth") / CHUNK))
    rows = rows.repartition("depth", "head").sortWithinPartitions("depth", "head", "seq", "chunk")
    swept = scratch.keep(rows.mapInArrow(_swept, _NODE), "swept")
    added = swept.filter("n_convs IS NULL").select(F.col("conv_id").alias("head"), "depth", "n_children", "n_leaves", F.col("saved_tokens").alias("saved"))
    added = scratch.keep(added.unionByName(chained), "added")

    result = swept.filter("n_convs IS NOT NULL").unionByName(chains)
    above = None
    for d in range(len(levels) - 1, -1, -1):
        sums = added.filter(F.col("depth") == d).drop("depth")
        if above is not None:
            sums = sums.unionByName(above.groupBy(F.col("parent_conv_id").alias("head")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")))
        here = levels[d].withColumnRenamed("head", "parent_conv_id").withColumnRenamed("rep", "head").join(sums, "head", "left")
        above = scratch.keep(
            here.select(
                F.col("head").alias("conv_id"), F.lit(d).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
            ),
            "inner",
        )
        result = result.unionByName(above)
    return result


def prefix_trie(conversations: DataFrame, most: int = 512, most_turns: int = 65_536) -> DataFrame:
    """The trie of conversations as they are. An empty table gives an empty result; other columns are not read."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = ordered_turns(scratch, conversations)
    return burst_trie(scratch, turns, turns.filter("pos = 0").select("conv_id"), most, most_turns)


def rebuilt_trie(conversations: DataFrame, most: int = 512, most_turns: int = 65_536) -> DataFrame:
    """The trie of rebuilt conversations (see `rebuilt`)."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, ids = rebuilt(scratch, ordered_turns(scratch, conversations))
    return burst_trie(scratch, turns, ids, most, most_turns)
