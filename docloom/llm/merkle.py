"""A Merkle manifest of a dataset as a persistent tree: every tampered leaf is a version that shares untouched nodes.

Leaves stand in a group (a source) by id. Each 16 consecutive nodes become their parent until one is left, the
group's subroot; subroots by group likewise give the root. The tree is built in aligned blocks of 16 ** 3 leaves:
a block is one bounded run of rows in a task and gives one node, blocks of blocks are the next table, and so on,
so neither a group of any size nor any number of groups passes through one task.

A version is a path copy: a changed leaf gets new ancestors and nothing else is copied. Inside its block a version
copies at most three nodes of the shared block tree; above, it goes on from the block's siblings, which are found once
a block and sent to the block's rows, so upper versions grow where the leaves lie and not in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, gapless, groups_of, lower_ascii

#: Nodes that make one parent, and levels of the tree inside an aligned block.
FAN, BLOCK_LEVELS = 16, 3
BLOCK = FAN**BLOCK_LEVELS

_NODES = "grp string, pos long, digest binary, n long"
_PATHS = "grp string, pos long, above long, digest binary, n long, lefts array<string>, rights array<string>"


def field(column: Column) -> Column:
    """A value with its length: `-` for null, else UTF-8 bytes, a colon, the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n nodes, up to the one that is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def block_tree(digests: list[str], n: int) -> list[list[str]]:
    """The levels of one block of a row of n nodes, from its own nodes to the one that is left of them."""
    tree = [digests]
    for _ in range(min(BLOCK_LEVELS, levels_of(n))):
        row = tree[-1]
        tree.append([_hash("".join(row[i : i + FAN])) for i in range(0, len(row), FAN)])
    return tree


def siblings(tree: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node in its run, level by level up to the block's top."""
    lefts, rights = [], []
    for row in tree[:-1]:
        start = at - at % FAN
        lefts.append("".join(row[start:at]))
        rights.append("".join(row[at + 1 : start + FAN]))
        at //= FAN
    return lefts, rights


def copied_path(leaf: str, lefts: list[str], rights: list[str]) -> list[str]:
    """The ancestors that a version copies for its leaf; all other nodes are shared."""
    path = []
    for left, right in zip(lefts, rights, strict=True):
        leaf = _hash(left + leaf + right)
        path.append(leaf)
    return path


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {"grp": [], "pos": [], "digest": [], "n": []}
    for block in groups_of(batches, ["grp", "above"]):
        n = block.column("n")[0].as_py()
        top = block_tree([d.hex() for d in block.column("digest").to_pylist()], n)[-1]
        for name, value in zip(out, (block.column("grp")[0].as_py(), block.column("above")[0].as_py(), bytes.fromhex(top[0]), -(-n // BLOCK)), strict=True):
            out[name].append(value)
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], list(out))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    for block in groups_of(batches, ["grp", "above"]):
        tree = block_tree([d.hex() for d in block.column("digest").to_pylist()], block.column("n")[0].as_py())
        found = [siblings(tree, i) for i in range(block.num_rows)]
        columns = [block.column(c) for c in ("grp", "pos", "above", "digest", "n")]
        batch = pa.table([*columns, pa.array([f[0] for f in found], texts), pa.array([f[1] for f in found], texts)], ["grp", "pos", "above", "digest", "n", "lefts", "rights"])
        yield from batch.combine_chunks().to_batches()


def _dealt(nodes: DataFrame) -> DataFrame:
    """Nodes in their aligned blocks, in order."""
    placed = nodes.withColumn("above", F.floor(F.col("pos") / BLOCK).cast("long"))
    return placed.repartition("grp", "above").sortWithinPartitions("grp", "above", "pos")


def grow(scratch: Scratch, nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The top node of each group (grp, digest), and the tables of block nodes on the way up.

    `nodes` has grp, pos, digest and n, the group's number of nodes. A table is 1/4096 of the one below it.
    """
    tables = []
    while True:
        nodes = scratch.keep(_dealt(nodes).mapInArrow(_blocks, _NODES), "blocks")
        tables.append(nodes)
        if not nodes.filter("n > 1").take(1):
            return nodes.select("grp", "digest"), tables


def paths_up(scratch: Scratch, tables: list[DataFrame]) -> DataFrame:
    """What stands beside each node of the lowest table and its ancestors, up to the group's top: grp, pos, lefts, rights."""
    upper = None
    for nodes in reversed(tables):
        own = _dealt(nodes).mapInArrow(_paths, _PATHS)
        if upper is not None:
            higher = upper.select("grp", F.col("pos").alias("above"), F.col("lefts").alias("l"), F.col("rights").alias("r"))
            own = own.join(higher, ["grp", "above"]).withColumn("lefts", F.concat("lefts", "l")).withColumn("rights", F.concat("rights", "r"))
        upper = scratch.keep(own.select("grp", "pos", "lefts", "rights"), "paths")
    return upper


_VERSIONS = "doc_id long, grp string, pos long, leaf string, subroot string, root string, n_siblings long, proof_sha256 string, path array<string>, folded_root string, verified boolean"


def _versions(root: str):
    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _VERSIONS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]
        for block in groups_of(batches, ["grp", "above"]):
            # the block's own row stands first: what is beside its top node and above
            subroot = block.column("digest")[0].as_py().hex()
            high_left, high_right = block.column("lefts")[0].as_py(), block.column("rights")[0].as_py()
            high = "".join(left + right for left, right in zip(high_left, high_right, strict=True)).encode()
            leaves = [d.hex() for d in block.column("digest").to_pylist()[1:]]
            ids, places, changed = (block.column(c).to_pylist()[1:] for c in ("doc_id", "pos", "tampered"))
            tree = block_tree(leaves, block.column("n")[1].as_py())
            group = block.column("grp")[0].as_py()
            rows = []
            for i, (doc_id, pos, leaf, new) in enumerate(zip(ids, places, leaves, changed, strict=True)):
                lefts, rights = siblings(tree, i)
                proof = sha256("".join(left + right for left, right in zip(lefts, rights, strict=True)).encode())
                proof.update(high)
                start = new.hex() if new is not None else leaf
                path = copied_path(start, [*lefts, *high_left], [*rights, *high_right])
                top = path[-1] if path else start
                count = (sum(map(len, lefts)) + sum(map(len, rights)) + len(high)) // 64
                rows.append((doc_id, group, pos, leaf, subroot, root, count, proof.hexdigest(), path if new is not None else None, top, top == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return versions


def manifest(docs: DataFrame, tampered: Column, group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Every row of docs as a leaf, with its proof, and the version of the tree that its tampering makes.

    A leaf is the digest of `columns`; where `tampered` holds, the text's A-Z are lowered and the leaf's version is
    folded from the changed leaf. Columns: doc_id, grp (`=` and the group, empty for null), pos (the leaf's place in
    its group), leaf, subroot, root, n_siblings, proof_sha256, path (the digests that the version copies, lowest
    first; null where nothing is tampered), folded_root, verified.

    Leaves ascend by doc_id, null first; rows that agree in it by leaf, and copies of a row in any order. A lone leaf
    is its subroot, a lone subroot the root. An empty table gives an empty result. Tampering that changes nothing
    (no A-Z, null text) verifies. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    lowered = digest_of(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest_of(*[F.col(c) for c in columns]).alias("digest"),
        F.when(tampered, lowered).alias("tampered"),
    )
    placed = scratch.keep(gapless(scratch, leaves, ["grp"], ["doc_id", "digest"], "leaves"), "placed")
    if not placed.take(1):
        return docs.sparkSession.createDataFrame([], _VERSIONS)
    subroots, tables = grow(scratch, placed)
    groups = gapless(scratch, subroots.select(F.lit("").alias("top"), "grp", "digest"), ["top"], ["grp"], "subroots")
    groups = scratch.keep(groups.select("grp", F.lit("").alias("top"), "pos", "digest", "n"), "groups")
    named = groups.select(F.col("top").alias("grp"), "pos", "digest", "n")
    roots, upper = grow(scratch, named)
    root = roots.first()["digest"].hex()
    over = paths_up(scratch, [named, *upper]).select("pos", F.col("lefts").alias("l"), F.col("rights").alias("r"))
    over = groups.join(over, "pos").select("grp", F.col("digest").alias("subroot"), "l", "r")
    blocks = (
        paths_up(scratch, tables).join(over, "grp")
        .select("grp", F.col("pos").alias("above"), F.lit(None).cast("long").alias("pos"), F.col("subroot").alias("digest"), F.concat("lefts", "l").alias("lefts"), F.concat("rights", "r").alias("rights"))
    )
    rows = placed.withColumn("above", F.floor(F.col("pos") / BLOCK).cast("long")).unionByName(blocks, allowMissingColumns=True)
    dealt = rows.repartition("grp", "above").sortWithinPartitions("grp", "above", F.col("pos").asc_nulls_first())
    return dealt.mapInArrow(_versions(root), _VERSIONS)


def tampered_fifth(doc_id: Column) -> Column:
    """The rows whose unsigned crc32 of the decimal id is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of the manifest whose tampering is `tampered_fifth`."""
    found = manifest(docs, tampered_fifth(F.col("doc_id")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
