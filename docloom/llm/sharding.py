"""Sharding by sampled splitters.

Records are ordered by a key (a digest of the text, then the id). A size-weighted sample of keys gives the
quantile boundaries of many small ranges, each record goes to its range, and ranges that turn out overfull are
subdivided from a fresh sample of their own keys. Exact byte and row totals of the ranges, which are a bounded
number of rows, then place every record on one line of bytes that is cut into equal shards.

The sample only deals the work out: shards follow from exact offsets in key order, so they don't depend on it. With
the splitters themselves as bounds, shards of a run with another sample would differ, and sizes be near equal only
up to the sample's error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch

#: Bytes that a record takes besides its text.
RECORD_BYTES = 8
_NO_ID = -(2**63)


def key_digest(text: Column) -> Column:
    """60 bits of the text's MD5 as a long: equal texts lie side by side, others are spread evenly."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


@dataclass
class Splitters:
    """Upper bounds of ranges over (digest, id); range i holds the keys with exactly i splitters at or below them."""

    digest: np.ndarray = field(default_factory=lambda: np.array([], "i8"))
    doc: np.ndarray = field(default_factory=lambda: np.array([], "i8"))

    def __len__(self) -> int:
        return len(self.digest) + 1

    def plus(self, digest: np.ndarray, doc: np.ndarray) -> Splitters:
        both = np.unique(np.array([np.append(self.digest, digest), np.append(self.doc, doc)]).T, axis=0)
        return Splitters(both[:, 0].copy(), both[:, 1].copy())

    def find(self, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.digest, digest, "left")
        high = np.searchsorted(self.digest, digest, "right")
        found = low.copy()
        for i in np.unique(low[high > low]):  # digests on which a splitter falls: the id decides
            rows = (low == i) & (high > low)
            end = np.searchsorted(self.digest, self.digest[i], "right")
            found[rows] = i + np.searchsorted(self.doc[i:end], doc[rows], "right")
        return found.astype("i4")

    def column(self, digest: Column, doc: Column) -> Column:
        splitters = self

        @F.pandas_udf("int")
        def range_of(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(splitters.find(a.to_numpy(), b.to_numpy()))

        return range_of(digest, doc)


def weighted_sample(keys: DataFrame, per_byte: Column | float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys drawn `size * per_byte` times in expectation, at most once per draw more; sorted, with their counts."""
    uniform = (F.xxhash64("digest", "doc", F.lit(seed)).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53)))
    drawn = keys.withColumn("draws", F.floor(F.col("size") * per_byte + uniform).cast("long")).filter("draws > 0")
    got = drawn.select("digest", "doc", "draws").toPandas()
    got = got.groupby(["digest", "doc"], as_index=False).draws.sum().sort_values(["digest", "doc"])
    return got.digest.to_numpy("i8"), got.doc.to_numpy("i8"), got.draws.to_numpy("i8")


def _quantile_keys(sample: tuple[np.ndarray, np.ndarray, np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
    digest, doc, draws = sample
    if not len(draws):
        return digest, doc
    upto = np.cumsum(draws)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts))
    return digest[at], doc[at]


def shard_by_bytes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 24, ranges_per_shard: int = 8, draws_per_range: int = 64, seed: int = 7) -> DataFrame:
    """Shards of nearly equal bytes: doc id, size, text_crc32, shard, slot.

    A record counts its text's UTF-8 bytes plus 8. Shard s holds the records whose middle byte lies in the s-th
    of `shards` equal parts of all bytes in key order, so a shard misses the even share by at most one record.
    slot numbers a shard's records from 0 in key order. The sample that reaches the driver has about
    24 * 8 * 64 keys whatever the input; so has the table of range totals one row a range.

    Null texts count as empty (8 bytes), null ids come first among equal texts, spread over the lowest longs so that
    many of them are several keys, rows that agree in text and id
    share out their slots in any order, an empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_column)
    keys = scratch.keep(
        df.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**62))).alias("doc"),
            key_digest(text).alias("digest"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "keys",
    )
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    wanted = shards * ranges_per_shard
    splitters = Splitters()
    if total:
        splitters = splitters.plus(*_quantile_keys(weighted_sample(keys, float(wanted * draws_per_range / total), seed), wanted))
    for again in range(4):
        ranged = keys.withColumn("part", splitters.column(F.col("digest"), F.col("doc")))
        totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas()
        overfull = totals[totals.bytes > 2 * total / wanted]
        if not len(overfull) or again == 3:
            break
        rate = F.create_map(*[x for p, b in zip(overfull.part, overfull.bytes, strict=True) for x in (F.lit(int(p)), F.lit(4.0 * draws_per_range / int(b)))])
        inside = ranged.filter(F.col("part").isin([int(p) for p in overfull.part])).withColumn("rate", F.element_at(rate, F.col("part")))
        sample = weighted_sample(inside, F.col("rate"), seed + 1 + again)
        parts = max(2, int(np.ceil(overfull.bytes.sum() / (total / wanted))) * 2)
        more = splitters.plus(*_quantile_keys(sample, parts))
        if len(more) == len(splitters):
            break
        splitters = more
    totals = totals.sort_values("part")
    before = pd.DataFrame({"part": totals.part.astype("int32"), "bytes_before": (totals.bytes.cumsum() - totals.bytes).astype("int64"), "rows_before": (totals.rows.cumsum() - totals.rows).astype("int64")})
    offsets = spark.createDataFrame(before, "part int, bytes_before long, rows_before long")  # one row a range

    order = Window.partitionBy("part").orderBy("digest", "doc", "size", "text_crc32")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("at", F.row_number().over(order).cast("long"))
        .join(F.broadcast(offsets), "part")
        .withColumn("row", F.col("rows_before") + F.col("at") - 1)
        .withColumn("twice", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.floor(F.col("twice") * shards / F.lit(2 * max(total, 1))).cast("int"))
        .withColumn("shard", F.least("shard", F.lit(shards - 1)))
    )
    placed = scratch.keep(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
