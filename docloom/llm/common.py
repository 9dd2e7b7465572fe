"""Scratch tables, batches and small column helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


class Scratch:
    """Tables that cut lineage. They lie in the shared folder, so a lost executor costs only its running tasks."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        self._kept: list[tuple[DataFrame, str]] = []

    def place(self, name: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path = self.place(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((kept, path))
        return kept

    def renamed(self, kept: DataFrame, view: DataFrame) -> DataFrame:
        """`view`, a projection of the kept table: dropping it drops the table."""
        self._kept = [(view, path) if frame is kept else (frame, path) for frame, path in self._kept]
        return view

    def drop(self, *frames: DataFrame) -> None:
        """Delete kept tables that nothing reads any more: what was made of them has been kept itself."""
        for frame, path in [x for x in self._kept if any(x[0] is f for f in frames)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
            self._kept.remove((frame, path))


def pieces(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4_000_000, most_rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each with at most about `most_bytes` of text (one longer row stays whole)."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows that agree in `keys`, across batches, from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        changed = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changed |= pa.compute.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = [c[a] for c in columns]
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def gapless(scratch: Scratch, df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `pos`, each row's place from 0 in its group by `order` (nulls first), and `n`, the rows of its group.

    Rows are sorted by range partitions, so a group may be of any size: places are counted in each partition, and the
    partitions of a group are added up. Rows that agree in everything are spread by a tie of their own and placed in
    any order. `group` holds columns without nulls; the names pos, n, _tie, _at and _part must be free.
    """
    keys = [*group, *order, "_tie"]
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    kept = scratch.keep(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    kept = scratch.renamed(kept, kept.withColumn("_part", F.shiftright("_at", 33)))
    runs = kept.groupBy(*group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    placed = kept.join(runs, [*group, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_at", "_part", "_first", "_before")


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
