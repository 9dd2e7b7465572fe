"""Tables that cut the lineage of loops: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder of our own where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="docloom-rounds-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


class Rounds:
    """The tables of a loop's rounds."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.count = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def keep(self, frame: DataFrame) -> DataFrame:
        """Write a frame and read it back."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)
