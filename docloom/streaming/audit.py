"""An audit log as a streaming sink: JSON lines in a folder for each micro-batch, old batches removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def audit_sink(entries: DataFrame, folder: str, checkpoint: str, most_rows_a_file: int = 100_000, batches_kept: int = 100) -> StreamingQuery:
    """Start writing a stream's rows as JSON lines below `folder`, batch by batch.

    A batch that is written again after a failure replaces what it wrote before, so that no line is there twice.
    Files hold at most `most_rows_a_file` lines; of older batches only the last `batches_kept` stay.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", most_rows_a_file).json(f"{folder}/batch={number}")
        if number >= batches_kept:
            spark = batch.sparkSession
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number - batches_kept}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def read_audit(spark, folder: str, schema: str) -> DataFrame:
    """The kept lines, with the batch that wrote each."""
    return spark.read.schema(schema + ", batch long").option("basePath", folder).json(folder)
