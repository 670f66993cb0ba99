"""Records that arrive as a stream, loaded and appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexivane.operators.validate import loaded_lines
from lexivane.operators.vectors import entries
from lexivane.session import scratch
from lexivane.sources.records import number as number_records


def append_records(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends id, content, vector (streamed records) and their long form below path: records/ and entries/.

    Each micro-batch is written to a folder of its own number, overwritten if the batch is run again, so a restart
    neither loses nor repeats rows. rec_no is the batch's number times 2^40 and the row's place in the batch by id,
    content and vector, so it is the same when a batch is run again, however many partitions it has. Columns besides the three are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        with scratch():
            number_records(batch, (number << 40) + 1).write.mode("overwrite").parquet(f"{path}/records/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{path}/records/batch={number}")
        entries(stored).write.mode("overwrite").parquet(f"{path}/entries/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_lines(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends what loaded_lines makes of streamed lines (line_no, feed, raw_line)."""

    def write(batch: DataFrame, number: int) -> None:
        loaded_lines(batch).write.mode("overwrite").parquet(f"{path}/loaded/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def appended(spark: SparkSession, path: str, what: str = "records") -> DataFrame:
    return spark.read.parquet(f"{path}/{what}")
