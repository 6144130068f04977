"""Records split into loadable and failed ones as they arrive.

The classification is a row-wise expression, so the batch operator serves a stream unchanged.  Every micro-batch
overwrites its own partition ``batch_id``: a batch that is repeated after a failure leaves the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoskein.sources.csv_records import RECORD, classified


def split_stream(lines: DataFrame, loaded_path: str, failed_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over what is there (line_id, raw_line, ...): rows of the schema to one folder, failures with their reason to the other."""

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = classified(batch).withColumn("batch_id", F.lit(batch_id).cast("long")).persist()
        try:
            good = judged.where("reason is null").select("line_id", *[F.col(f"parsed.{f.name}").alias(f.name) for f in RECORD.fields], "batch_id")
            bad = judged.where("reason is not null").select("line_id", "raw_line", "reason", "batch_id")
            for part, path in ((good, loaded_path), (bad, failed_path)):
                part.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch_id").parquet(path)
        finally:
            judged.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
