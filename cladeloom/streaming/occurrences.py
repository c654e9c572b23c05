"""File-arrival forms of the chunked occurrence processing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, folder: str, glob: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def occurrence_filter(stream: DataFrame, keys: DataFrame, on: str, cond: Column) -> DataFrame:
    """Stateless filter plus stream-static semi-join; equals the batch filter."""
    return stream.where(cond).join(keys.select(on).distinct(), on, "left_semi")


def summary(stream: DataFrame, by: Sequence[str], distinct: str) -> DataFrame:
    """Running counts and approximate distinct keys (exact distinct is not available on a stream)."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"), F.approx_count_distinct(distinct, 0.01).alias("n_distinct"))


def dedupe(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First arrival per key while it stays inside the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived and stop; a restart with the same checkpoint continues after it."""
    q: StreamingQuery = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start())
    q.awaitTermination()


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Complete-mode table: every batch rewrites the result folder."""
    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
