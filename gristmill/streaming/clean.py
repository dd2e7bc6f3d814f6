"""The stateless expressions over a stream, exact deduplication within a watermark, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def clean_stream(df: DataFrame, text: str, at: str, late: str = "30 days", domain: str = "web") -> DataFrame:
    """Cleaned texts that pass the cascade, each once within the watermark."""
    t = df.withColumn("text", T.strip(T.pretrain_normal(text))).withColumn("reason", T.reject_reason("text", domain))
    return t.where("reason IS NULL").drop("reason").withColumn("digest", T.sha1("text")).withWatermark(at, late).dropDuplicatesWithinWatermark(["digest"])


def windowed_counts(df: DataFrame, at: str, key: str, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts a window and key; without ``late`` no row is ever too late (and windows stay open)."""
    marked = df.withWatermark(at, late) if late else df
    return marked.groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Run an aggregating stream over all that is there now; its last state, written to ``folder``."""
    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")
