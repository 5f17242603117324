"""Graphs over streams: stateless scoring, and counts by event time for monitoring it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import predict
from ..plans.storage import shared_dir


def score_stream(stream: DataFrame, nodes: DataFrame, root: int, features: list[str]) -> DataFrame:
    """``stream`` with the class of each row; the model is fixed when the query starts."""
    return predict(stream, nodes, root, features)


def class_counts(scored: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(start, class, rows) of tumbling windows; rows later than ``late`` are dropped."""
    per = scored.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "class").agg(F.count("*").alias("rows"))
    return per.select(F.col("w.start").alias("start"), "class", "rows")


def latest_counts(counts: DataFrame) -> str:
    """Runs over what the source has now; each batch writes the whole counts to a folder of its own, of which the last is named."""
    base = shared_dir(counts.sparkSession)
    made: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{number}")
        made.append(f"{base}/{number}")

    running = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/progress").foreachBatch(write).trigger(availableNow=True).start()
    running.awaitTermination()
    if not made:
        write(counts.sparkSession.createDataFrame([], counts.schema), 0)
    return made[-1]
