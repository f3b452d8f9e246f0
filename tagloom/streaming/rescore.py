"""New predictions scored against the serial set as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.matching import top_k


def rescore(predictions: DataFrame, serials: DataFrame, out: str, checkpoint: str, k: int = 5, delay: str = "10 minutes", time: str = "ts") -> StreamingQuery:
    """Appends the k nearest serials of each crop's first prediction; a crop that comes again within ``delay`` is ignored."""
    fresh = predictions.withWatermark(time, delay).dropDuplicatesWithinWatermark(["crop"])

    def batch(df: DataFrame, _: int) -> None:
        best = top_k(df, serials, k)
        df.join(best, "pred").write.mode("append").parquet(out)

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
