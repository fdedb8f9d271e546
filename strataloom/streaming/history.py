"""The rolling history kept up by a stream of results: one versioned commit per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataloom.operators import history
from strataloom.sources import sinks


def latest_results(batch: DataFrame, keys: Sequence[str], period: str, order: str) -> DataFrame:
    """One row per source and period: the newest of a batch."""
    rest = [c for c in batch.columns if c not in (*keys, period)]
    return batch.groupBy(*keys, period).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, period, "_r.*")


def keep_history(results: DataFrame, path: str, checkpoint: str, keys: Sequence[str], period: str, value: str, status: str, order: str,
                 window: int = 10) -> StreamingQuery:
    """Start a query that applies each micro-batch of results to the history at path.

    Rows with status 'ok' replace their period, others delete it; periods outside the window that ends at the
    batch's newest row are dropped. A batch that is run again after a failure finds its number in the table and
    changes nothing, so every batch counts once.
    """
    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = sinks.latest(spark, path)
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.select(*keys, period, value).schema)
        old = sinks.read_version(spark, path, version) if version else spark.createDataFrame([], f"{kind}, batch long")
        if version and (old.agg(F.max("batch")).first()[0] or -1) >= number:
            return
        newest = batch.agg(F.max_by(period, order)).first()[0]
        if newest is None:
            return
        issues = [(newest - 1 - k) % history.PERIODS + 1 for k in range(window)]
        rows = latest_results(batch, keys, period, order)
        new = history.rolling_update(old.drop("batch"), rows, keys, period, value, ~F.col(status).eqNullSafe("ok"), issues)
        sinks.commit(new.withColumn("batch", F.lit(number).cast("long")), path, version)

    return results.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and tumbling window; rows later than the watermark are no longer counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
