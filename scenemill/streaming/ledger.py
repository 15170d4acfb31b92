"""An append-only ledger of decisions, late records, and progress, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.sequence import late_corrected, latest


def append_decisions(decisions: DataFrame, ledger: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Appends a stream of decisions (key, made_at, ...) to a ledger, batch by batch.

    A batch is a folder named after its number and is written over itself if the batch is run again, so a
    restart neither loses nor repeats a decision. Null keys are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").parquet(f"{ledger}/batch_number={number}")

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, ledger: str, key: str = "id", order: str = "made_at") -> DataFrame:
    """What holds now: the last decision of every key, by time and then by batch."""
    return latest(spark.read.parquet(ledger).drop("batch_number"), [key], [order, "batch"])


def unrepeated(events: DataFrame, keys: list[str], t: str, lateness: str) -> DataFrame:
    """A stream without the records that repeat a key within the lateness."""
    return events.withWatermark(t, lateness).dropDuplicatesWithinWatermark(keys)


def corrected_stream(records: DataFrame, samples: DataFrame, key: str, t: str, true_t: str, tolerance: int) -> DataFrame:
    """A stream of records whose times, where further than the tolerance from their sample's, are the sample's; a static table has the samples."""
    joined = records.join(samples.select(key, true_t), key, "left")
    return late_corrected(joined, t, true_t, tolerance)


def correction_counts(corrected: DataFrame, at: str, window: str, lateness: str | None = None) -> DataFrame:
    """How many records of each window of event time came, and how many were corrected; windows close behind the watermark.

    ``lateness`` sets the watermark of a stream that has none yet.
    """
    out = (corrected.withWatermark(at, lateness) if lateness else corrected).groupBy(F.window(at, window).alias("w"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("corrected").alias("n_corrected")).select(F.col("w.start").alias("start"), "n", "n_corrected")


class Heartbeat(StreamingQueryListener):
    """The last progress of every query; ``silent`` tells those without one for too long."""

    def __init__(self, now):
        self.now, self.seen, self.ended = now, {}, {}

    def onQueryStarted(self, event) -> None:
        self.seen[str(event.id)] = (self.now(), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen[str(p.id)] = (self.now(), p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.seen[str(event.id)] = (self.now(), 0)

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception
        self.seen.pop(str(event.id), None)

    def silent(self, seconds: float) -> list[str]:
        return sorted(k for k, (at, _) in self.seen.items() if self.now() - at > seconds)
