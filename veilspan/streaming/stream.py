"""The same transforms on streams.

Detection is narrow, so a streaming DataFrame takes it as it is; stored results are merged
per micro-batch. Event-time summaries carry a watermark, so their state is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from veilspan.operators.detect import Detector, built_in, detect
from veilspan.operators.report import latest
from veilspan.sources.sinks import write_table


def read_documents(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def detected(docs: DataFrame, key: str, text: str = "text", detectors: list[Detector] | None = None) -> DataFrame:
    """One row per span: key, match_id, kind, value, start, end."""
    return detect(docs, detectors or [built_in()], text).select(key, F.inline("matches"))


def kind_windows(spans: DataFrame, time: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Spans per kind and time window; rows later than ``late`` behind the newest are dropped."""
    return spans.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "kind").agg(F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), "kind", "count")


def distinct_deliveries(rows: DataFrame, key: str, time: str, late: str = "40 days") -> DataFrame:
    """Rows delivered more than once kept once, within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what is there into a Parquet table; a restart goes on where it stopped."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert_batches(
    rows: DataFrame, path: str, checkpoint: str, key: str, version: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, every: str | None = None
) -> StreamingQuery:
    """Insert or replace each micro-batch in a stored table; repeating a batch changes nothing.

    A batch writes its own rows only, under its number; ``upserted_table`` reads the last of
    each key and ``compact`` puts them together from time to time. ``every`` gathers what comes
    in within that time into one save; without it what is there is saved and the query ends.
    """

    def merge(batch: DataFrame, no: int) -> None:
        latest(transform(batch), key, version).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={no}")

    saved = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (saved.trigger(processingTime=every) if every else saved.trigger(availableNow=True)).start()


def upserted_table(spark: SparkSession, path: str, key: str, version: str) -> DataFrame:
    """The state of a table saved in batches: the rows of the latest batch of each key; combined on the map side."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("batch", version)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, path: str, key: str, version: str) -> None:
    """Put the batches of a table together as batch -1, older than all; run while no query writes it."""
    write_table(upserted_table(spark, path, key, version).withColumn("batch", F.lit(-1)), path)


class ProgressLog(StreamingQueryListener):
    """Keeps the latest progress of each query: rows in, rows a second, batch; and whether it ended and how."""

    def __init__(self) -> None:
        self.progress: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.progress[str(event.id)] = {"name": event.name, "batch": -1, "rows": 0, "per_second": 0.0, "ended": False, "error": None}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        state = self.progress.setdefault(str(p.id), {"name": p.name, "rows": 0, "ended": False, "error": None})
        state.update(batch=p.batchId, rows=state["rows"] + p.numInputRows, per_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.progress.setdefault(str(event.id), {}).update(ended=True, error=event.exception)
