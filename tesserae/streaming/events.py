"""Event streams: routing by type, state of signatures, and windows over event time. All work on static tables too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import skills
from .skills import signature

Handler = Callable[[DataFrame, int], None]
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """A stream of event files; the schema is stated, so no file is opened to plan."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def routed(events: DataFrame, routes: dict[str, list[str]]) -> DataFrame:
    """events with a row per handler that subscribes to their type or to *."""
    known = F.create_map(*[x for t, hs in routes.items() for x in (F.lit(t), F.array(*map(F.lit, hs)))])
    none = F.array().cast("array<string>")
    found = F.concat(F.coalesce(F.try_element_at(known, F.col("event_type")), none), F.coalesce(F.try_element_at(known, F.lit("*")), none))
    return events.withColumn("handler", F.explode(F.array_distinct(found)))


def signatures(events: DataFrame) -> DataFrame:
    """(signature) of type and property k; unreadable properties are unknown."""
    return events.select(signature(F.col("event_type"), F.col("props")).alias("signature"))


def reflection(events: DataFrame) -> DataFrame:
    """Skills of the signatures seen so far; on a stream, write in update or complete mode: the state is a count a key."""
    return skills(signatures(events))


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """An extension: (start, event_type, n, total) by windows of event time with a watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def gated(events: DataFrame, prefix: str) -> DataFrame:
    """Events (source, ...) that come from a source of this prefix; completions of handlers pass no gate, so none loops."""
    return events.where(F.startswith("source", F.lit(prefix)))


def handler_counts(handled: DataFrame) -> DataFrame:
    """(handler, n_ok, n_failed) of (handler, ok); on a stream, write in update or complete mode."""
    return handled.groupBy("handler").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


def completions(handled: DataFrame) -> DataFrame:
    """(event_type, source, of, handler): one cascade level, a completed or failed event per handled event (event_id, handler, ok)."""
    return handled.select(F.when(F.col("ok"), "handler.completed").otherwise("handler.failed").alias("event_type"), F.lit("engine").alias("source"), F.col("event_id").alias("of"), "handler")


def dispatch(events: DataFrame, handlers: dict[str, Handler], routes: dict[str, list[str]], checkpoint: str, retries: int = 1) -> None:
    """Work off what is there: each micro-batch goes to the handlers that its types are routed to, as (batch rows, batch id).

    A handler is tried retries + 1 times for a batch; its last error stops the query, which starts again at that batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = routed(batch, routes)
        for name, handle in handlers.items():
            for left in range(retries, -1, -1):
                try:
                    handle(rows.where(F.col("handler") == name), batch_id)
                    break
                except Exception:
                    if not left:
                        raise

    events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Work off what is there into an in-memory table, for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
