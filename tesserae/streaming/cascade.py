"""Event cascades: two chained streams over append-only tables of events.

The first stream hands each micro-batch to the handlers that subscribe to its types, some at a time, each with a deadline
and retries, and appends an event of completion or failure for every event and handler. The second stream reads those,
one level deep: what its handlers do is recorded, but no stream follows it, so nothing recurs.

What a handler did with a batch is one folder, named by batch and handler and put in place by a rename. A batch that is
run again after a crash passes over the handlers whose folder is there; so no event is lost, and none is recorded twice.
On a store without atomic renames of folders a crash in a rename may leave part of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEOUT = "handler timeout"
COMPLETIONS = "event_id long, event_type string, source string, of long, handler string, original_event_type string, props string, ok boolean, error string, attempts int"


@dataclass(frozen=True)
class Handler:
    """handle gets a batch's rows of the subscribed types (* is every type) and the batch's id; what it raises is a failure.

    A handler may run again for the same batch, after a failure or a crash before its folder was there, so its own effects
    must be keyed by the batch's id. After the deadline, in seconds, its Spark jobs are cancelled.
    """

    name: str
    types: tuple[str, ...]
    handle: Callable[[DataFrame, int], None]
    retries: int = 0
    deadline: float | None = None
    delay: float = 0.0


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def publish(df: DataFrame, path: str) -> None:
    """Write df beside path and rename it there; if path is there meanwhile, what was written goes."""
    spark = df.sparkSession
    parent, name = path.rsplit("/", 1)
    made = f"{parent}-unfinished/{name}-{uuid.uuid4().hex}"
    df.write.parquet(made)
    fs, at = _path(spark, path)
    fs.mkdirs(at.getParent())
    if fs.exists(at) or not fs.rename(_path(spark, made)[1], at):
        fs.delete(_path(spark, made)[1], True)
        if not fs.exists(at):
            raise RuntimeError(f"{made} could not be renamed")


def _once(handler: Handler, rows: DataFrame, batch_id: int) -> str | None:
    """One attempt; the error, if any."""
    sc, group, outcome = rows.sparkSession.sparkContext, f"{handler.name}-{batch_id}-{uuid.uuid4().hex}", []

    def work() -> None:
        sc.setJobGroup(group, handler.name, interruptOnCancel=True)
        try:
            handler.handle(rows, batch_id)
            outcome.append(None)
        except Exception as e:  # noqa: BLE001  a handler's failure is recorded, whatever it is
            outcome.append(str(e).split("\n", 1)[0] or type(e).__name__)

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(handler.deadline)
    if not outcome:
        sc.cancelJobGroup(group)
        return TIMEOUT
    return outcome[0]


def _tried(handler: Handler, rows: DataFrame, batch_id: int) -> tuple[str | None, int]:
    """The last error, if all attempts failed, and the number of attempts."""
    import time

    for attempt in range(1, handler.retries + 2):
        error = _once(handler, rows, batch_id)
        if error is None:
            break
        if attempt <= handler.retries:
            time.sleep(handler.delay)
    return error, attempt


def completions(rows: DataFrame, handler: str, error: str | None, attempts: int) -> DataFrame:
    """An event of completion or failure for each event (event_id, event_type, props) that the handler got."""
    ok = error is None
    return rows.select(
        F.xxhash64("event_id", F.lit(handler)).alias("event_id"), F.lit("handler.completed" if ok else "handler.failed").alias("event_type"), F.lit("engine").alias("source"), F.col("event_id").alias("of"),
        F.lit(handler).alias("handler"), F.col("event_type").alias("original_event_type"), F.col("props"), F.lit(ok).alias("ok"), F.lit(error).cast("string").alias("error"), F.lit(attempts).cast("int").alias("attempts"),
    )


def dispatch(events: DataFrame, handlers: list[Handler], done: str, checkpoint: str, most: int = 4) -> None:
    """Work off what is there of a stream of events (event_id, event_type, props, ...); completions go below done.

    At most `most` handlers run at once. A handler that fails or is late does not stop the others, nor the stream.
    """
    if len({h.name for h in handlers}) < len(handlers):
        raise ValueError("a handler is registered twice")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        left = [h for h in handlers if not exists(spark, f"{done}/{batch_id}-{h.name}")]
        if not left:
            return
        batch.persist()
        try:
            present = {r.event_type for r in batch.select("event_type").distinct().limit(1_000).collect()}
            mine = {h.name: batch if "*" in h.types else batch.where(F.col("event_type").isin(*h.types)) for h in left}
            left = [h for h in left if present and ("*" in h.types or not present.isdisjoint(h.types) or len(present) == 1_000)]
            with ThreadPoolExecutor(most) as pool:
                outcomes = {h.name: pool.submit(_tried, h, mine[h.name], batch_id) for h in left}
                for name, outcome in outcomes.items():
                    error, attempts = outcome.result()
                    publish(completions(mine[name], name, error, attempts), f"{done}/{batch_id}-{name}")
        finally:
            batch.unpersist()

    events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def completed(spark: SparkSession, done: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of completions below done."""
    fs, at = _path(spark, done)
    fs.mkdirs(at)
    return spark.readStream.schema(COMPLETIONS).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(done)


def cascade(events: DataFrame, handlers: list[Handler], folder: str, most: int = 4) -> None:
    """Both streams: handlers of handler.completed and handler.failed get what the others' handling made, and no more."""
    spark = events.sparkSession
    second = [h for h in handlers if any(t.startswith("handler.") for t in h.types)]
    dispatch(events, [h for h in handlers if h not in second], f"{folder}/done", f"{folder}/checkpoint", most)
    if second:
        dispatch(completed(spark, f"{folder}/done"), second, f"{folder}/followed", f"{folder}/checkpoint-2", most)
