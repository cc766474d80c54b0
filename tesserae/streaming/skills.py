"""Keyed state of signatures: each sight of one raises its confidence, and it is promoted once.

State is a value per signature in the state store, so a batch costs what it holds and not what was ever seen. Sights are
counted within tasks first, so that one signature with most events sends a row a task, not a row an event.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "signature string, kind string, at long, hits long, confidence double, layer string"
#: Confidence from which a candidate is active (fixed value).
ACTIVE = 0.8


def confidence(hits: int) -> float:
    return min(1.0, 0.5 + hits * 0.1)


class Skills(StatefulProcessor):
    """One state a signature: its hits, whether it is active, and the timer that ends it if it stays a candidate."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("skill", "hits long, active boolean, timer long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        sights, seen = 0, 0
        for r in rows:
            sights += r.n
            seen = max(seen, int(r.seen.timestamp() * 1000) if r.seen else 0)
        if not sights:
            return
        known = self.state.get() if self.state.exists() else None
        hits, active, timer, last = known or (-1, False, 0, 0)
        hits, last = hits + sights, max(last, seen)
        sure = confidence(hits)
        promoted = sure >= ACTIVE and not active
        if self.idle_ms is not None:
            if timer:
                self.handle.deleteTimer(timer)
            # An active skill is never idle.
            timer = 0 if sure >= ACTIVE else last + self.idle_ms
            if timer:
                self.handle.registerTimer(timer)
        self.state.update((hits, sure >= ACTIVE or active, timer, last))
        layer = "active" if sure >= ACTIVE or active else "candidate"
        yield Row(signature=key[0], kind="updated" if known else "created", at=last, hits=hits, confidence=sure, layer=layer)
        if promoted:
            yield Row(signature=key[0], kind="promoted", at=last, hits=hits, confidence=sure, layer=layer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            hits = self.state.get()[0]
            self.state.clear()
            yield Row(signature=key[0], kind="retired", at=expiredTimerInfo.getExpiryTimeInMs(), hits=hits, confidence=confidence(hits), layer="retired")

    def close(self) -> None:
        pass


def counted(sights: DataFrame) -> DataFrame:
    """(signature, n, seen) of (signature, seen): sights of a task's batch counted, with the latest; null signatures are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last = Counter(), {}
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s is not None:
                    n[s] += 1
                    if t is not None and (last.get(s) is None or t > last[s]):
                        last[s] = t
        names = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[s] for s in names], pa.int64()), pa.array([last.get(s) for s in names], pa.timestamp("us", "UTC"))], ["signature", "n", "seen"])

    return sights.select("signature", F.col("seen").cast("timestamp")).mapInArrow(run, "signature string, n long, seen timestamp")


def changes(sights: DataFrame, idle: float | None = None, late: str = "0 seconds") -> DataFrame:
    """Changes (signature, kind, at, hits, confidence, layer) of skills over a stream of sights (signature, seen); at is in event time.

    The first sight creates a candidate of no hits, each further one is a hit. kind is created or updated, once a batch that
    saw the signature, and promoted, once ever, when the confidence reaches ACTIVE. With idle, in seconds, a candidate not
    seen for so long in event time, as the watermark `late` tells it, is retired and forgotten; without it none is.
    """
    n = counted(sights)
    n = n if idle is None else n.withWatermark("seen", late)
    return n.groupBy("signature").transformWithState(Skills(None if idle is None else int(idle * 1000)), CHANGES, "Append", "None" if idle is None else "EventTime")


def run(sights: DataFrame, folder: str, checkpoint: str, idle: float | None = None, late: str = "0 seconds") -> None:
    """Work off what is there; changes go to folder, each once, also after a restart from the checkpoint."""
    spark = sights.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = changes(sights, idle, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", folder).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def current(found: DataFrame) -> DataFrame:
    """(signature, hits, confidence, layer) after changes: the last one of each signature; retired ones are gone until seen anew."""
    last = found.where(F.col("kind") != "promoted").groupBy("signature").agg(F.max_by(F.struct("hits", "confidence", "layer"), F.struct("at", "hits", F.col("kind") == "retired")).alias("s"))
    return last.where("s.layer <> 'retired'").select("signature", "s.hits", F.round("s.confidence", 6).alias("confidence"), "s.layer")


def signature(event_type: Column, props: Column) -> Column:
    """Type and property k of an event; unreadable properties are unknown."""
    return F.concat_ws(":", F.coalesce(event_type, F.lit("unknown")), F.coalesce(F.get_json_object(props, "$.k"), F.lit("unknown")))
