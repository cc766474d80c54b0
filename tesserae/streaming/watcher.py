"""A streaming source that watches a folder of snapshots and says when the newest one changed.

A snapshot is an entry of the folder, a table of files written whole and put there by a rename; names sort by age. Offsets
are names of snapshots, so a restart goes on where the checkpoint stands.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EVENTS = "event_type string, source string, since string, ref string, full_scan boolean"


class Change(InputPartition):
    def __init__(self, since: str, ref: str):
        self.since, self.ref = since, ref


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, initial: bool):
        self.path, self.initial = path, initial

    def _newest(self) -> str:
        """The last name in the folder; hidden names and an absent folder are none."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return max((f.base_name for f in found if f.base_name[:1] not in "._"), default="")

    def initialOffset(self) -> dict:  # noqa: N802
        """Where the first poll begins: before everything if it shall report what is there, else at the newest, in silence."""
        return {"ref": "" if self.initial else self._newest()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"ref": self._newest()}

    def partitions(self, start: dict, end: dict) -> list[Change]:
        return [Change(start["ref"], end["ref"])]

    def read(self, partition: Change) -> Iterator[tuple]:
        """One event if the newest snapshot is another one; several that came between two polls are one change."""
        if partition.ref and partition.ref != partition.since:
            yield "code.changed", "watcher", partition.since, partition.ref, not partition.since

    def commit(self, end: dict) -> None:
        pass


class Snapshots(DataSource):
    """Options: path, and initial (true: the first poll reports the newest snapshot as a full scan)."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(self.options["path"], self.options.get("initial", "false").lower() == "true")


def watch(spark: SparkSession, path: str, initial: bool = False) -> DataFrame:
    """The stream of changes (event_type, source, since, ref, full_scan) of the newest snapshot in a folder.

    Silent on its first poll unless initial. With a trigger of a fixed interval each trigger is one poll.
    """
    spark.dataSource.register(Snapshots)
    return spark.readStream.format("snapshots").option("path", path).option("initial", str(initial).lower()).load()
