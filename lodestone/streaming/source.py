"""Changes of a folder as a streaming source: spark.readStream.format("folder_changes").option("path", ...).option("state", ...).

An offset names a snapshot of the folder: the list of its files with times and sizes, kept as one file of the state folder. A batch
is the difference of two snapshots, so files that go are rows as files that come are, and a batch that is run again after a failure
or a restart gives the same rows. What is there when the stream is first started is no change. With settleMs, a file that was
written to within that time stays as the last snapshot has it. Snapshots that no batch can ask for again are deleted; three at most are kept.

Listing goes over the folder once a trigger, on the driver; rows are made by tasks, CHUNK changes each. Paths are those of any file
system that pyarrow opens, both hosts' alike.
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestone.sources.sinks import STAGE

SCHEMA = "path string, type string, ts timestamp, seq long"
CHUNK = 10_000


class Changes(InputPartition):
    """Some rows of a batch: path, type, milliseconds; seq is the number of the snapshot that has them."""

    def __init__(self, seq: int, rows: list[tuple[str, str, int]]):
        self.seq, self.rows = seq, rows


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(root: str) -> dict[str, tuple[int, int]]:
    """Milliseconds of the last change and size, by path below root."""
    where, base = opened(root)
    base = base.rstrip("/")
    found = where.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    rows = ((f.path[len(base) + 1 :], f) for f in found if f.type == fs.FileType.File)
    return {path: (int((f.mtime_ns or 0) // 1_000_000), f.size) for path, f in rows if not path.startswith(STAGE)}


def differences(before: dict[str, tuple[int, int]], after: dict[str, tuple[int, int]], at: int) -> list[tuple[str, str, int]]:
    """path, type (add, change, unlink) and milliseconds of what differs, by path."""
    rows = [(p, "add" if p not in before else "change", x[0]) for p, x in after.items() if tuple(before.get(p, ())) != tuple(x)]
    return sorted(rows + [(p, "unlink", at) for p in before if p not in after])


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state = options["path"], options["state"].rstrip("/")
        self.settle_ms = int(options.get("settlems", options.get("settleMs", "500")))

    def _file(self, number: int) -> str:
        return f"{opened(self.state)[1]}/snapshot-{number:012d}.json"

    def _numbers(self) -> list[int]:
        where, base = opened(self.state)
        found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(f.base_name[9:21]) for f in found if f.base_name.startswith("snapshot-") and f.base_name.endswith(".json"))

    def _read(self, number: int) -> dict:
        with opened(self.state)[0].open_input_stream(self._file(number)) as f:
            return json.loads(f.read())

    def _write(self, number: int, files: dict) -> None:
        where, base = opened(self.state)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/.new-{number}") as f:
            f.write(json.dumps({"at": int(time.time() * 1000), "files": files}).encode())
        where.move(f"{base}/.new-{number}", self._file(number))  # whole or not at all

    def initialOffset(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            self._write(0, listed(self.root))
            numbers = [0]
        return {"snapshot": numbers[0]}

    def latestOffset(self) -> dict:
        numbers = self._numbers() or [self.initialOffset()["snapshot"]]
        last = {p: tuple(x) for p, x in self._read(numbers[-1])["files"].items()}
        now, fresh = listed(self.root), int(time.time() * 1000) - self.settle_ms
        for p in [p for p, x in now.items() if x[0] > fresh and self.settle_ms]:
            if p in last:
                now[p] = last[p]
            else:
                del now[p]
        if now == last:
            return {"snapshot": numbers[-1]}
        self._write(numbers[-1] + 1, now)
        return {"snapshot": numbers[-1] + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # every snapshot between counts: a file that comes and goes is two changes
        out: list[InputPartition] = []
        before = self._read(start["snapshot"])["files"]
        for number in range(start["snapshot"] + 1, end["snapshot"] + 1):
            whole = self._read(number)
            rows = differences(before, whole["files"], whole["at"])
            out += [Changes(number, rows[a : a + CHUNK]) for a in range(0, len(rows), CHUNK)]
            before = whole["files"]
        return out

    def read(self, partition: Changes) -> Iterator[tuple]:
        for path, kind, ms in partition.rows:
            yield path, kind, datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC), partition.seq

    def commit(self, end: dict) -> None:
        # the batch before the last may be asked for again after a restart
        for number in self._numbers():
            if number < end["snapshot"] - 1:
                opened(self.state)[0].delete_file(self._file(number))


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderChanges)
