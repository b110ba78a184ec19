"""Files replaced whole as a Spark sink: df.write.format("file_tree").option("path", ROOT).mode("append").save().

df has relative_path and content; other columns are not read. Tasks write below a stage folder of the job beside the files. When all
have ended, the commit writes a journal that names the attempts that count and moves their files into place; what a lost or
repeated attempt left behind goes with the stage. Before the journal is there no file has changed, and an abort removes the stage; a
commit that was cut off after it is ended by finish(ROOT), which may run any number of times.

Defined cases: files that no row names stay; an empty frame changes nothing; a null path or content, a path that is absolute or
leads out of ROOT, and two rows of one path are errors, and nothing is changed. Paths are those of any file system that
pyarrow opens and all hosts share. Content is written as UTF-8 with the line ends that it has.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row

STAGE, JOURNAL = ".lodestone-", "journal.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    where, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, base.rstrip("/")


def put(where: fs.FileSystem, path: str, content: bytes) -> None:
    where.create_dir(posixpath.dirname(path), recursive=True)
    with where.open_output_stream(path) as f:
        f.write(content)


def below(where: fs.FileSystem, folder: str) -> list[str]:
    """Files of a folder, relative to it, in order."""
    found = where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    return sorted(f.path[len(folder) + 1 :] for f in found if f.type == fs.FileType.File)


@dataclass
class Attempt(WriterCommitMessage):
    """A task's attempt: its folder below the stage."""

    folder: str


def settled(where: fs.FileSystem, base: str, stage: str) -> None:
    """Moves the files of the journal's attempts into place and removes the stage. Those that were moved before are no more there."""
    with where.open_input_stream(f"{stage}/{JOURNAL}") as f:
        attempts = json.loads(f.read())
    for a in attempts:
        for path in below(where, f"{stage}/{a}"):
            where.create_dir(posixpath.dirname(f"{base}/{path}"), recursive=True)
            where.move(f"{stage}/{a}/{path}", f"{base}/{path}")
    where.delete_dir(stage)


def finish(root: str) -> int:
    """Ends commits below root that were cut off after their journal; how many. Stages without one may be of jobs that still run."""
    where, base = opened(root)
    stages = [f.path for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith(STAGE)]
    ready = [s for s in stages if where.get_file_info(f"{s}/{JOURNAL}").type == fs.FileType.File]
    for s in ready:
        settled(where, base, s)
    return len(ready)


class FileTreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, f"{STAGE}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        where, base = opened(self.root)
        folder, seen = uuid.uuid4().hex, set()
        for row in iterator:
            path, content = row["relative_path"], row["content"]
            if path is None or content is None:
                raise ValueError("a file without path or content")
            whole = posixpath.normpath(path)
            if path.startswith("/") or whole.split("/")[0] in ("..", ".") or whole in seen:
                raise ValueError(f"no place for {path!r}, or two rows")
            seen.add(whole)
            put(where, f"{base}/{self.job}/{folder}/{whole}", content.encode())
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        where, base = opened(self.root)
        stage, seen = f"{base}/{self.job}", set()
        attempts = [m.folder for m in messages if m is not None]
        for a in attempts:
            for path in below(where, f"{stage}/{a}"):
                if path in seen:
                    raise ValueError(f"two rows for {path!r}")
                seen.add(path)
        if not seen:
            self.abort([])
            return
        put(where, f"{stage}/.{JOURNAL}", json.dumps(attempts).encode())
        where.move(f"{stage}/.{JOURNAL}", f"{stage}/{JOURNAL}")  # whole or not at all
        settled(where, base, stage)

    def abort(self, messages: list[Attempt | None]) -> None:
        where, base = opened(self.root)
        if where.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/{self.job}")


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "relative_path string, content string"

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        if overwrite:
            raise ValueError("file_tree replaces files, not folders: use mode append")
        return FileTreeWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)


def write_files(files: DataFrame, root: str) -> None:
    """Puts files(relative_path, content) below root, all of them or none."""
    register(files.sparkSession)
    files.select("relative_path", "content").write.format("file_tree").option("path", root).mode("append").save()


def write_document(pieces: DataFrame, folder: str) -> None:
    """Lines of a document (text, and what orders them) as text files whose names are in their order: one after another they are the
    document. Lines are sorted by range, so no task holds all of them."""
    pieces.orderBy(*[c for c in pieces.columns if c != "text"]).select("text").write.mode("overwrite").text(folder)
