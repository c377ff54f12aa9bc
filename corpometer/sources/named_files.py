"""A sink that writes one file for each row, under the name that the row gives, all or none of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "named_files"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The folder in which a task has left its files."""

    folder: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    """Every attempt of a task writes to a folder of its own; the files of those that count are moved at the end.

    The folder of all attempts lies beside the files and goes in either case, so nothing of an attempt that failed,
    or came second, is left. A row without a name is left out.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = filesystem(self.staging)
        folder = f"{root}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        files = 0
        for name, value in iterator:
            if name is not None:
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write((value or "").encode("utf-8"))
                files += 1
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not old.base_name.startswith("_staging-"):
                    store.delete_dir(old.path) if old.type == fs.FileType.Directory else store.delete_file(old.path)
        for message in messages:
            if message is not None:
                for one in store.get_file_info(fs.FileSelector(message.folder)):
                    store.move(one.path, f"{root}/{one.base_name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = filesystem(self.staging)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


class NamedFiles(DataSource):
    """``(file, value)`` to one file per row; names must differ."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named_files(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``value`` of each row to the file ``path/file``. Names must differ.

    The path is one that every executor reaches, on a file system that Arrow knows (local or mounted, hdfs, s3, gs).
    Files appear when all tasks are done; if the job fails there are none, and those before stay as they were.
    """
    df.sparkSession.dataSource.register(NamedFiles)
    df.select("file", "value").write.format(FORMAT).mode(mode).save(path)
