"""Results as files of their own: a Spark data source that writes bytes, a file a row, in two phases.

    spark.dataSource.register(Files)
    done.select("path", "redacted_bytes").write.format("penumbra_files").option("folder", out).mode("append").save()

A task writes its rows into a folder of its own under `_work`; only the driver's commit, when all tasks are through, moves
their files to their names. A task that fails or is repeated leaves nothing: its folder goes. Rows whose names clash are
told apart by a number before the ending, in the order of their task and row. A folder is a path or address that driver and
executors share and pyarrow can write to.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

ENDING = ".redacted.out"


def result_name(path: str) -> str:
    """The file's name without its ending, and the ending of results."""
    name = posixpath.basename(path.replace("\\", "/").rstrip("/")) or "unnamed"
    return re.sub(r"(?<=.)\.[^.]+$", "", name) + ENDING


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.uri = options.get("folder") or options.get("path")
        if not self.uri:
            raise ValueError("the option folder names where files go")
        self.name, self.bytes = (options.get(k, v) for k, v in (("name", schema.names[0]), ("bytes", schema.names[1])))
        self.work = f"_work/{uuid.uuid4().hex}"
        # made on the driver: once a write is given up and this is gone, tasks still under way can't begin
        self._store().create_dir(self.work, recursive=True)

    def _store(self) -> fs.FileSystem:
        """The folder's store, with the folder as its root."""
        store, root = fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri)
        store.create_dir(root, recursive=True)
        return fs.SubTreeFileSystem(root, store)

    def write(self, rows: Iterator[Row]) -> Written:
        own, store = TaskContext.get(), self._store()
        folder, names = f"{self.work}/{own.partitionId()}-{own.taskAttemptId()}", []
        store.create_dir(folder, recursive=False)
        try:
            for row in rows:
                if row[self.bytes] is None:
                    continue
                with store.open_output_stream(f"{folder}/{len(names)}") as f:
                    f.write(row[self.bytes])
                names.append(result_name(row[self.name] or ""))
        except BaseException:
            if store.get_file_info(folder).type == fs.FileType.Directory:
                store.delete_dir(folder)
            raise
        return Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store = self._store()
        taken = {i.base_name for i in store.get_file_info(fs.FileSelector(""))}
        for m in messages:
            for i, name in enumerate(m.names if m else ()):
                free, n = name, 1
                while free in taken:
                    n += 1
                    free = f"{name.removesuffix(ENDING)}.{n}{ENDING}"
                taken.add(free)
                store.move(f"{m.folder}/{i}", free)
        self._done(store)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._done(self._store())

    def _done(self, store: fs.FileSystem) -> None:
        for folder, only_empty in ((self.work, False), ("_work", True)):
            if store.get_file_info(folder).type == fs.FileType.Directory and not (only_empty and store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class Files(DataSource):
    """(name, bytes) rows to files; options folder, name and bytes (columns, by default the first two)."""

    @classmethod
    def name(cls) -> str:
        return "penumbra_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added to a folder: use mode append")
        return FilesWriter(dict(self.options), schema)
