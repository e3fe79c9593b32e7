"""A sink of files by path: every task writes its own, and all of them appear when the job is done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .sources.raw import file_system

#: Files that are put in place at once.
AT_ONCE = 16


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


def checked(path: str | None) -> str:
    """A path below the sink's folder; ValueError for one that is empty or leads elsewhere."""
    parts = (path or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0] == "_temporary":
        raise ValueError(f"not a path below the folder: {path!r}")
    return "/".join(parts)


class FilesWriter(DataSourceArrowWriter):
    """Tasks write to folders of their own under _temporary; commit moves files to their places, abort deletes what there is.

    What a task writes while it is being killed can outlive an abort, under _temporary.
    """

    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def _held(self) -> tuple[fs.FileSystem, str, str]:
        store, root = file_system(self.path)
        root = root.rstrip("/")
        return store, root, f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, held = self._held()
        own, n = f"{held}/{uuid.uuid4().hex}", 0
        try:
            for b in iterator:
                for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                    place = f"{own}/{checked(path)}"
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(place) as f:
                        if content.is_valid:
                            f.write(content.as_buffer())
                    n += 1
        except BaseException:
            _gone(store, own)
            raise
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, held = self._held()
        # what failed or repeated tasks have left is in no message
        for m in messages:
            if m is None or not m.files:
                continue
            found = [f.path for f in store.get_file_info(fs.FileSelector(m.folder, recursive=True)) if f.type == fs.FileType.File]
            pairs = [(p, f"{root}/{p[p.index(m.folder) + len(m.folder) + 1 :]}") for p in found]
            for folder in {to.rsplit("/", 1)[0] for _, to in pairs}:
                store.create_dir(folder, recursive=True)

            def move(pair: tuple[str, str]) -> None:
                if store.get_file_info(pair[1]).type != fs.FileType.NotFound:
                    store.delete_file(pair[1])
                store.move(*pair)

            with ThreadPoolExecutor(AT_ONCE) as pool:
                list(pool.map(move, pairs))
        self._clean(store, root, held)

    def abort(self, messages: list[Written | None]) -> None:
        store, root, held = self._held()
        self._clean(store, root, held)

    @staticmethod
    def _clean(store: fs.FileSystem, root: str, held: str) -> None:
        _gone(store, held)
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{root}/_temporary")):
            _gone(store, f"{root}/_temporary")


def _gone(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


class Files(DataSource):
    """Rows (path STRING, content BINARY): a file each, of this content, at this path below the folder of save()."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Writes a file for each row of (path, content) below folder, from the tasks that hold the rows.

    Text is written as UTF-8, a null content as an empty file. A file that is there is replaced. Paths must differ; a path that is
    empty or leads out of the folder fails the job. Where a job fails, no file appears; where moving them fails half way,
    some have. folder: any address that pyarrow.fs opens.
    """
    files.sparkSession.dataSource.register(Files)
    d = files.select("path", F.col("content").cast("binary").alias("content"))
    d.write.format("tidemark_files").mode("append").save(folder)
