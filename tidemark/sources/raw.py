"""A data source of captured bytes: samples, frames and lines, read by ranges of a file, so that a large one is read by many tasks.

    spark.dataSource.register(RawBytes)
    spark.read.format("tidemark_raw").option("kind", "samples").load("hdfs://captures")

Paths are those that pyarrow.fs opens (local, hdfs, s3, gs). What only Spark's own readers open goes through
`media.raw_files` and the functions on tables there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range at about; ranges end where a block, a frame or a line does.
SPLIT = 128 << 20
#: Bytes that a task holds at a time.
READ = 4 << 20

SCHEMAS = {
    "samples": "recording_id string, block int, sample_rate int, first bigint, samples array<smallint>",
    "frames": "recording_id string, idx bigint, time double, width int, height int, pixels binary",
    "lines": "recording_id string, line_no bigint, line string",
}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, its path) of an address with or without a scheme."""
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


def recording_of(path: str) -> str:
    """A file's name without its ending."""
    return re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class RawReader(DataSourceReader):
    """Ranges of all files of a folder, or of one file."""

    def __init__(self, options: dict[str, str]) -> None:
        get = lambda name, default: int(float(options.get(name, default)))
        self.path, self.kind = options["path"], options.get("kind", "samples")
        if self.kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        self.rate, self.block, self.channels = get("rate", 22050), get("block", 65536), get("channels", 1)
        self.width, self.height = get("width", 32), get("height", 32)
        self.fps, self.begin, self.split = float(options.get("fps", 2.0)), float(options.get("start", 0.0)), get("split", SPLIT)
        # a block's samples, a frame; a line has no length of its own
        self.unit = {"samples": 2 * self.block, "frames": self.width * self.height, "lines": 1}[self.kind]
        if min(self.unit, self.split, self.rate) < 1 or not self.fps > 0:
            raise ValueError("sizes and rates must be above 0")

    def partitions(self) -> list[Range]:
        store, place = file_system(self.path)
        info = store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
        step = max(1, self.split // self.unit) * self.unit
        out = []
        for f in sorted(found, key=lambda f: f.path):
            hidden = any(p[:1] in "._" for p in f.path[len(place) :].strip("/").split("/") if p) if f.path != place else False
            if f.type == fs.FileType.File and not hidden:
                out += [Range(f.path, a, min(a + step, f.size), f.size) for a in range(0, f.size, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        with store.open_input_file(partition.path) as file:
            yield from getattr(self, f"_{self.kind}")(file, partition)

    def _samples(self, file, part: Range) -> Iterator[pa.RecordBatch]:
        step = max(1, READ // self.unit) * self.unit
        for a in range(part.start, part.end, step):
            x = np.frombuffer(file.read_at(min(step, part.end - a) // 2 * 2, a), "<i2")
            if not len(x):
                continue
            cuts = np.append(np.arange(0, len(x), self.block), len(x))
            first = a // 2 + cuts[:-1]
            yield self._batch(part, [first // self.block, np.full(len(first), self.rate), first, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x))], [pa.int32(), pa.int32(), pa.int64(), None], ["block", "sample_rate", "first", "samples"])

    def _frames(self, file, part: Range) -> Iterator[pa.RecordBatch]:
        step = max(1, READ // self.unit) * self.unit
        whole = part.end // self.unit * self.unit
        for a in range(part.start, whole, step):
            data = file.read_at(min(step, whole - a), a)
            idx = a // self.unit + np.arange(len(data) // self.unit)
            pixels = [data[i : i + self.unit] for i in range(0, len(idx) * self.unit, self.unit)]
            n = len(idx)
            yield self._batch(part, [idx, self.begin + idx / self.fps, np.full(n, self.width), np.full(n, self.height), pa.array(pixels, pa.binary())], [pa.int64(), pa.float64(), pa.int32(), pa.int32(), None], ["idx", "time", "width", "height", "pixels"])

    def _lines(self, file, part: Range) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range; the last of them is read to its end beyond it."""
        at, held = part.start, b""
        if part.start:
            # the line that the range before has read: up to its end, which may be the byte before this range
            at = part.start - 1
            while at < part.size:
                data = file.read_at(min(READ, part.size - at), at)
                found = data.find(b"\n")
                if found >= 0:
                    at += found + 1
                    break
                at += len(data)
        begin = at
        while begin < part.end:
            data = file.read_at(min(READ, part.size - at), at) if at < part.size else b""
            at += len(data)
            held += data
            *lines, rest = held.split(b"\n")
            if not data and rest:
                lines, rest = [*lines, rest], b""
            starts, own = [], []
            for line in lines:
                if begin >= part.end:
                    break
                starts.append(begin)
                own.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                begin += len(line) + 1
            held = rest
            if own:
                yield self._batch(part, [starts, own], [pa.int64(), pa.string()], ["line_no", "line"])
            if not data:
                break

    def _batch(self, part: Range, columns: list, types: list, names: list[str]) -> pa.RecordBatch:
        arrays = [c if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        who = pa.array([recording_of(part.path)] * len(arrays[0]), pa.string())
        return pa.RecordBatch.from_arrays([who, *arrays], ["recording_id", *names])


class RawBytes(DataSource):
    """Options: kind (samples, frames, lines), split; rate, block; width, height, fps, start.

    samples: blocks of `block` little-endian 16-bit samples, with the place of the first one; an odd last byte is dropped.
    frames: 8-bit gray frames; one that is cut short at the end is dropped.
    lines: UTF-8 text; line_no is the place of a line's first byte, so it orders the lines of a file.
    Recordings are files, named without their ending; names that begin with a dot or an underscore are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_raw"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "samples")]

    def reader(self, schema) -> DataSourceReader:
        return RawReader(dict(self.options))


def read_raw(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """The source's rows of all files under path."""
    spark.dataSource.register(RawBytes)
    return spark.read.format("tidemark_raw").options(kind=kind, **{k: str(v) for k, v in options.items()}).load(path)
