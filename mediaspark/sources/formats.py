"""Data sources by name: ranges of files, captured datagrams and playlists, in batches and as streams.

``register(spark)`` makes them known; then ``spark.read.format("byte_ranges").load(path)``. Folders are listed on the
driver, by name and size only; files are read in tasks, each a range of one file. Paths may be local or of any store that
pyarrow.fs opens by its address. A stream's offset has the size of each file that is in the folder, so finished files are
to be moved away in time; files only grow.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import readers

#: Bytes of one chunk of ``byte_ranges``, and of one task's range of a file.
CHUNK, RANGE = 64 << 20, 256 << 20
CHUNKS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])
#: Bytes of a datagram from which only its header is given: no sender makes such.
MOST = 64 << 20


@dataclass
class Range(InputPartition):
    """The bytes from ``start`` to ``end`` of a file that has ``size`` bytes; ``last`` if what is cut off at its end counts."""

    path: str
    start: int
    end: int
    size: int
    last: bool = True


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, pattern: str) -> dict[str, int]:
    """Sizes of the files at or below ``path`` whose names fit ``pattern``, by path as it can be opened again."""
    store, inner = opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    return {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)}


class _Source(DataSource):
    """Options: path; pattern, which file names must fit; range_bytes, the most that one task reads of a file."""

    pattern = "*"
    #: Whether a file must stay in one task.
    whole = False

    def cut(self, path: str, start: int, end: int, size: int, last: bool = True) -> list[Range]:
        step = max(1, end - start) if self.whole else self.step()
        return [Range(path, at, min(at + step, end), size, last) for at in range(start, end, step)]

    def step(self) -> int:
        return max(1, int(self.options.get("range_bytes", RANGE)))

    def listed(self) -> dict[str, int]:
        return listed(self.options["path"], self.options.get("pattern", self.pattern))

    def rows(self, part: Range) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)


class _Batch(DataSourceReader):
    def __init__(self, source: _Source) -> None:
        self.source = source

    def partitions(self) -> list[Range]:
        found = sorted(self.source.listed().items())
        return [p for path, size in found for p in self.source.cut(path, 0, size, size)] or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        return self.source.rows(part) if part.path else iter(())


class _Stream(DataSourceStreamReader):
    """Each batch has the bytes that files have grown by. A whole-file source has each file once, when it is first seen."""

    def __init__(self, source: _Source) -> None:
        self.source = source

    def initialOffset(self) -> dict:
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:
        return {"sizes": json.dumps(self.source.listed(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        was, now = json.loads(start["sizes"]), json.loads(end["sizes"])
        grown = [(p, was.get(p, 0), size) for p, size in sorted(now.items()) if size > was.get(p, 0) and not (self.source.whole and p in was)]
        return [r for p, a, b in grown for r in self.source.cut(p, a, b, b, False)]

    def read(self, part: Range) -> Iterator[tuple]:
        return self.source.rows(part)


class ByteRanges(_Source):
    """One row per chunk of ``chunk_bytes`` of each file: path, at, length, size (of the file), content.

    Chunks begin at multiples of ``chunk_bytes`` and lie in the range that holds their beginning, so they are the same with
    any ``range_bytes``. An empty file has no row. Not for streams: a file that grows would change its last chunk.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, at bigint, length bigint, size bigint, content binary"

    def streamReader(self, schema) -> DataSourceStreamReader:
        raise NotImplementedError("byte_ranges reads whole files")

    def step(self) -> int:
        chunk = self.chunk()
        return max(1, super().step() // chunk) * chunk

    def chunk(self) -> int:
        return max(1, int(self.options.get("chunk_bytes", CHUNK)))

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, inner = opened(part.path)
        chunk = self.chunk()
        with store.open_input_file(inner) as f:
            for at in range(part.start, part.end, chunk):
                data = f.read_at(min(chunk, part.size - at), at)
                row = {"path": part.path, "at": at, "length": len(data), "size": part.size, "content": data}
                yield pa.RecordBatch.from_pylist([row], CHUNKS)


class Datagrams(_Source):
    """One row per datagram of capture files, in which datagrams stand one behind the other: path, at, datagram.

    A datagram's header says where the next one begins, so a task walks the headers of its file up to its range, and reads
    the datagrams whose last byte lies in the range: the same rows with any ``range_bytes``, and in a stream a datagram that is
    written in parts comes when it is whole. ``magic`` is an option. What follows a header that is none can't be told
    apart: that header's bytes are a row of their own, and the file's last. So are, in a batch, those of a datagram that is
    cut off at the end; ``readers.read_datagrams`` gives the reason.
    """

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "path string, at bigint, datagram binary"

    def rows(self, part: Range) -> Iterator[tuple]:
        magic = self.options["magic"].encode()
        store, inner = opened(part.path)
        with store.open_input_file(inner) as f:
            at = 0
            while at < part.end:
                head = f.read_at(min(readers.HEADER, part.size - at), at)
                wrong = next((k for k, (x, y) in enumerate(zip(head, magic, strict=False)) if x != y), None)
                end = at + readers.HEADER + int.from_bytes(head[-4:], "big") if len(head) == readers.HEADER else part.size + 1
                if wrong is not None or end > part.size:
                    # the file's last row, in the range of the byte that makes it so; a stream waits for one to become whole
                    if part.start <= at + (wrong or 0) < part.end and (part.last or wrong is not None):
                        yield part.path, at, head
                    return
                if end > part.end:
                    return
                if end > part.start:
                    yield part.path, at, f.read_at(end - at, at) if end - at <= MOST else head
                at = end


class Playlists(_Source):
    """One row per play item of the playlist files of discs: path, disc_id, playlist, header, item_no, clip, in_45k, out_45k.

    ``readers.playlist_eye`` tells the base eye from the header. A file is read whole, in one task; one that is malformed or
    has no item gives no row.
    """

    pattern = "*.[mM][pP][lL][sS]"
    whole = True

    @classmethod
    def name(cls) -> str:
        return "disc_playlists"

    def schema(self) -> str:
        return "path string, disc_id string, playlist string, header binary, item_no int, clip string, in_45k bigint, out_45k bigint"

    def rows(self, part: Range) -> Iterator[tuple]:
        store, inner = opened(part.path)
        with store.open_input_file(inner) as f:
            data = f.read()
        above, _, below = part.path.partition("/BDMV/")
        disc = above.rsplit("/", 1)[-1] if below else ""
        for item in readers.play_items(data):
            yield part.path, disc, part.path.rsplit("/", 1)[-1], data[: readers.FLAGS_AT + 1], *item


def register(spark: SparkSession) -> SparkSession:
    for source in (ByteRanges, Datagrams, Playlists):
        spark.dataSource.register(source)
    return spark
