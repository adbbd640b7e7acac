"""Heads of files: a data source that reads the first bytes of each file and, of a film, the box that describes it; a sink that
writes one file a row; and what the heads say about a picture or film."""

from __future__ import annotations

import posixpath
import struct
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quarrylight.shipping import ship
from quarrylight.sources.files import Listing, animated_webp, is_animated, named, select_files

HEAD = 4096  #: bytes
FILES = 500  #: of a partition
BATCH_BYTES = 8 << 20
BOXED = (".mp4", ".mov", ".m4v", ".3gp")  #: files made of boxes, of which `moov` may stand behind the films' data
MOST_BOX = 1 << 20  #: bytes of `moov` that are read
FIELDS = "path string, size long, mtime double, head binary, index binary, n_read long"

# The classes travel to Spark's planner and workers by value, so that these need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def store_of(path: str):
    """(file system, path in it) of a folder of any store that Arrow reaches; without a scheme it is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files


class HeadReader(DataSourceReader):
    """The listing is made once, where the query is planned, as Spark's own file sources do; files go to tasks by number, as
    each costs about the same however large it is."""

    def __init__(self, options):
        self.folder = options["path"]
        self.bytes = int(options.get("bytes", HEAD))
        self.files = int(options.get("files", FILES))
        self.extensions = tuple(x for x in options.get("extensions", "").lower().split(",") if x)
        self.boxed = tuple(options.get("boxed", ",".join(BOXED)).split(","))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, top = store_of(self.folder)
        found = []
        for x in store.get_file_info(fs.FileSelector(top, recursive=True)):
            inner = x.path[len(top.rstrip("/")) + 1 :]
            hidden = any(part[0] in "._" for part in inner.split("/"))
            if x.type == fs.FileType.File and not hidden and (not self.extensions or x.base_name.lower().endswith(self.extensions)):
                found.append((inner, x.size, (x.mtime_ns or 0) / 1e9))
        found.sort()
        return [Files(found[k : k + self.files]) for k in range(0, len(found), self.files)]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        store, top = store_of(self.folder)
        rows, held = [], 0
        for path, size, mtime in partition.files if partition else ():  # an empty folder is one task without a partition
            try:
                with store.open_input_file(f"{top.rstrip('/')}/{path}") as f:
                    head = f.read_at(min(self.bytes, size), 0)
                    index, more = self._index(f, head, size) if path.lower().endswith(self.boxed) else (None, 0)
            except OSError:  # gone since, or not to be read
                head, index, more = None, None, 0
            rows.append((path, size, mtime, head, index, len(head or b"") + more))
            held += len(head or b"") + len(index or b"")
            if held > BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _index(f, head: bytes, size: int) -> tuple[bytes | None, int]:
        """(the `moov` box, bytes read for it): from box to box by the sizes that they begin with, in the head while that lasts."""
        at = read = 0
        while at + 8 <= size:
            start = head[at : at + 16]
            if len(start) < 16:
                start = f.read_at(min(16, size - at), at)
                read += len(start)
            n, kind = struct.unpack_from(">I4s", start)
            n = struct.unpack_from(">Q", start, 8)[0] if n == 1 and len(start) == 16 else n or size - at
            if kind == b"moov":
                if at + n <= len(head):
                    return head[at : at + n], read
                box = f.read_at(min(n, size - at, MOST_BOX), at)
                return box, read + len(box)
            if n < 8:
                break
            at += n
        return None, read

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["path", "size", "mtime", "head", "index", "n_read"])


class FileWriter(DataSourceArrowWriter):
    """One file a row (path, content). A file gets its name when it is whole, so a task that is lost or runs twice leaves whole
    files only; what a failed job has written stays, and a job that runs again replaces it."""

    def __init__(self, options):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, top = store_of(self.folder)
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                at = f"{top.rstrip('/')}/{path}"
                part = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
                store.create_dir(posixpath.dirname(at), recursive=True)
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, at)
        return WriterCommitMessage()


class Heads(DataSource):
    """format("heads"): options path, bytes, files (of a partition), extensions (comma-separated). As a sink: path."""

    @classmethod
    def name(cls) -> str:
        return "heads"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options)


def heads(spark: SparkSession, folder: str, listing: Listing = Listing(), n: int = HEAD, recursive: bool = True, subtree: str | None = None, files: int = FILES) -> DataFrame:
    """(path, name, stem, ext, size, mtime, head, index, n_read) of the files under folder that a listing takes, paths relative.

    head: the first n bytes; index: the `moov` box of a film in boxes, up to a megabyte; n_read: the bytes read of the file.
    Files of other extensions are not opened. Empty files have an empty head; one that cannot be read has none. An empty
    folder gives no rows. For stores that Arrow reaches (local, S3, GCS, HDFS); others have `binaryFile`.
    """
    ship(spark)
    spark.dataSource.register(Heads)
    found = spark.read.format("heads").option("bytes", n).option("files", files).option("extensions", ",".join(listing.extensions)).load(folder)
    out = select_files(named(found), listing, recursive, subtree)
    return out.select("path", "name", "stem", "ext", "size", "mtime", "head", "index", "n_read")


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes a file for each row (path, content) under folder; of equal paths one stays whole."""
    rows.sparkSession.dataSource.register(Heads)
    rows.select("path", "content").write.format("heads").mode("append").save(folder)


def animated(found: DataFrame) -> DataFrame:
    """The rows of `heads` that are animated pictures: each GIF, and a WebP whose head says so."""
    return found.filter(is_animated(F.col("ext"), F.col("head")))


# --- what a head says


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of the boxes between at and end."""
    while at + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, at)
        if n < 8:
            return
        yield kind, at + 8, min(at + n, end)
        at += n


def _film(index: bytes) -> dict:
    """Of a `moov` box: duration, and size and codec of the first track with a picture."""
    out: dict = {"kind": "mp4"}
    inside = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0}
    stack = [(0, len(index), 0, 0)]
    track = (0, 0)
    while stack:
        start, end, width, height = stack.pop()
        for kind, a, b in _boxes(index, start, end):
            if kind == b"mvhd" and b - a >= 20:
                long = index[a] == 1
                if b - a >= (32 if long else 20):
                    scale, length = struct.unpack_from(">IQ" if long else ">II", index, a + (20 if long else 12))
                    out["duration_s"] = length / scale if scale else None
            elif kind == b"tkhd" and b - a >= 84:
                track = tuple(x >> 16 for x in struct.unpack_from(">II", index, b - 8))
                if track[0] and "width" not in out:
                    out["width"], out["height"] = track
            elif kind == b"stsd" and b - a >= 16 and track[0] and "codec" not in out:
                out["codec"] = index[a + 12 : a + 16].decode("latin-1").strip()
            elif kind in inside:
                stack.append((b, end, width, height))
                stack.append((a, b, width, height))
                break
    return out


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """(value, next place) of a number of EBML: the leading zeros of its first byte say how long it is."""
    n = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + n])
    return (value if keep else value & ((1 << 7 * n) - 1)), at + n


def _matroska(data: bytes) -> dict:
    out: dict = {"kind": "matroska"}
    #: Element ids of the format.
    within = {0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0}
    names = {0x2AD7B1: "scale", 0x4489: "duration", 0x86: "codec", 0xB0: "width", 0xBA: "height"}
    at = 0
    while at < len(data):
        try:
            kind, at = _vint(data, at, True)
            n, at = _vint(data, at, False)
        except IndexError:
            break
        if kind in within:
            continue
        if (name := names.get(kind)) and name not in out and at + n <= len(data):
            value = data[at : at + n]
            out[name] = value.decode("latin-1") if name == "codec" else struct.unpack(">d" if n == 8 else ">f", value)[0] if name == "duration" and n in (4, 8) else int.from_bytes(value)
        at += n
    scale, length = out.pop("scale", 1_000_000), out.pop("duration", None)
    if length is not None:
        out["duration_s"] = length * scale / 1e9
    return out


def _jpeg(data: bytes) -> dict:
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return {"kind": "jpeg", "width": width, "height": height}
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return {"kind": "jpeg"}


def _webp(data: bytes) -> dict:
    out: dict = {"kind": "webp", "animated": animated_webp(data)}
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        out["width"], out["height"] = (int.from_bytes(data[k : k + 3], "little") + 1 for k in (24, 27))
    elif kind == b"VP8L" and len(data) >= 25:
        bits = int.from_bytes(data[21:25], "little")
        out["width"], out["height"] = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    elif kind == b"VP8 " and len(data) >= 30:
        out["width"], out["height"] = (x & 0x3FFF for x in struct.unpack_from("<HH", data, 26))
    return out


def said(head: bytes | None, index: bytes | None = None) -> dict:
    """kind, width, height, duration_s, frames, codec, animated, as far as the head of a file and the index of a film say; of
    what neither says nothing is guessed, and what is cut short is no error."""
    data = bytes(head or b"")
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
            width, height = struct.unpack_from(">II", data, 16)
            control = data.find(b"acTL", 33)
            frames = struct.unpack_from(">I", data, control + 4)[0] if control > 0 and len(data) >= control + 8 else None
            return {"kind": "png", "width": width, "height": height, "frames": frames, "animated": frames is not None}
        if data[:4] == b"GIF8" and len(data) >= 10:
            width, height = struct.unpack_from("<HH", data, 6)
            return {"kind": "gif", "width": width, "height": height}
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:2] == b"BM" and len(data) >= 26:
            width, height = struct.unpack_from("<ii", data, 18)
            return {"kind": "bmp", "width": width, "height": abs(height)}
        if data[:4] == b"RIFF" and data[8:12] == b"AVI " and len(data) >= 72 and data[24:28] == b"avih":
            micros, frames, width, height = (struct.unpack_from("<I", data, 32 + k)[0] for k in (0, 16, 32, 36))
            return {"kind": "avi", "width": width, "height": height, "frames": frames, "duration_s": micros * frames / 1e6}
        if data[:4] == b"\x1a\x45\xdf\xa3":
            return _matroska(data)
        if data[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
            return _film(bytes(index or b""))
    except struct.error:
        pass
    return {}


def probed(found: DataFrame) -> DataFrame:
    """The rows of `heads` with probe: (kind, width, height, duration_s, frames, codec, animated, pixels, duration_ms, bitrate).

    pixels is 0 where the size is not known; duration_ms is cut to whole milliseconds; bitrate is of the whole file."""
    ship(found.sparkSession)
    fields = ("kind", "width", "height", "duration_s", "frames", "codec", "animated")

    @F.pandas_udf("kind string, width long, height long, duration_s double, frames long, codec string, animated boolean")
    def probe(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for head, index in rows:
            got = [said(*x) for x in zip(head, index)]
            frame = pd.DataFrame({name: pd.Series([x.get(name) for x in got], dtype=object) for name in fields})
            yield frame.astype({"width": "Int64", "height": "Int64", "frames": "Int64", "duration_s": "Float64", "animated": "boolean"})

    rows = found.withColumn("probe", probe("head", "index"))
    x: Column = F.col("probe")
    more = {
        "pixels": F.coalesce(x["width"] * x["height"], F.lit(0)),
        "duration_ms": F.floor(x["duration_s"] * 1000).cast("long"),
        "bitrate": F.when(x["duration_s"] > 0, F.floor(8 * F.col("size") / x["duration_s"]).cast("long")),
    }
    return rows.withColumn("probe", F.struct("probe.*", *(c.alias(name) for name, c in more.items())))
