"""Media columns: archives of losslessly stored samples and a data source that reads them by byte range."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, stored

#: Payloads are padded by spaces to a positive multiple of this; it is also the width of the stored image.
UNIT = 192
#: Byte ranges that are planned at most; with more bytes, ranges are longer.
MAX_RANGES = 100_000
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes | None) -> bytes:
    data = text or b""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def png_encode(payload: bytes, level: int = 1) -> bytes:
    """8-bit grey image, one sample per byte, rows of UNIT samples without filter."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_decode(media: bytes) -> bytes:
    """The samples of such an image; damaged media raise ValueError."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, packed, width, height = 8, [], 0, 0
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Exact integer statistics of the samples: count, sum, sum of squares, range and a 16-bin histogram."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x, minlength=256)
    levels = np.arange(256)
    seen = np.flatnonzero(bins)
    hist = "/".join(map(str, bins.reshape(16, 16).sum(1).tolist()))
    return f"n={len(x)};sum={int(bins @ levels)};sq={int(bins @ levels**2)};lo={seen[0]};hi={seen[-1]};hist={hist}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, ...), with the path within it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 1 << 25) -> DataFrame:
    """Store every document as a member of ZIP archives in folder; (archive, bytes, members) per archive.

    A member's name is row/doc_id/length, unique within its archive. An archive is written under a
    name of its task attempt and then renamed to one of its partition, so a retried task leaves the same archives.
    """

    def run(batches):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        at, path = open_fs(folder)
        at.create_dir(path, recursive=True)
        row = number = 0
        buffer = archive = None

        def close():
            archive.close()
            data, name = buffer.getvalue(), f"part-{part:06d}-{number:05d}.zip"
            with at.open_output_stream(f"{path}/.{name}.{attempt}") as out:
                out.write(data)
            at.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(data)]), pa.array([len(archive.infolist())])], ["archive", "bytes", "members"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    archive = zipfile.ZipFile(buffer := io.BytesIO(), "w", zipfile.ZIP_STORED)
                name = f"{row:012d}/{'' if doc is None else doc}/{len(text or b'')}.png"
                archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), png_encode(payload_of(text)))
                row += 1
                if buffer.tell() >= archive_bytes:
                    yield close()
                    archive, number = None, number + 1
        if archive is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, "archive string, bytes long, members long")


class ByteRange(InputPartition):
    """The members whose headers start in [start, end) of an archive."""

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.folder = options.get("path")
        self.listed = json.loads(options["archives"]) if "archives" in options else None
        self.step = int(options.get("rangeBytes", 1 << 23))
        self.attempts = int(options.get("attempts", 3))
        self.batch_bytes = int(options.get("batchBytes", 1 << 22))

    def partitions(self):
        """Byte ranges by file sizes alone; each task looks up its members in the archive's own directory."""
        found = self.listed
        if found is None:
            at, path = open_fs(self.folder)
            head = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else ""
            files = at.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True))
            found = sorted([head + f.path, f.size] for f in files if f.is_file and f.path.endswith(".zip"))
        wanted = int(self.options.get("archiveCount", len(found)))
        if wanted != len(found):
            raise OSError(f"{len(found)} of {wanted} archives are listed")
        # Ranges grow with the archives, so that their list stays one that a driver can hold.
        step = max(self.step, sum(size for _, size in found) // MAX_RANGES)
        return [ByteRange(a, s, s + step) for a, size in found for s in range(0, size, step)] or [ByteRange("", 0, 0)]

    def _member(self, at, path: str, info: zipfile.ZipInfo, handle) -> tuple[bytes | None, str | None, object]:
        """A member's bytes by its offset, checked; a failed read is tried again alone, on a new handle."""
        error = None
        for k in range(self.attempts):
            try:
                handle = handle or at.open_input_file(path)
                handle.seek(info.header_offset)
                head = handle.read(30)
                names, extra = struct.unpack_from("<HH", head, 26)
                handle.seek(info.header_offset + 30 + names + extra)
                data = handle.read(info.compress_size)
                if info.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompress(data, -15)
                if head[:4] != b"PK\x03\x04" or zlib.crc32(data) != info.CRC:
                    raise ValueError("checksum differs")
                return data, None, handle
            except Exception as e:  # noqa: BLE001  any member may fail without the others
                error, handle = f"{type(e).__name__}: {e}"[:500], None
                time.sleep(0.05 * k)
        return None, error, handle

    def read(self, partition):
        if not partition.archive:
            return
        for k in range(self.attempts):
            try:
                at, path = open_fs(partition.archive)
                handle = at.open_input_file(path)
                infos = [i for i in zipfile.ZipFile(handle).infolist() if partition.start <= i.header_offset < partition.end]
                break
            except Exception as e:  # noqa: BLE001  a range whose archive cannot be listed is one row that says so
                error = f"{type(e).__name__}: {e}"[:500]
                time.sleep(0.05 * k)
        else:
            yield self._batch([(partition.archive, partition.start, None, None, error)])
            return
        rows, held = [], 0
        for info in sorted(infos, key=lambda i: i.header_offset):
            data, error, handle = self._member(at, path, info, handle)
            rows.append((partition.archive, info.header_offset, info.filename, data, error))
            held += len(data or b"")
            if held >= self.batch_bytes or len(rows) >= 4096:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["archive", "offset", "member", "payload", "error"])


class MediaArchiveSource(DataSource):
    """spark.read.format("media_archive"): option path (a folder of ZIP archives; archiveCount: how many it must hold) or archives (JSON of [path, bytes])."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "archive string, offset long, member string, payload binary, error string"

    def reader(self, schema):
        return MediaArchiveReader(self.options)


def media_features(media: DataFrame, strict: bool = False) -> DataFrame:
    """Decode what was read back and compute the columns of the media. strict: an error fails the task, which reads again when Spark reruns it."""

    def run(batches):
        for batch in batches:
            out = []
            for member, data, error in zip(*(batch.column(i).to_pylist() for i in range(3))):
                # A member's name tells its document, whether or not its bytes can be read.
                _, doc, size = member.split("/") if member else ("", "", "0.png")
                doc, size = int(doc) if doc else None, int(size.removesuffix(".png"))
                try:
                    if error is not None or data is None:
                        raise ValueError(error or "no payload")
                    samples = png_decode(data)
                except (ValueError, struct.error, zlib.error) as e:
                    out.append((member, doc, size if member else None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                out.append(
                    (
                        member, doc, size, len(samples), hashlib.sha256(samples).hexdigest(),
                        zlib.crc32(samples[-16:]), (len(data), hashlib.sha256(data).hexdigest()), feature_of(samples), None,
                    )
                )
            if strict and (errors := [r[0:1] + r[8:] for r in out if r[8]]):
                raise OSError(f"{len(errors)} media could not be read, first {errors[0]}")
            cols = list(zip(*out)) if out else [()] * 9
            media_cols = [[m[i] if m else None for m in cols[6]] for i in range(2)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            data = [cols[1], cols[2], cols[3], cols[4], cols[5], *media_cols, cols[7], cols[8]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(data, kinds)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("member", "payload", "error").mapInArrow(run, schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 1 << 25, strict: bool = False) -> DataFrame:
    """Store every document's padded bytes as media, read them back through the source, and describe them.

    Null and empty texts are one row of spaces; equal texts give equal values; repeated rows are members
    of their own; a null doc_id stays null; an empty table gives an empty result. A member that
    cannot be read after the retries comes back with its error and null columns, or fails the task if strict; the others are whole.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "media")
    archives = stored(write_archives(docs, folder, id_col, text_col, archive_bytes), "archives")
    spark.dataSource.register(MediaArchiveSource)
    # The source lists the folder itself and must find as many archives as were written.
    return media_features(spark.read.format("media_archive").option("path", folder).option("archiveCount", archives.count()).load(), strict)
