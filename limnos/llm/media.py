"""Media columns: payloads as images in archives, read by a data source that plans byte ranges.

A payload is stored without loss as an 8-bit grey PNG of 64 samples a row, many
to a ZIP archive. ``MediaArchives`` is a Spark data source over such archives:
it plans byte ranges, each task reads the archive's directory and streams the
members whose records start in its range as Arrow batches, and every member is
tried again on its own, at its offset, when reading it fails.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from limnos.storage import new_path, stage

WIDTH = 64
MAGIC = b"\x89PNG\r\n\x1a\n"
#: Bytes of members after which a task begins a new archive, and of a read's partition.
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
#: Tasks that read archives, at most.
MOST_TASKS = 20_000
BATCH_BYTES = 4 << 20


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """A grey PNG whose rows are the payload; the unpadded size is a text field of it."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[int, bytes]:
    """(unpadded size, payload) of what encode_png made; every chunk's checksum is held."""
    if data[:8] != MAGIC:
        raise ValueError("no PNG")
    at, packed, n_bytes, height = 8, [], -1, 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"chunk {name!r} is damaged")
        if name == b"IHDR":
            width, height, *kind = struct.unpack(">IIBBBBB", body)
            if width != WIDTH or kind != [8, 0, 0, 0, 0]:
                raise ValueError("other samples than 64 grey bytes a row")
        elif name == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    return n_bytes, lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation, shares of eight grey bands and mean step between rows, as JSON."""
    grey = np.frombuffer(payload, np.uint8)
    bands = np.bincount(grey >> 5, minlength=8) / len(grey)
    rows = grey.reshape(-1, WIDTH)
    step = float(sum(int(np.abs(rows[i + 1 : i + 4097].astype(np.int16) - rows[i : i + 4096][: len(rows) - 1 - i].astype(np.int16)).sum()) for i in range(0, len(rows) - 1, 4096)))
    mean = int(grey.sum(dtype=np.int64)) / len(grey)
    square = sum(int((grey[i : i + (1 << 20)].astype(np.int64) ** 2).sum()) for i in range(0, len(grey), 1 << 20)) / len(grey)
    values = {"mean": mean, "deviation": max(square - mean * mean, 0.0) ** 0.5, "bands": [float(x) for x in bands], "step": step / max(len(grey) - WIDTH, 1)}
    return json.dumps({k: [round(x, 6) for x in v] if isinstance(v, list) else round(v, 6) for k, v in values.items()}, separators=(",", ":"))


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text's payload in archives below ``path``; returns (archive, bytes, members) of each.

    An archive is named anew by each attempt of a task, and only the rows of
    attempts that Spark commits name archives, so lost or repeated attempts
    leave nothing that is read.
    """
    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        task, done, archive, number = TaskContext.get().partitionId(), [], None, 0

        def close() -> None:
            archive.close()
            sink.close()
            done.append((f"{path}/{name}", files.get_file_info(f"{folder}/{name}").size, number))

        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                if archive is None:
                    name, number = f"{task:06d}-{uuid.uuid4().hex}.zip", 0
                    sink = files.open_output_stream(f"{folder}/{name}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                n_bytes, payload = payload_of(text.as_py())
                info = zipfile.ZipInfo(f"{number:08d}.png")
                info.comment = b"" if key.as_py() is None else b"=" + key.as_py().encode()
                archive.writestr(info, encode_png(payload, n_bytes))
                number += 1
                if sink.tell() > ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        names, sizes, members = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.int64())], ["archive", "bytes", "members"])

    return stage(picked.mapInArrow(write, "archive string, bytes long, members long"), "media-archives")


def _member_at(source: pa.NativeFile, info: zipfile.ZipInfo) -> bytes:
    source.seek(info.header_offset)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise OSError("no member starts here")
    names, extra = struct.unpack_from("<HH", head, 26)
    source.seek(info.header_offset + 30 + names + extra)
    data = source.read(info.compress_size)
    if zlib.crc32(data) != info.CRC or len(data) != info.file_size:
        raise OSError("its bytes are damaged")
    return data


class ByteRanges(InputPartition):
    """Ranges (archive, first byte, end) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


class MediaReader(DataSourceReader):
    """Members of the archives that a written list (option ``list``) names."""

    def __init__(self, options: dict[str, str]) -> None:
        self.list = options["list"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.most_tasks = int(options.get("most_tasks", MOST_TASKS))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> Sequence[InputPartition]:
        """Tasks of range_bytes or, of very many archives, of more, so that there are MOST_TASKS at most.

        Large archives are split at bytes; small ones, and the ends of large
        ones, are packed together, so an archive is opened by few tasks.
        """
        files, folder = fs.FileSystem.from_uri(self.list)
        table = pads.dataset(folder, filesystem=files, format="parquet").to_table(columns=["archive", "bytes"]).sort_by("archive")
        archives = list(zip(table.column("archive").to_pylist(), table.column("bytes").to_pylist(), strict=True))
        most = max(self.range_bytes, -(-sum(n for _, n in archives) // self.most_tasks))
        out: list[InputPartition] = []
        ranges, size = [], 0
        for archive, n in archives:
            for at in range(0, n, most):
                ranges.append((archive, at, min(at + most, n)))
                size += ranges[-1][2] - at
                if size >= most:
                    out.append(ByteRanges(ranges))
                    ranges, size = [], 0
        return [*out, ByteRanges(ranges)] if ranges or not out else out

    def member(self, source: pa.NativeFile, archive: str, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset; when that fails, tried again alone on a fresh file."""
        for left in range(self.tries - 1, -1, -1):
            try:
                if left == self.tries - 1:
                    return _member_at(source, info)
                time.sleep(0.2 * (self.tries - left))
                files, path = fs.FileSystem.from_uri(archive)
                with files.open_input_file(path) as fresh:
                    return _member_at(fresh, info)
            except OSError as e:
                if not left:
                    raise OSError(f"{archive}: member {info.filename} at {info.header_offset}: {e}") from e
        raise AssertionError

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        keys, data, size = [], [], 0
        for archive, start, end in partition.ranges:
            files, path = fs.FileSystem.from_uri(archive)
            with files.open_input_file(path) as source:
                for info in zipfile.ZipFile(source).infolist():
                    if not start <= info.header_offset < end:
                        continue
                    keys.append(info.comment[1:].decode() if info.comment else None)
                    data.append(self.member(source, archive, info))
                    size += len(data[-1])
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.binary())], ["id", "media"])
                        keys, data, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.binary())], ["id", "media"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").option("list", path)``: id and media of every member."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "id string, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(dict(self.options))


def read_archives(spark: SparkSession, archives: DataFrame, **options) -> DataFrame:
    """Every member of the archives that a staged list holds."""
    spark.dataSource.register(MediaArchives)
    listed = archives.inputFiles()
    folder = listed[0].rsplit("/", 1)[0] if listed else ""
    return spark.read.format("media_archives").option("list", folder).options(**options).load()


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Payload, stored form and features of every whole text, from bytes that were read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 and feature, one row per input row. Null texts
    count as empty; an empty text is 64 zeros. Equal texts have equal values,
    repeated rows and null ids stay. Texts of any length are one image each.
    Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    archives = write_archives(docs, new_path(spark, "media"), id_col, text_col)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media"):
                media = data.as_py()
                n_bytes, payload = decode_png(media)
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    out = read_archives(spark, archives).mapInArrow(describe, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(F.col("id").cast(kind).alias("doc_id"), *out.columns[1:])
