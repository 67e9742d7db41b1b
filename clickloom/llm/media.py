"""Media columns: payloads stored losslessly as images in archives, and a Spark data source that reads them back.

``store`` turns each text into a payload (its UTF-8 bytes, padded with blanks to a
multiple of ``ROW``), draws it as an 8-bit RGB picture (PNG, lossless) and lets every
task write its pictures as members of ZIP archives in the shared folder. The data
source ``media_archive`` reads them: the driver looks only at the directory of
archives and each archive's end record, and plans ranges of bytes; the task of a
range finds the members that begin in its range in the archive's own central
directory, reads each by its offset, checks it against its CRC and hands batches
of limited size to Spark through Arrow. A member whose read fails is tried again by
itself, from its offset, with the file opened anew.

Folders are reached through ``pyarrow.fs`` by URI, so any shared file system it
knows will do. Archives of a failed or repeated task attempt are never listed: only
a committed job's manifest names the archives that count.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from clickloom.session import work_path

ROW = 192  # payload bytes per picture row: 64 RGB pixels
LEVEL = 1  # deflate
ARCHIVE_BYTES = 128 << 20  # a task starts another archive from here
RANGE_BYTES = 16 << 20  # bytes of archive per read task
BATCH_BYTES = 4 << 20  # payload per Arrow batch
TRIES, PAUSE_S = 3, 0.2
MANIFEST = "_manifest"

# fixed values: the PNG and ZIP formats
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, END64_AT = b"PK\x06\x06", b"PK\x06\x07"


# ---- payloads and pictures


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with byte 32 to a positive multiple of ``ROW``, and their number before."""
    data = (text or "").encode("utf-8")
    return data + b" " * (-len(data) % ROW if data else ROW), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A PNG of 64 RGB pixels per row that holds the payload's bytes as samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter byte 0 before each row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a picture that ``to_png`` made."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, packed, header = 8, [], b""
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = data
        elif kind == b"IDAT":
            packed.append(data)
        at += size + 12
    width, height, *form = struct.unpack(">IIBBBBB", header)
    if width * 3 != ROW or form != [8, 2, 0, 0, 0]:
        raise ValueError("not a picture of this kind")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, spread and a 64-bit average hash of the samples, as text.

    The hash has a bit for each 64th of the payload: 1 where its mean is above the whole mean.
    """
    x = np.frombuffer(payload, np.uint8)
    parts = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) * len(x)
    sizes = np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    total = int(x.sum(dtype=np.int64))
    bits = np.packbits(parts > total * sizes).tobytes().hex()
    mean = total / len(x)
    spread = float(np.sqrt(max(0.0, float(np.dot(x.astype(np.float64), x)) / len(x) - mean * mean)))
    return f"mean={mean:.4f};sd={spread:.4f};ahash={bits}"


# ---- archives


class ArchiveWriter:
    """Writes stored (not compressed again) members and a central directory, ZIP64 where needed."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def add(self, name: str, data: bytes) -> None:
        label, crc = name.encode(), zlib.crc32(data)
        head = struct.pack("<4sHHHHHIIIHH", LOCAL, 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(label), 0)
        self.members.append((label, self.at, crc, len(data)))
        self.out.write(head + label + data)
        self.at += len(head) + len(label) + len(data)

    def close(self) -> None:
        start = self.start = self.at
        for label, at, crc, size in self.members:
            self._put(
                struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 20, 20, 0x800, 0, 0, 0x21, crc, size, size, len(label), 0, 0, 0, 0, 0, at)
                + label
            )
        size, count = self.at - start, len(self.members)
        if count >= 0xFFFF:
            end64 = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<4sIQI", END64_AT, 0, end64, 1))
        few = min(count, 0xFFFF)
        self._put(struct.pack("<4sHHHHIIH", END, 0, 0, few, few, size, start, 0))
        self.out.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)


def central_directory(f, size: int) -> tuple[int, int]:
    """Where the central directory of an archive begins and how long it is, from the end record (no comment)."""
    f.seek(size - 22)
    mark, *_, length, start, _ = struct.unpack("<4sHHHHIIH", f.read(22))
    if mark != END:
        raise ValueError("no end record")
    return start, length


def members_in(f, size: int, low: int, high: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, crc, bytes) of the members whose header begins in [low, high)."""
    start, length = central_directory(f, size)
    f.seek(start)
    data, at = f.read(length), 0
    while at < len(data):
        fields = struct.unpack("<4sHHHHHHIIIHHHHHII", data[at : at + 46])
        if fields[0] != CENTRAL:
            raise ValueError("damaged central directory")
        crc, n, label, extra, note, offset = fields[7], fields[9], fields[10], fields[11], fields[12], fields[16]
        if low <= offset < high:
            yield data[at + 46 : at + 46 + label].decode(), offset, crc, n
        at += 46 + label + extra + note


def read_member(folder: fs.FileSystem, path: str, offset: int, crc: int, n: int, f=None):
    """One member by its offset; a failed read is tried again with the file opened anew. Returns (bytes, open file)."""
    for attempt in range(TRIES):
        try:
            if f is None:
                f = folder.open_input_file(path)
            f.seek(offset)
            head = struct.unpack("<4sHHHHHIIIHH", f.read(30))
            if head[0] != LOCAL:
                raise OSError(f"no member at {offset}")
            f.seek(offset + 30 + head[9] + head[10])
            data = f.read(n)
            if len(data) != n or zlib.crc32(data) != crc:
                raise OSError(f"member at {offset} is damaged")
            return data, f
        except (OSError, struct.error):
            f = None
            if attempt == TRIES - 1:
                raise
            time.sleep(PAUSE_S * 2**attempt)


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


# ---- the data source


@dataclass
class Archives(WriterCommitMessage):
    names: list[tuple[str, int, int]]  # file, its bytes, where its directory begins


@dataclass
class ByteRange(InputPartition):
    archive: str
    size: int
    low: int
    high: int


class MediaArchive(DataSource):
    """``media_archive``: rows (name, n_bytes, media) in a folder of ZIP archives."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MediaWriter(self.options)


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        folder, top = _folder(self.uri)
        folder.create_dir(top, recursive=True)
        done: list[tuple[str, int, int]] = []
        archive, name = None, ""

        def close() -> None:
            archive.close()
            done.append((name, archive.at, archive.start))

        for batch in batches:
            for label, n, media in zip(*(batch.column(c) for c in ("name", "n_bytes", "media"))):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    archive = ArchiveWriter(folder.open_output_stream(f"{top}/{name}"))
                archive.add(f"{label.as_py()}/{n.as_py()}.png", media.as_py())
                if archive.at >= ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Archives(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        folder, top = _folder(self.uri)
        folder.create_dir(top, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with folder.open_output_stream(f"{top}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Without a manifest nothing of the job is ever read."""


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        folder, top = _folder(self.uri)
        ranges = []
        for info in folder.get_file_info(fs.FileSelector(top)):
            if not info.base_name.startswith(MANIFEST):
                continue
            with folder.open_input_file(info.path) as f:
                for name, size, start in json.loads(f.read()):
                    cuts = [*range(0, start, self.range_bytes), start]
                    ranges += [ByteRange(name, size, a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        return ranges

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks so when there is no range
            return
        folder, top = _folder(self.uri)
        path = f"{top}/{part.archive}"
        f = folder.open_input_file(path)
        names, sizes, media, held = [], [], [], 0

        def pack() -> pa.RecordBatch:
            columns = [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["name", "n_bytes", "media"])

        for label, offset, crc, n in members_in(f, part.size, part.low, part.high):
            data, f = read_member(folder, path, offset, crc, n, f)
            name, _, rest = label.rpartition("/")
            names.append(name)
            sizes.append(int(rest.removesuffix(".png")))
            media.append(data)
            held += n
            if held >= BATCH_BYTES:
                yield pack()
                names, sizes, media, held = [], [], [], 0
        if names:
            yield pack()


# ---- operators


def _draw_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media, names, held = [], [], [], 0
        for doc, text in zip(batch.column("doc"), batch.column("text")):
            payload, n = payload_of(text.as_py())
            names.append(doc.as_py())
            sizes.append(n)
            media.append(to_png(payload))
            held += len(media[-1])
            if held >= BATCH_BYTES:
                yield _drawn(names, sizes, media)
                sizes, media, names, held = [], [], [], 0
        if names:
            yield _drawn(names, sizes, media)


def _drawn(names: list, sizes: list, media: list) -> pa.RecordBatch:
    columns = [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["name", "n_bytes", "media"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


def store(df: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of ``df`` as a picture into archives under ``uri``.

    The name of a picture is "=" and the id; a null id becomes the name ``null``.
    """
    register(df.sparkSession)
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))
    rows = df.select(name.alias("doc"), F.col(text_col).alias("text"))
    drawn = rows.mapInArrow(_draw_batches, "name string, n_bytes long, media binary")
    drawn.write.format("media_archive").mode("append").save(uri)


def load(spark: SparkSession, uri: str) -> DataFrame:
    """(name, n_bytes, media) of all archives under ``uri``."""
    register(spark)
    return spark.read.format("media_archive").load(uri)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("size", "sha", "crc", "media_size", "media_sha", "feature")}
        for media in batch.column("media"):
            data = media.as_py()
            payload = from_png(data)
            out["size"].append(len(payload))
            out["sha"].append(sha256(payload).hexdigest())
            out["crc"].append(zlib.crc32(payload[-16:]))
            out["media_size"].append(len(data))
            out["media_sha"].append(sha256(data).hexdigest())
            out["feature"].append(feature_of(payload))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("name"), batch.column("n_bytes"), *columns],
            ["name", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


FEATURES = (
    "name string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> DataFrame:
    """Store every text of ``df`` under ``uri`` (a fresh shared folder by default), read it back, describe it.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row per row
    of ``df``, repeated rows included. A null text counts as empty: its payload is one row of blanks. Further
    columns are ignored; a null id stays null.
    """
    spark = df.sparkSession
    uri = uri or work_path(spark, "media")
    store(df, uri, id_col, text_col)
    found = load(spark, uri).mapInArrow(_feature_batches, FEATURES)
    doc = F.when(F.col("name") != "null", F.substring("name", 2, 1 << 30).cast(dict(df.dtypes)[id_col]))
    return found.select(doc.alias(id_col), *[c.split()[0] for c in FEATURES.split(", ")[1:]])
