"""Media columns: payloads kept as images in archives, read back through a data source of our own.

`write_archives` stores every row's payload as an 8-bit greyscale PNG (64 samples a row, no interlace, no row filter)
and packs the images into ZIP archives of a bounded size, each written by one task under a name of its own. Which
archives count is known from the tasks' committed results, so a lost or repeated task leaves no double members: its
files are never listed in the folder's manifest.

`ArchiveSource` (format "image_archive") plans byte ranges over the archives of such a folder from names and sizes
alone. Each partition opens its archive once, reads the central directory, takes the members whose local header starts
in its range, and streams them in blocks of a bounded number of bytes (or one member), each read in one go and passed on
as an Arrow batch. A member that isn't whole is read again on its own from its offset through a newly opened file; what
was read before is not repeated.

Defined results: null and empty texts give 64 zero bytes with n_bytes 0; null ids stay null; repeated rows give
repeated members; a payload of any length is one member, whole; an empty table gives an empty folder and no rows; other
columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import delete, file_system, new_folder, small_batches, texts, tidy

WIDTH = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest.json"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 32 << 20, 16 << 20, 8 << 20, 4


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return data + bytes(WIDTH * max(1, -(-len(data) // WIDTH)) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(payload: bytes, level: int = 3) -> bytes:
    """The payload as an 8-bit greyscale image of 64 samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # the filter byte 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The payload of an image that png() made; ValueError if it isn't whole."""
    if image[:8] != PNG_MAGIC:
        raise ValueError("not a PNG image")
    at, size, data = 8, None, []
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if not size or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an image of this layout")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and mean step between neighbours of the samples, then a 64-bit hash of which column means exceed the mean."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    cols = x.sum(axis=0, dtype=np.int64)
    total, n = int(cols.sum()), x.size
    square = int(np.einsum("ij,ij->", x, x, dtype=np.int64)) if n < 1 << 24 else sum(int((y.astype(np.int64) ** 2).sum()) for y in np.array_split(x, -(-n // (1 << 22))))
    step = int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64))
    bits = int("".join("1" if int(c) * WIDTH > total else "0" for c in cols), 2)
    var = max(0, square * n - total * total)
    return f"{total / n:.4f}:{(var**0.5) / n:.4f}:{step / n:.4f}:{bits:016x}"


class _Packer:
    """Archives of one task: a new one begins once the last has ARCHIVE_BYTES."""

    def __init__(self, folder: str, limit: int):
        self.fs, self.root = file_system(folder)
        self.limit, self.done, self.n, self.zip = limit, [], 0, None

    def add(self, doc_id: int | None, n_bytes: int, image: bytes) -> None:
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.zip"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
            self.zip, self.size, self.n = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED), 0, 0
        info = zipfile.ZipInfo(f"{self.n:08d}/{'' if doc_id is None else doc_id}/{n_bytes}.png")
        self.zip.writestr(info, image)
        self.n, self.size = self.n + 1, self.size + len(image)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.zip.close()
            size = self.out.tell()
            self.out.close()
            self.done.append((self.name, size, self.n))
            self.zip = None


def write_archives(df: DataFrame, folder: str, text: str = "text", id_col: str = "doc_id", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Packs every row's text into archives under `folder`, then lists them in its manifest. No shuffle.

    What reaches the driver is a line for each archive of `archive_bytes`, as with any listing of files."""
    spark = small_batches(df.sparkSession)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        packer = _Packer(folder, archive_bytes)
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), texts(b), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                packer.add(i, len(data), png(padded(data)))
        packer.close()
        if packer.done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*packer.done, strict=True)], names=["name", "size", "members"])

    src = df.select(df[id_col].cast("long").alias("id"), df[text].cast("string").alias("text"))
    src.mapInArrow(tidy(run), "name string, size long, members long").write.parquet(f"{folder}/_packed")  # commits one attempt of each task
    listed = spark.read.schema("name string, size long, members long").parquet(f"{folder}/_packed").orderBy("name").collect()
    delete(spark, f"{folder}/_packed")
    with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps([[r.name, r.size] for r in listed]).encode())


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        super().__init__(None)
        self.path, self.size, self.start, self.end = path, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range_bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes, self.attempts = int(options.get("batch_bytes", BATCH_BYTES)), int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[ByteRange]:
        fs, root = file_system(self.folder)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            listed = json.loads(f.read())
        return [ByteRange(f"{self.folder}/{name}", size, at, min(size, at + self.range_bytes)) for name, size in listed for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0, 0)]

    def opened(self, path: str):
        fs, at = file_system(path)
        return fs.open_input_file(at)

    def directory(self, path: str):
        """The archive, opened, and its members' infos; a failure opens it anew."""
        for attempt in range(self.attempts):
            try:
                f = self.opened(path)
                try:
                    return f, zipfile.ZipFile(f).infolist()
                except BaseException:
                    f.close()
                    raise
            except (OSError, zipfile.BadZipFile):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    @staticmethod
    def payload(info: zipfile.ZipInfo, raw: bytes) -> bytes:
        """The stored bytes of a member, whose local header begins raw; OSError if they aren't whole."""
        if raw[:4] != b"PK\x03\x04" or len(raw) < 30:
            raise OSError("no local header at the member's offset")
        name, extra = struct.unpack_from("<HH", raw, 26)
        data = raw[30 + name + extra : 30 + name + extra + info.compress_size]
        if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
            raise OSError(f"member {info.filename} is damaged or cut short")
        return data

    def again(self, path: str, info: zipfile.ZipInfo, size: int) -> bytes:
        """One member on its own, by its offset, from a newly opened file at each attempt; `size` reaches up to the next member."""
        for attempt in range(1, self.attempts):
            time.sleep(0.05 * 2 ** (attempt - 1))
            try:
                with self.opened(path) as f:
                    f.seek(info.header_offset)
                    return self.payload(info, f.read(size))
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
        raise OSError(f"member {info.filename} can't be read")

    def blocks(self, infos: list[zipfile.ZipInfo], part: ByteRange) -> Iterator[list[tuple[zipfile.ZipInfo, int]]]:
        """The range's members with their sizes up to the next member, in blocks of about `batch_bytes` that are read in one go."""
        infos = sorted(infos, key=lambda i: i.header_offset)
        ends = [i.header_offset for i in infos[1:]] + [part.size]  # the last one's reach holds the central directory too
        block, held = [], 0
        for info, end in zip(infos, ends, strict=True):
            if part.start <= info.header_offset < part.end:
                size = min(end - info.header_offset, 30 + 2 * 65535 + info.compress_size)
                block.append((info, size))
                held += size
                if held >= self.batch_bytes:
                    yield block
                    block, held = [], 0
        if block:
            yield block

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        """A file is opened once a range and read block by block; only members that aren't whole are read again, each on its own."""
        if not part.path:
            return
        f, infos = self.directory(part.path)
        try:
            for block in self.blocks(infos, part):
                first, (last, size) = block[0][0].header_offset, block[-1]
                try:
                    f.seek(first)
                    raw = f.read(last.header_offset + size - first)
                except OSError:
                    raw = b""
                ids, sizes, images = [], [], []
                for info, size in block:
                    _, doc, n = re.fullmatch(r"(\d+)/(-?\d*)/(\d+)\.png", info.filename).groups()
                    at = info.header_offset - first
                    try:
                        data = self.payload(info, raw[at : at + size])
                    except OSError:
                        data = self.again(part.path, info, size)
                    ids.append(int(doc) if doc else None), sizes.append(int(n)), images.append(data)
                yield self.batch(ids, sizes, images)
        finally:
            f.close()

    @staticmethod
    def batch(ids, sizes, images) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("image_archive").load(folder): doc_id, n_bytes, media (the PNG image)."""

    @classmethod
    def name(cls) -> str:
        return "image_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("image_archive").options(**{k: str(v) for k, v in options.items()}).load(folder)


def with_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored images, computed from the samples that are read back."""

    def run(batches):
        for b in batches:
            images = b.column("media").to_pylist()
            loads = [samples(x) for x in images]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("n_bytes"), pa.array([len(p) for p in loads], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in loads]), pa.array([zlib.crc32(p[-WIDTH:]) for p in loads], pa.int64()),
                    pa.array([len(x) for x in images], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in images]),
                    pa.array([feature(p) for p in loads]),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_table(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    folder = new_folder(df.sparkSession, "media")
    write_archives(df, folder, text, id_col)
    return with_features(read_archives(df.sparkSession, folder))
