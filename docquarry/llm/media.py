"""Media columns: payloads as lossless images in archives, read back by a custom data source (op 6).

Method. Each document's payload becomes a PNG image (8-bit grey, 64 samples a row, the unpadded size in a
text chunk) and a stored member of a zip archive in the shared folder; every task writes archives of about
``ARCHIVE_BYTES``. The custom Spark data source plans partitions as byte ranges of the archives. Ranges are made
and dealt into groups by a Spark job and written as a list; the driver knows the number of groups only (one range
each, or several where there would be more than ``MOST_GROUPS``), a task reads its group's rows of the list, the
directory at each archive's end, and takes the members whose header begins in a range. Members are read one by one at their offset, checked against the directory's
checksum and read again on their own when that fails (``RETRIES``), and leave in Arrow batches of about
``BATCH_BYTES``.

Archives are written under a name of the attempt and renamed at the end, so a repeated task leaves whole
archives only; the rows that Spark keeps name the archives that count.

Cases: null text counts as empty and gives 64 zero bytes; a text of any length is one member; equal texts
give equal values, as nothing but the payload and its size goes into an image; an empty table gives no
archive; further columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docquarry.llm.common import scratch, stored, table, tidy

ROW = 64
ARCHIVE_BYTES = 32 << 20
SPLIT_BYTES = 8 << 20
MOST_GROUPS = 100_000
GROUPS_A_FOLDER = 256
BATCH_BYTES = 4 << 20
RETRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LOCAL_HEADER = 30


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, zeros appended up to a positive multiple of 64; and the size before."""
    raw = (text or "").encode()
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes, size: int) -> bytes:
    """A grey image of 64 samples a row, no row filter; the payload's own size as a text chunk."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"bytes\0%d" % size) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """Payload and unpadded size of an image from ``to_png``; raises ValueError on damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, size, rows, packed = 8, 0, 0, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk's checksum does not match")
        if kind == b"IHDR":
            rows = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"tEXt":
            size = int(body.split(b"\0")[1])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(rows, ROW + 1)
    return lines[:, 1:].tobytes(), size


def feature(payload: bytes) -> str:
    """Rows, mean sample, spread and an eight-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = int(counts @ values) / len(x)
    spread = max(0.0, int(counts @ (values * values)) / len(x) - mean * mean) ** 0.5
    return f"{len(x) // ROW}x{ROW};mean={mean:.4f};sd={spread:.4f};hist=" + ",".join(map(str, counts.reshape(8, 32).sum(1)))


def opened(path: str):
    """File system and path for a local path or any URI that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Writes one image per document; returns the archives' paths, sizes and member counts (computed once)."""
    import pyarrow as pa

    def run(batches):
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        state = {"n": 0}
        tag = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"

        def begin():
            state["name"] = f"{tag}-{state['n']:04d}.zip"
            state["out"] = files.open_output_stream(f"{base}/_{state['name']}")
            state["zip"] = zipfile.ZipFile(Plain(state["out"]), "w", zipfile.ZIP_STORED)
            state["size"] = state["members"] = 0

        def end():
            state["zip"].close()
            state["out"].close()
            files.move(f"{base}/_{state['name']}", f"{base}/{state['name']}")
            size = files.get_file_info(f"{base}/{state['name']}").size
            state["n"] += 1
            state["zip"] = None
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{state['name']}"]), pa.array([size], pa.int64()), pa.array([state["members"]], pa.int64())], names=["path", "bytes", "members"])

        state["zip"] = None
        for batch in batches:
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if state["zip"] is None:
                    begin()
                image = to_png(*payload_of(text.as_py()))
                state["zip"].writestr(zipfile.ZipInfo("null" if d is None else str(d)), image)
                state["size"] += len(image)
                state["members"] += 1
                if state["size"] >= ARCHIVE_BYTES:
                    yield end()
        if state["zip"] is not None:
            yield end()

    return stored(docs.select("doc_id", "text").mapInArrow(tidy(run), "path string, bytes long, members long"), "archives")


class Plain(io.RawIOBase):
    """A write-only stream for zipfile: no seeking, so sizes come after the data."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def tell(self) -> int:
        return self.at


class Group(InputPartition):
    """A group of ranges, by its number in the list, or ranges (path, first, last) themselves."""

    def __init__(self, number: int, ranges: tuple = ()):
        super().__init__((number, ranges))
        self.number, self.ranges = number, ranges


def cut(size: int, split: int) -> list[tuple[int, int]]:
    return [(a, min(size, a + split)) for a in range(0, size, split)]


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.list, self.groups = options.get("list"), int(options.get("groups", 0))
        self.split = int(options.get("split", SPLIT_BYTES))

    def partitions(self):
        """Numbers of groups; for paths that were given one by one their ranges. An archive's members stay with its tasks."""
        found = [Group(k) for k in range(self.groups)] if self.list else []
        for p in self.paths:
            files, path = opened(p)
            found += [Group(-1, ((p, a, b),)) for a, b in cut(files.get_file_info(path).size, self.split)]
        return found or [Group(-1)]

    def ranges(self, group: Group) -> list[tuple]:
        if group.number < 0:
            return list(group.ranges)
        import pyarrow.dataset as ds

        files, base = opened(f"{self.list}/folder={group.number // GROUPS_A_FOLDER}")
        rows = ds.dataset(base, filesystem=files, format="parquet", exclude_invalid_files=False).to_table(columns=["path", "first", "last"], filter=ds.field("group") == group.number)
        return sorted(zip(*(rows[c].to_pylist() for c in ("path", "first", "last")), strict=True))

    def read(self, partition):
        import pyarrow as pa

        for archive, first, last in self.ranges(partition):
            files, path = opened(archive)
            names, images, held = [], [], 0

            def batch(names, images):
                return pa.RecordBatch.from_arrays([pa.array([None if n == "null" else int(n) for n in names], pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "media"])

            with files.open_input_file(path) as f:
                with zipfile.ZipFile(f) as z:
                    members = [(m.header_offset, m.filename, m.compress_size, m.CRC) for m in z.infolist() if first <= m.header_offset < last]
                for offset, name, size, crc in sorted(members):
                    images.append(member(files, path, f, offset, size, crc))
                    names.append(name)
                    held += size
                    if held >= BATCH_BYTES:
                        yield batch(names, images)
                        names, images, held = [], [], 0
            if names:
                yield batch(names, images)


def member(files, path: str, f, offset: int, size: int, crc: int) -> bytes:
    """One member by its offset, read again on its own (from a new handle) if that fails."""
    for attempt in range(RETRIES + 1):
        try:
            if attempt:
                f = files.open_input_file(path)
            f.seek(offset)
            head = f.read(LOCAL_HEADER)
            f.seek(offset + LOCAL_HEADER + sum(struct.unpack_from("<HH", head, 26)))
            data = f.read(size)
            if head[:4] == b"PK\x03\x04" and len(data) == size and zlib.crc32(data) == crc:
                return data
        except (OSError, struct.error):
            if attempt == RETRIES:
                raise
        finally:
            if attempt:
                f.close()
    raise OSError(f"{path}: the member at {offset} is damaged")


class ArchiveSource(DataSource):
    """``spark.read.format("archive_members")``: doc_id and the stored image of every member.

    Options: ``list`` (a folder as ``plan`` writes it) and ``groups`` (their number), or ``paths`` (one a line) and
    ``split`` (bytes in a partition).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def plan(archives: DataFrame, split: int = SPLIT_BYTES, most: int = MOST_GROUPS) -> tuple[str, int]:
    """Writes the ranges of all archives with their groups; returns the list's folder and the number of groups."""
    spark = archives.sparkSession
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("first")).select("path", "first", F.least("bytes", F.col("first") + split).alias("last"))
    n = ranges.count()
    if n <= most:  # so few rows that one task may number them
        numbered = ranges.withColumn("group", F.row_number().over(Window.orderBy("path", "first")) - 1)
    else:
        numbered = ranges.withColumn("group", F.pmod(F.xxhash64("path", "first"), F.lit(most)))
    folder = scratch(spark, "ranges")
    numbered.withColumns({"group": F.col("group").cast("long"), "folder": F.floor(F.col("group") / GROUPS_A_FOLDER).cast("long")}).repartition("folder").sortWithinPartitions("folder", "group").write.partitionBy("folder").parquet(folder)
    return folder, min(n, most)


def read_archives(spark: SparkSession, archives: DataFrame, split: int = SPLIT_BYTES, most: int = MOST_GROUPS) -> DataFrame:
    """doc_id and media of all members of the archives that ``write_archives`` returned."""
    spark.dataSource.register(ArchiveSource)
    folder, groups = plan(archives, split, most)
    if not groups:
        return spark.createDataFrame([], "doc_id long, media binary")
    return spark.read.format("archive_members").option("list", folder).option("groups", str(groups)).load()


def describe(members: DataFrame) -> DataFrame:
    """Per member: sizes, digests and the feature of the payload that was read back."""
    import pyarrow as pa

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for image in batch.column("media"):
                image = image.as_py()
                payload, size = from_png(image)
                rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return members.mapInArrow(tidy(run), schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: sizes, digests and feature of its payload, read back from the archives."""
    archives = write_archives(table(spark, sf_dir, "documents"), scratch(spark, "media"))
    return describe(read_archives(spark, archives))
