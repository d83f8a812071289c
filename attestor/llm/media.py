"""Operator 1: media columns. Payloads live in tar shards, addressed by the digest of their content; rows carry digest, shard, offset and length, and reads of a few header bytes fill the metadata columns.

A payload has one member in each task that meets it: addressing by content across tasks would send every payload through a shuffle.

The stored form is an 8-bit grayscale PNG of 64 samples a row: lossless, with a private chunk `seXt` behind the image header that holds the payload's
length before padding. A payload is packed once into a shard, under the name of its SHA-256. Each task writes its own shards, and a shard's name is the
digest of its bytes: a task that is run again writes the same file, so lost executors leave no half shards and no dangling rows. Rows of one task are in
the order of shard and offset, and the reading pass keeps that order, so neither pass shuffles and copies are read once for each run of them.

Cases: null text is an empty payload; an empty payload is 64 zero bytes; repeated rows point at the same member; payloads of any length are stored whole;
an empty table writes no shard; columns named like the new ones, in any case of letters, are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attestor.llm.common import fresh_path, written

WIDTH = 64
SHARD_BYTES = 128 << 20
#: Signature, IHDR chunk, seXt chunk.
HEADER_BYTES = 8 + 25 + 20
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"

LOCATED = [T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]
METADATA = [T.StructField("format", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("bit_depth", T.IntegerType()), T.StructField("n_bytes", T.LongType())]
CONTENT = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]


def padded(data: bytes) -> bytes:
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 in front of each row
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"seXt", struct.pack(">Q", n_bytes)) + chunk(b"IDAT", zlib.compress(filtered.data, level)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, bytes before padding) from the first HEADER_BYTES."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR" or head[37:41] != b"seXt":
        raise ValueError("no image of this store")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth, struct.unpack(">Q", head[41:49])[0]


def from_png(media: bytes) -> bytes:
    """The samples, row by row. Checks each chunk."""
    width, height, _, _ = png_header(media[:HEADER_BYTES])
    at, data = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unknown row filter")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes, n_bytes: int) -> str:
    """Mean and deviation of the samples, entropy in bits, share of bytes over 127, of the payload before padding."""
    x = np.frombuffer(payload, np.uint8)[:n_bytes]
    if not n_bytes:
        return "mean=0.000;std=0.000;entropy=0.000;high=0.0000"
    counts = np.bincount(x, minlength=256)
    values, p = np.arange(256), counts / n_bytes
    mean = float((p * values).sum())
    std = max(0.0, float((p * (values - mean) ** 2).sum())) ** 0.5
    p = p[p > 0]
    return f"mean={mean:.3f};std={std:.3f};entropy={abs(float((p * np.log2(p)).sum())):.3f};high={counts[128:].sum() / n_bytes:.4f}"


class ShardWriter:
    """A tar file in the making, under a name of its own until it is closed. Members are named by digest and written once."""

    def __init__(self, folder: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.base = folder.rstrip("/")
        self.temporary = f"{self.folder}/.{uuid.uuid4().hex}.tmp"
        self.out = self.files.open_output_stream(self.temporary)
        self.hash, self.size, self.members = hashlib.sha256(), 0, {}

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def add(self, digest: str, media: bytes) -> None:
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        self.put(info.tobuf(tarfile.USTAR_FORMAT if len(media) < 8 << 30 else tarfile.PAX_FORMAT))
        self.members[digest] = (self.size, len(media))
        self.put(media)
        self.put(b"\0" * (-len(media) % tarfile.BLOCKSIZE))

    def close(self) -> str:
        self.put(b"\0" * (2 * tarfile.BLOCKSIZE))
        self.out.close()
        name = f"{self.hash.hexdigest()[:32]}.tar"
        self.files.move(self.temporary, f"{self.folder}/{name}")
        return f"{self.base}/{name}"


def stored(rows: DataFrame, folder: str, payload: str = "text", keep: tuple[str, ...] = ("doc_id",), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packs the column `payload` (string or binary) into shards under folder, and returns the columns `keep` with digest, shard, offset and length. Runs once, when called; a row is known by its shard only after the shard is closed, and then written."""
    keep = tuple(c for c in keep if c.lower() not in {f.name for f in LOCATED})
    schema = T.StructType([*(rows.schema[c] for c in keep), *LOCATED])
    n = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: ShardWriter | None = None
        waiting: list[tuple[list, str]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal writer, waiting
            shard = writer.close()
            order = sorted(range(len(waiting)), key=lambda i: writer.members[waiting[i][1]])
            for start in range(0, len(order), 4096):
                part = [waiting[i] for i in order[start : start + 4096]]
                places = [writer.members[d] for _, d in part]
                columns = [pa.array([k[i] for k, _ in part], types[i]) for i in range(n)]
                columns += [pa.array([d for _, d in part], pa.string()), pa.array([shard] * len(part), pa.string()), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            writer, waiting = None, []

        for batch in batches:
            types = batch.schema.types
            keys = zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True) if n else ((),) * batch.num_rows
            for key, value in zip(keys, batch.column(n), strict=True):
                data = value.as_py() or b""
                data = data.encode() if isinstance(data, str) else data
                whole = padded(data)
                digest = hashlib.sha256(struct.pack(">Q", len(data)) + whole).hexdigest()
                writer = writer or ShardWriter(folder)
                if digest not in writer.members:
                    writer.add(digest, to_png(whole, len(data)))
                waiting.append((key, digest))
                if writer.size >= shard_bytes or len(waiting) >= 200_000:
                    yield from flush()
        if writer:
            yield from flush()

    return written(rows.select(*keep, payload).mapInArrow(work, schema), "media_rows")


class RangeReader:
    """Reads byte ranges of shards, with the last file kept open."""

    def __init__(self) -> None:
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            files, path = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, files.open_input_file(path)
        self.file.seek(offset)
        return self.file.read(length)


def with_metadata(rows: DataFrame) -> DataFrame:
    """rows (digest, shard, offset, length and more) with the metadata columns, from HEADER_BYTES of each member."""
    return _read(rows, METADATA, whole=False)


def with_content(rows: DataFrame) -> DataFrame:
    """rows with sizes, digests and the feature from the whole member, read back and checked."""
    return _read(rows, CONTENT, whole=True)


def payloads(rows: DataFrame) -> DataFrame:
    """rows with the payload (binary, unpadded)."""
    return _read(rows, [T.StructField("payload", T.BinaryType())], whole=True, only_payload=True)


def _read(rows: DataFrame, fields: list[T.StructField], whole: bool, only_payload: bool = False) -> DataFrame:
    new = {f.name for f in fields}
    kept = [c for c in rows.columns if c.lower() not in new]
    schema = T.StructType([*(rows.schema[c] for c in kept), *fields])

    def describe(media: bytes) -> tuple:
        width, height, depth, n_bytes = png_header(media[:HEADER_BYTES])
        if not whole:
            return "png", width, height, depth, n_bytes
        payload = from_png(media)
        if only_payload:
            return (payload[:n_bytes],)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload, n_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, found = RangeReader(), None, ()
        for big in batches:
            for start in range(0, big.num_rows, 512):
                batch = big.slice(start, 512)
                out = []
                for place in zip(*(batch.column(kept.index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                    if place != last:
                        shard, offset, length = last = place
                        found = describe(reader.read(shard, offset, length if whole else HEADER_BYTES))
                    out.append(found)
                target = pa.schema([pa.field(f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in fields])
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)] if out else [pa.array([], f.type) for f in target]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return rows.select(*kept).mapInArrow(work, schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = with_content(with_metadata(stored(docs, fresh_path(spark, "media"))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format", "width", "height", "digest")


