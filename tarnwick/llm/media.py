"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, filled up with spaces to whole rows of ROW samples, are stored as an
8-bit greyscale PNG, so any image reader gets the payload back without loss. Each task
appends its images to tar shards in the shared folder; a member's name is the SHA-256 of
its payload, and equal payloads in a shard are stored once. Texts never cross the network:
only digests are grouped, and where a payload lies in several shards the first place
counts. Rows carry digest, shard, offset and length; the metadata columns come from a
range read of the image's first bytes alone.

A shard gets a new name with each attempt of a task. Its rows name the file they were
written with and are written by Spark's commit protocol, so rows of a lost attempt and its
file are never referred to.

Defined cases: a null or empty text is one row of spaces with n_bytes 0. Texts that differ
in trailing spaces alone may share a payload but keep their own n_bytes. Repeated rows and
null ids give rows of their own. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch_path, written
from .bpe import pieces

ROW = 192
SHARD_BYTES = 256 << 20
#: Signature and header chunk of a PNG.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image of ROW samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)  # each row starts with filter type 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image of to_png()."""
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        packed += [body] if kind == b"IDAT" else []
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % ROW if data else ROW)


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and the share of each sixteenth of their range."""
    samples = np.frombuffer(payload, np.uint8)
    shares = np.bincount(samples >> 4, minlength=16) * 1000 // len(samples)
    return f"mean={samples.mean():.4f};std={samples.std():.4f};hist=" + ",".join(map(str, shares.tolist()))


class _Shards:
    """Writes tar members one after another, a new file after SHARD_BYTES."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.out = folder, None

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.at, self.own = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
        if name not in self.own:
            info = tarfile.TarInfo(f"{name}.png")
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.GNU_FORMAT) + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE))
            self.own[name] = (self.name, self.at + tarfile.BLOCKSIZE, len(data))
            self.at += tarfile.BLOCKSIZE + len(data) + -len(data) % tarfile.BLOCKSIZE
        found = self.own[name]
        if self.at >= SHARD_BYTES:
            self.close()
        return found

    def place(self, name: str) -> tuple[str, int, int] | None:
        return self.own.get(name) if self.out is not None else None

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads below folder; per row: doc_id, n_bytes, digest, shard, offset, length."""
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    jvm = docs.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)

    def run(batches):
        shards = _Shards(folder)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                found = []
                for text in texts:
                    n, payload = payload_of(text)
                    digest = hashlib.sha256(payload)
                    name = digest.hexdigest()
                    place = shards.place(name) or shards.add(name, to_png(payload))
                    found.append((n, digest.digest(), *place))
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    made = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, digest binary, shard string, offset bigint, length bigint")
    return written(made, "media_rows")


def places(index: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place for each payload, in the order of the shards."""
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("digest", "at.*").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(folder: str, size_of, made, names: list[str], kinds: list[pa.DataType]):
    """A mapInArrow function that reads size_of(length) bytes of each place and yields digest and made(bytes)."""
    def run(batches):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["shard"], system.open_input_file(f"{path}/{row['shard']}")
                file.seek(row["offset"])
                found.append(made(row["digest"], file.read(size_of(row["length"]))))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds))], ["digest", *names])
        if file is not None:
            file.close()

    return run


def headers(index: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits of each payload, reading HEADER_BYTES bytes of each image."""
    run = _ranges(folder, lambda n: HEADER_BYTES, lambda _, data: png_header(data), ["width", "height", "bits"], [pa.int64()] * 3)
    return places(index).mapInArrow(run, "digest binary, width bigint, height bigint, bits bigint")


def contents(index: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes of each payload give: its size and checksums, the image's, and the feature."""
    def made(digest: bytes, data: bytes) -> tuple:
        payload = from_png(data)
        own = hashlib.sha256(payload)
        if own.digest() != digest:
            raise ValueError(f"payload {digest.hex()} was not read back")
        return len(payload), own.hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    run = _ranges(folder, lambda n: n, made, names, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])
    return places(index).mapInArrow(run, "digest binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the payloads and give each row its place, header columns and content columns."""
    folder = scratch_path(docs.sparkSession, "media")
    index = store(docs, folder, id_col, text_col)
    return index.join(headers(index, folder), "digest").join(contents(index, folder), "digest")
