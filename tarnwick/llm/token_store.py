"""Token-ID files: Simple-8b words in blocks of whole documents, in ascending id order.

A 64-bit word holds a 4-bit selector and as many ids as fit at equal width into the other
60 bits, 1 to 60 of them. An id of 2**60 or more is an escape: a zero takes its place and
the block lists its position and value. The file is Parquet: a row is a block, with its
shard, its number, the ids before it in its shard (its offset), its words, and the
documents that lie in it with their counts. Every block decodes by itself and with array
operations only, so files split at any block, and Spark's commit protocol keeps a lost
executor's half-written file out.

Writing sorts the texts by id into ranges before encoding, since they are smaller than
their ids. The counts of whole shards, one number each, give every shard its start.

Defined cases: a null or empty text has just the end id; null ids come first; rows of the
same id lie in the order of their texts' hashes; an empty table gives no rows; other columns stay
out of the file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe

#: Ids per word, by selector.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1 << 60
#: A block is closed when it holds as many ids.
BLOCK_IDS = 1 << 16

STORE = "shard int, block int, block_start bigint, n_ids bigint, doc_ids array<{id}>, doc_counts array<bigint>, words binary, escape_at array<bigint>, escape_value array<decimal(20,0)>"


def _bits(ids: np.ndarray) -> np.ndarray:
    """The bit lengths of ids (uint64), as bytes."""
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)  # exact below 2**53
    high = (ids >> np.uint64(32)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, low).astype(np.uint8) if high.any() else low


def pack(ids: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """Words of ids (unsigned), and the escapes' positions and values."""
    ids = ids.astype(np.uint64)
    at = np.flatnonzero(ids >= ESCAPE)
    escapes = ids[at].tolist()
    n, longest = len(ids), int(COUNTS[-1])
    ids = np.concatenate([ids, np.zeros(longest, np.uint64)])
    ids[at] = 0
    bits = _bits(ids)
    choice, widest, span = np.zeros(n, np.uint8), bits[:n], 1
    for selector, count in enumerate(COUNTS.tolist()):
        for step in range(span, count):
            widest = np.maximum(widest, bits[step : step + n])
        span = count
        choice[widest <= 60 // count] = selector
    starts, i, jump = [], 0, COUNTS[choice].tolist()
    while i < n:
        starts.append(i)
        i += jump[i]
    starts = np.array(starts, np.int64)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, count in enumerate(COUNTS.tolist()):
        own = np.flatnonzero(chosen == selector)
        for k in range(count) if len(own) else ():
            words[own] |= ids[starts[own] + k] << np.uint64(k * (60 // count))
    return words.astype("<u8").tobytes(), at.tolist(), escapes


def unpack(words: bytes, n: int, escape_at=(), escape_value=()) -> np.ndarray:
    """The n ids of pack(), as uint64."""
    words = np.frombuffer(words, "<u8")
    selectors = (words >> np.uint64(60)).astype(np.int64)
    stops = COUNTS[selectors].cumsum()
    out = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint64)
    for selector, count in enumerate(COUNTS.tolist()):
        own = np.flatnonzero(selectors == selector)
        if len(own):
            width = 60 // count
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            values = (words[own, None] >> shifts) & np.uint64((1 << width) - 1)
            out[(stops[own] - count)[:, None] + np.arange(count)] = values
    out = out[:n]
    if len(escape_at):
        out[np.asarray(escape_at)] = np.array([int(v) for v in escape_value], np.uint64)
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs, end each document with end_id, and write the blocks under path."""
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        c, shard, block, before = bpe.codec(tokenizer), TaskContext.get().partitionId(), 0, 0
        own_ids, counts, held, size = [], [], [], 0
        for batch in batches:
            schema = batch.schema.field("doc_id").type
            for part, texts in bpe.pieces(batch, "text"):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), c.encode_all(texts)):
                    own_ids.append(doc_id)
                    counts.append(len(ids) // 4 + 1)
                    held += [ids, end]
                    size += counts[-1]
                    if size >= BLOCK_IDS:
                        yield closed(shard, block, before, own_ids, counts, held, schema)
                        block, before = block + 1, before + size
                        own_ids, counts, held, size = [], [], [], 0
        if own_ids:
            yield closed(shard, block, before, own_ids, counts, held, schema)

    # ranges are found from a sample of ids and hashes, so that no text goes to the driver
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, STORE.format(id=kind)).write.option("compression", "zstd").parquet(path)


def closed(shard: int, block: int, before: int, doc_ids: list, counts: list[int], held: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
    words, at, values = pack(np.frombuffer(b"".join(held), "<u4"))
    columns = {
        "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "block_start": pa.array([before], pa.int64()), "n_ids": pa.array([sum(counts)], pa.int64()),
        "doc_ids": pa.array([doc_ids], pa.list_(kind)), "doc_counts": pa.array([counts], pa.list_(pa.int64())), "words": pa.array([words], pa.binary()),
        "escape_at": pa.array([at], pa.list_(pa.int64())), "escape_value": pa.array([values], pa.list_(pa.decimal128(20, 0))),
    }
    return pa.RecordBatch.from_pydict(columns)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary, little-endian uint32) of each document."""
    return _documents(spark, path, lambda ids: ids, "ids", "binary", pa.binary())


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the stored words."""
    return _documents(spark, path, zlib.crc32, "ids_crc32", "bigint", pa.int64())


def _documents(spark: SparkSession, path: str, of, name: str, sql_type: str, arrow_type: pa.DataType) -> DataFrame:
    store = spark.read.parquet(path)
    shards = sorted((r["shard"], r["n"]) for r in store.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts = dict(zip((s for s, _ in shards), np.cumsum([0, *(n for _, n in shards)]).tolist()))
    kind = store.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["words"], row["n_ids"], row["escape_at"], row["escape_value"]).astype("<u4")
                counts = np.array(row["doc_counts"])
                stops = counts.cumsum()
                first = starts[row["shard"]] + row["block_start"] + stops - counts
                made = [of(ids[b - n : b].tobytes()) for b, n in zip(stops.tolist(), counts.tolist())]
                id_type = batch.schema.field("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], id_type), pa.array(first, pa.int64()), pa.array(counts, pa.int64()), pa.array(made, arrow_type)], ["doc_id", "start", "n_tokens", name])

    return store.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, {name} {sql_type}")
