"""Line deduplication: ranges of sorted line hashes, streamed, give a keep bitmap for each document.

Every line long enough to count is a row of its key's 128-bit hash, its document and its
position; texts are not moved. The rows are written, dealt out by ranges of (hash,
document) and sorted within each range by hash, then by document from the largest down,
then by position, so the first document of a run of equal hashes is the one that keeps its
lines. One pass streams over each range in blocks of about BLOCK rows and decides on every
run inside a block. Blocks and ranges end between documents, never within one, so a line
that a third of all documents hold is spread over many tasks. The runs at the two ends of a
block stay open; two summary rows for each block (the run's documents in it, and the
largest) are summed over all blocks and decide on them. What is dropped of a document comes
back as a bitmap compressed by runs, never as text.

Defined cases: a null or empty text is one empty line. A document is a doc_id: rows with
the same doc_id count once and keep their lines alike, and the null doc_id is a document
below all others. A line that a document repeats stays or goes as a whole. Where no line
repeats, as in an empty table, every line stays. Texts and lines may be of any length; a
document's positions are held together, as its text is. Ids are whole numbers. Other
columns, whatever their names, come through deduplicate() as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written

LENGTH, LEAST = 40, 5
BLOCK = 1 << 19
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of rows that the stream gives: lines to drop, lines of an open run, the summary of an open run (pos: its documents).
DROP, OPEN, SUMMARY = 0, 1, 2


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart that have different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """h1, h2, doc, row and pos (from 0) of every line whose key has at least length code points."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), row_key(F.col(text_col)).alias("row"), F.posexplode(lines(F.col(text_col))).alias("pos", "line"))
    keyed = rows.filter(F.length("line") >= length).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= length)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "row", F.col("pos").cast("bigint").alias("pos"))


def _blocks(batches) -> Iterator[dict[str, np.ndarray]]:
    """Columns of about BLOCK rows at a time, cut where a run's document changes; none: whether doc is null."""
    held: list[dict] = []

    def joined() -> dict:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        doc = batch.column("doc")
        held.append({c: batch.column(c).to_numpy() for c in ("h1", "h2", "row", "pos")} | {"doc": doc.fill_null(0).to_numpy(), "none": doc.is_null().to_numpy(zero_copy_only=False)})
        if sum(len(h["h1"]) for h in held) >= BLOCK:
            part = joined()
            cut = _changes(part, "h1", "h2", "doc", "none")[-1]
            if cut:
                yield {c: x[:cut] for c, x in part.items()}
            held = [{c: x[cut:] for c, x in part.items()}]
    if held and len((part := joined())["h1"]):
        yield part


def _changes(part: dict[str, np.ndarray], *names: str) -> np.ndarray:
    """Where one of the columns differs from the row before; the first row counts."""
    differs = np.zeros(len(part["h1"]), bool)
    differs[:1] = True
    for c in names:
        differs[1:] |= part[c][1:] != part[c][:-1]
    return np.flatnonzero(differs)


def _decided(part: dict[str, np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
    starts, groups = _changes(part, "h1", "h2"), _changes(part, "h1", "h2", "doc", "none")
    sizes = np.diff(np.r_[starts, len(part["h1"])])
    docs = np.diff(np.r_[np.searchsorted(groups, starts), len(groups)])
    inside = np.ones(len(starts), bool)
    inside[[0, -1]] = False
    lead = np.repeat(starts, sizes)  # the run's first row, which has its largest document
    wins = (part["doc"] == part["doc"][lead]) & (part["none"] == part["none"][lead])
    yield _rows(DROP, part, np.repeat(inside & (docs >= least), sizes) & ~wins)
    yield _rows(OPEN, part, np.repeat(~inside, sizes))
    ends = np.unique([0, len(starts) - 1])
    yield _rows(SUMMARY, {c: x[starts[ends]] for c, x in part.items()} | {"pos": docs[ends].astype(np.int64)}, np.ones(len(ends), bool))


def _rows(kind: int, part: dict[str, np.ndarray], chosen: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array(np.full(int(chosen.sum()), kind, np.int32)), *(pa.array(part[c][chosen]) for c in ("h1", "h2")), pa.array(part["doc"][chosen], mask=part["none"][chosen]), *(pa.array(part[c][chosen]) for c in ("row", "pos"))]
    return pa.RecordBatch.from_arrays(cells, ["kind", "h1", "h2", "doc", "row", "pos"])


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """doc, row and pos of every line that goes."""
    def run(batches):
        for part in _blocks(batches):
            yield from _decided(part, least)

    hashes = written(line_hashes(docs, id_col, text_col, length), "line-hashes")
    order = [F.asc("h1"), F.asc("h2"), F.desc_nulls_last("doc")]
    ranges = hashes.repartitionByRange(*order).sortWithinPartitions(*order, "row", "pos")
    found = written(ranges.mapInArrow(run, "kind int, h1 bigint, h2 bigint, doc bigint, row bigint, pos bigint"), "line-runs")
    known = found.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("pos").alias("docs"), F.max("doc").alias("top")).filter(F.col("docs") >= least)
    late = found.filter(F.col("kind") == OPEN).join(known.drop("docs"), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("top")))
    return found.filter(F.col("kind") == DROP).select("doc", "row", "pos").unionByName(late.select("doc", "row", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """doc, row and bitmap of each document that loses a line.

    The bitmap is compressed by runs: an array of (start, length), in order, of the lines
    that go; all others stay.
    """
    at = dropped(docs, id_col, text_col, length, least).groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    first = F.filter("p", lambda x, i: (i == 0) | (F.col("p")[F.greatest(i - 1, F.lit(0))] != x - 1))
    last = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.col("p")[F.least(i + 1, F.size("p") - 1)] != x + 1))
    run = F.zip_with("first", "last", lambda a, b: F.struct(a.cast("int").alias("start"), (b - a + 1).cast("int").alias("length")))
    return at.select("doc", "row", first.alias("first"), last.alias("last")).select("doc", "row", run.alias("bitmap"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines of a text that its bitmap keeps, joined by line ends."""
    begin = F.concat(F.array(F.lit(0)), F.transform(bitmap, lambda r: r["start"] + r["length"]))
    end = F.concat(F.transform(bitmap, lambda r: r["start"]), F.array(F.size(lines(text))))
    parts = F.zip_with(begin, end, lambda a, b: F.slice(lines(text), a + 1, b - a))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(parts), "\n"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """The rows of docs with __tw_bitmap (null: all lines stay) beside their columns."""
    maps = keep_bitmaps(docs, id_col, text_col, length, least).select(F.col("doc").alias("__tw_doc"), F.col("row").alias("__tw_row"), F.col("bitmap").alias("__tw_bitmap"))
    on = F.col(id_col).cast("bigint").eqNullSafe(F.col("__tw_doc")) & (row_key(F.col(text_col)) == F.col("__tw_row"))
    return docs.join(maps, on, "left").drop("__tw_doc", "__tw_row")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept_sha256 of each row."""
    rows = decide(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    gone = F.aggregate(F.coalesce("__tw_bitmap", F.array().cast("array<struct<start:int,length:int>>")), F.lit(0).cast("bigint"), lambda n, r: n + r["length"])
    return rows.select("doc_id", F.size(lines(F.col("text"))).cast("bigint").alias("n_lines"), gone.alias("n_dropped"), F.sha2(kept_text(F.col("text"), F.col("__tw_bitmap")), 256).alias("kept_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """docs with the lines that go taken out of their texts; a text that loses nothing stays as it is, null too."""
    rows = decide(docs, id_col, text_col, length, least)
    text = F.when(F.col("__tw_bitmap").isNull(), F.col(text_col)).otherwise(kept_text(F.col(text_col), F.col("__tw_bitmap")))
    return rows.withColumn(text_col, text).select(docs.columns)
