"""Exact deduplication by content-defined chunk recipes, in native expressions only.

A text is cut where its own content says so: after the first sentence end or line end
that lies MIN_CHUNK or more characters into the chunk, at MAX_CHUNK at the latest. Equal
texts therefore give equal chunk lists. Each chunk's identifier is its SHA-256; the
distinct chunks are moved once, to verify that no identifier stands for two contents.
From then on a document is its ordered list of identifiers (its recipe), and only recipes
are grouped and compared, however long the texts are.

Defined cases: a null text counts as empty; an empty text has the empty recipe, and all
empty texts are equal. A null id never wins over a number; a group with null ids only has
keep_id null. Of repeated rows (same id, same text) one is kept. An empty table gives an
empty result. Columns of the input other than the id and the text are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import written

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text; joined they give the text again."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:[.!?](?=\s)|\n)|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_sha256 and recipe, the ordered identifiers of its chunks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(text, 256).alias("text_sha256"),
        F.transform(chunks(text), lambda c: F.unhex(F.sha2(c, 256))).alias("recipe"),
    )


def verify_chunks(docs: DataFrame, text_col: str = "text") -> None:
    """Raise if an identifier stands for two different chunks anywhere in docs.

    Copies of a chunk meet within each task first, so that a chunk held by a third of all
    rows crosses the network once per task.
    """
    distinct = docs.select(F.explode(chunks(F.col(text_col))).alias("chunk")).distinct()
    clash = distinct.groupBy(F.sha2("chunk", 256).alias("id")).count().filter("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"chunk identifier {clash[0]['id']} stands for different contents")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of each group of equal texts the row with the largest id is kept.
    """
    verify_chunks(docs, text_col)
    lists = written(recipes(docs, id_col, text_col), "recipes")
    # written once, since both branches below join it
    groups = written(lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    joined = lists.join(groups, "recipe")
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # only repeated rows of the winning id need telling apart
    order = Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")
    first = joined.filter(top).withColumn("kept", F.row_number().over(order) == 1)
    rest = joined.filter(~top).withColumn("kept", F.lit(False))
    return first.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that decide() keeps, with their columns as they were."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    kept = decide(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__tw_id"), F.col("text_sha256").alias("__tw_sha"))
    left = docs.withColumn("__tw_key", digest)
    on = left[id_col].eqNullSafe(kept["__tw_id"]) & (left["__tw_key"] == kept["__tw_sha"])
    order = Window.partitionBy(F.col(id_col), "__tw_key").orderBy(F.lit(0))
    rows = left.join(kept, on, "left_semi").withColumn("__tw_rank", F.row_number().over(order))
    return rows.filter("__tw_rank = 1").drop("__tw_key", "__tw_rank")
