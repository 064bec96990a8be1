"""Structured Streaming forms of the polling, sweeping and folding operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import precedents
from ..runtime import exists, written


def landing(spark: SparkSession, folder: str, schema: str, data_format: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(data_format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def after_watermark(stream: DataFrame, since: str, column: str = "created_at") -> DataFrame:
    """Rows strictly after a stored watermark; an equal instant is never emitted."""
    return stream.filter(F.col(column) > F.lit(since).cast("timestamp"))


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def outbox(stream: DataFrame, sink: str, checkpoint: str, project: Callable[[DataFrame], DataFrame] | None = None, order: str = "created_at", most: int = 10_000) -> StreamingQuery:
    """Deliver published rows at least once to a keyed Parquet sink; a batch that runs again writes the same folder.

    Other rows are consumed without being projected. A micro-batch is delivered in files of
    at most ``most`` rows, in the order of the column ``order``, nulls first. Its own size
    is bounded by the source (files_per_trigger of landing()). Readers take the sink
    through delivered(), which keeps one row per key.
    """
    def batch(rows: DataFrame, number: int) -> None:
        kept = rows.filter("detail_type = 'published'").orderBy(order)
        kept = project(kept) if project else kept
        kept.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep(rows: DataFrame, sink: str, ledger: str, project: Callable[[str], str], key: str = "event_id", order: str = "created_at", most: int = 10_000) -> DataFrame:
    """Deliver published outbox rows that the ledger lacks, the first most of them in order, and acknowledge each; returns key and error of those that failed.

    project makes a row's body from its payload. A row for which it raises stays in the
    outbox and is tried again by later sweeps; the others are written to the sink, and
    only then their keys to the ledger. A crash between the two delivers them again in a
    folder of their own, and delivered() shows each key once.
    """
    spark = rows.sparkSession

    @F.pandas_udf("body string, error string")
    def guarded(payloads: pd.Series) -> pd.DataFrame:
        made = []
        for payload in payloads:
            try:
                made.append((project(payload), None))
            except Exception as error:  # one row must not keep the others back
                made.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(made, columns=["body", "error"])

    pending = rows.filter("detail_type = 'published'")
    if exists(spark, ledger):
        pending = pending.join(spark.read.parquet(ledger), key, "left_anti")
    batch = pending.orderBy(order, key).limit(most)
    tried = written(batch.withColumn("made", guarded("payload")).select(key, order, "made.body", "made.error"), "sweep")
    good = tried.filter("error IS NULL")
    good.select(key, "body").write.parquet(f"{sink}/sweep={uuid.uuid4().hex}")
    good.select(key).write.mode("append").parquet(ledger)
    return tried.filter("error IS NOT NULL").select(key, "error")


def delivered(spark: SparkSession, sink: str, key: str = "event_id") -> DataFrame:
    return spark.read.parquet(sink).dropDuplicates([key])


def journal(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append decisions to the journal table; state() folds it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Current positives and negatives of a journal table."""
    events = precedents.replay(spark.read.parquet(path))
    return precedents.current_positive(events), precedents.current_negatives(events)
