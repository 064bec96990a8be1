"""Landing files as Spark jobs: counts of every stage while rows stream, and sweeps with a ledger of loaded files."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..runtime import exists, written

STAGES = ("received", "decode", "parse", "validate", "sink")
LEDGER = "sweep string, dataset string, name string, size bigint, status string, rows bigint, at timestamp"


def _counted(df: DataFrame, stage: str, good) -> DataFrame:
    return df.observe(stage, F.count_if(good).cast("bigint").alias("rows"), F.count_if(~good).cast("bigint").alias("bad"))


def staged(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Rows of JSON lines (column value), batch or stream, each stage observed under its name with the rows that it passes and those that are bad.

    decode: bytes that are not UTF-8 are replaced, and such lines count as bad but stay. parse:
    lines that are no JSON object of the schema go; so do empty ones. validate: rows go whose
    required columns are null or blank. The counts come with the run itself, without a
    further pass: StageEvents hands on those of a stream.
    """
    yes = F.lit(True)
    received = _counted(lines.select("value"), "received", yes)
    valid = F.coalesce(F.is_valid_utf8("value"), yes)
    text = _counted(received, "decode", valid).select(F.make_valid_utf8("value").alias("value"))
    parsed = text.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.coalesce(F.trim("value"), F.lit("")).alias("t"))
    whole = F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.startswith("t", F.lit("{"))
    rows = _counted(parsed, "parse", whole).filter(whole).select("r.*").drop("_corrupt")
    filled = yes
    for name in required:
        filled = filled & (F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) != "")
    return _counted(_counted(rows, "validate", filled).filter(filled), "sink", yes)


class StageEvents(StreamingQueryListener):
    """Hands (query, batch, stage, rows, bad) of every stage of every micro-batch to emit, in the order of stages.

    Only counts reach the driver. A batch that runs again after a restart is reported again
    under its number, so readers take the last report of a batch.
    """

    def __init__(self, emit: Callable[[tuple], None]):
        self.emit = emit
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics
        for stage in STAGES:
            if stage in seen:
                self.emit((str(event.progress.id), event.progress.batchId, stage, seen[stage]["rows"], seen[stage]["bad"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Return when a query has ended and all its events were handed on."""
        query.awaitTermination()
        if not self._end(query.runId).wait(seconds):
            raise TimeoutError("the end of the query was not reported")


def staged_load(lines: DataFrame, schema: str, required: list[str], sink: str, checkpoint: str) -> list[tuple]:
    """Run a stream of lines into a Parquet sink until nothing is left; the stage events of this run."""
    spark, events = lines.sparkSession, []
    listener = StageEvents(events.append)
    spark.streams.addListener(listener)
    try:
        query = staged(lines, schema, required).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    return [e for e in events if e[0] == str(query.id)]


def sweep_folder(spark: SparkSession, dataset: str, folder: str, schema: str, sink: str, ledger: str, most: int = 1000) -> DataFrame:
    """Load the JSON files of a folder that no sweep has loaded, the oldest most of them; name, size, status and rows of each.

    A file is known by dataset, name and size: one that comes again, wherever below the
    folder, is skipped, one of the same name with another size is new. Only success counts: a file
    with a line that does not parse is entered as failed, gives no rows, and is tried again
    by the next sweep. Files without a byte are passed over, as there is nothing to load. All
    files of a sweep are read as one distributed job.

    Rows are written first, in a folder of the sweep's own, and the ledger last in one
    append. What a sweep wrote that did not come to its entry is never seen by landed(), so
    a crash between the two loads nothing twice.
    """
    sweep = uuid.uuid4().hex
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")
    first = listed.groupBy("name", "size").agg(F.min_by("path", F.struct("modificationTime", "path")).alias("path"), F.min("modificationTime").alias("since"))
    if exists(spark, ledger):
        loaded = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("status") == "success") & (F.col("dataset") == dataset))
        first = first.join(loaded.select("name", "size").distinct(), ["name", "size"], "left_anti")
    chosen = first.orderBy("since", "name", "size").limit(most).collect()  # most at most
    if not chosen:
        return spark.createDataFrame([], "name string, size bigint, status string, rows bigint")
    pending = spark.createDataFrame([(r["path"], r["name"], r["size"]) for r in chosen], "path string, name string, size bigint")
    lines = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json([r["path"] for r in chosen])
    rows = lines.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_size").alias("_size"))
    tried = written(rows, "sweep")
    found = tried.groupBy(F.col("_name").alias("name"), F.col("_size").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count("_corrupt").alias("bad"))
    status = pending.drop("path").join(found, ["name", "size"], "left").select("name", "size", F.when(F.coalesce("bad", F.lit(0)) > 0, "failed").otherwise("success").alias("status"), F.when(F.coalesce("bad", F.lit(0)) > 0, 0).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("rows"))
    status = written(status, "status")
    good = status.filter("status = 'success'").select(F.col("name").alias("_name"), F.col("size").alias("_size"))
    tried.drop("_corrupt").join(F.broadcast(good), ["_name", "_size"], "left_semi").drop("_name", "_size").write.parquet(f"{sink}/sweep={sweep}")
    entries = status.select(F.lit(sweep).alias("sweep"), F.lit(dataset).alias("dataset"), "name", "size", "status", "rows", F.current_timestamp().alias("at"))
    entries.coalesce(1).write.mode("append").parquet(ledger)  # most rows at most
    return status


def landed(spark: SparkSession, sink: str, ledger: str, schema: str) -> DataFrame:
    """The rows of all sweeps that are in the ledger."""
    entered = spark.read.schema(LEDGER).parquet(ledger).select("sweep").distinct()
    rows = spark.read.schema(f"{schema}, sweep string").parquet(sink)
    return rows.join(F.broadcast(entered), "sweep", "left_semi").drop("sweep")  # a short text a sweep
