"""Queries that land the driver's tables as files and run them through streams and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import scratch_path, table
from ..streaming import etl, folds, streams
from .queries import EVENTS_SQL, POSITIVE_SQL, decisions, query

#: A tenth of the events lands as broken lines, and a seventh without a type.
EVENT_LINES_SQL = "e AS (SELECT event_id, event_id % 10 = 0 AS broken, event_id % 7 = 0 AS untyped FROM events)"


@query(f"""WITH {EVENT_LINES_SQL} SELECT 'received' AS stage, count(*) AS rows, 0 AS bad FROM e UNION ALL SELECT 'decode', count(*), 0 FROM e UNION ALL SELECT 'parse', count(*) FILTER (NOT broken), count(*) FILTER (broken) FROM e
    UNION ALL SELECT 'validate', count(*) FILTER (NOT broken AND NOT untyped), count(*) FILTER (NOT broken AND untyped) FROM e UNION ALL SELECT 'sink', count(*) FILTER (NOT broken AND NOT untyped), 0 FROM e""")
def stage_events(spark, sf_dir):
    """Counts of every stage, as the stream reports them, over all events as JSON lines."""
    event = F.struct("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"))
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.to_json(event)).alias("value"))
    folder = scratch_path(spark, "lines")
    lines.write.text(folder)
    found = etl.staged_load(spark.readStream.text(folder), "event_id bigint, event_type string", ["event_id", "event_type"], scratch_path(spark, "loaded"), scratch_path(spark, "stages"))
    rows = spark.createDataFrame([e[2:] for e in found], "stage string, rows bigint, bad bigint")  # five a micro-batch
    return rows.groupBy("stage").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0""")
def swept_orders(spark, sf_dir):
    """Orders landed as a folder for each status, swept again and again; files with a broken line are never loaded."""
    orders = table(spark, sf_dir, "orders")
    folder, sink, ledger = (scratch_path(spark, name) for name in ("landing", "swept", "ledger"))
    kept = (F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 2 == 0)
    line = F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus"))
    orders.filter(kept).select(line.alias("value"), F.col("o_orderstatus").alias("status")).write.partitionBy("status").text(f"{folder}/good")
    orders.filter(~kept).select(F.concat(F.lit("{"), line).alias("value")).write.text(f"{folder}/bad")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
    for _ in range(3):
        etl.sweep_folder(spark, "orders", folder, schema, sink, ledger)
    return etl.landed(spark, sink, ledger, schema)


def _folded(spark, sf_dir):
    folder, sink = scratch_path(spark, "journal"), scratch_path(spark, "states")
    events = decisions(spark, sf_dir).select("vendor", "product_id", "node_iri", "decision", "provisional", "decided_at_ms", "seq")
    events.repartition(3).write.json(folder)
    stream = streams.landing(spark, folder, events.schema.simpleString()[7:-1].replace(":", " "), files_per_trigger=2)
    folds.fold(stream, sink, scratch_path(spark, "fold"), partitions=8).awaitTermination()
    return folds.current(spark, sink)


@query(f"WITH {POSITIVE_SQL} SELECT vendor, product_id, node_iri, decision, decided_at_ms, seq FROM held")
def folded_positives(spark, sf_dir):
    """precedent_current as kept up by a stream over several micro-batches."""
    return _folded(spark, sf_dir)[0]


@query(f"""WITH {EVENTS_SQL} SELECT vendor, product_id, node_iri, decided_at_ms FROM
    (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vendor, product_id, node_iri ORDER BY decided_at_ms DESC, seq DESC) = 1) WHERE decision = 'reject'""")
def folded_negatives(spark, sf_dir):
    """negative_precedents as kept up by a stream over several micro-batches."""
    return _folded(spark, sf_dir)[1]
