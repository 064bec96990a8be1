"""The journal of decisions as state: each product's current positive and negatives, kept up to date by every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.precedents import NEGATIVE, POSITIVE, PRODUCT

_AT = "decided_at_ms bigint, seq bigint"
OUT = f"vendor string, product_id string, node_iri string, positive struct<{_AT}, decision string>, rejected struct<{_AT}>, last struct<{_AT}, decision string>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(stream: DataFrame, sink: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Keep what was last decided on each node for each product and write it to the sink whenever a micro-batch changes it; current() reads it.

    The state of a product and a node is its last positive, its last rejection and its last
    decision, as maxima by time, nulls first: events may come in any order and more than once.
    Each task combines its events before they are shuffled, and the state grows with the
    pairs of a product and a node, not with their events.

    Events that are provisional, or have no vendor, product or node, change nothing. The
    number of partitions of the state is fixed by the first start of a checkpoint. A batch that
    runs again writes its folder again.
    """
    spark = stream.sparkSession
    kept = stream.filter(~F.coalesce("provisional", F.lit(False))).dropna(subset=[*PRODUCT, "node_iri"])
    at, made = F.struct("decided_at_ms", "seq"), F.struct("decided_at_ms", "seq", "decision")
    states = kept.groupBy(*PRODUCT, "node_iri").agg(
        F.max(F.when(F.col("decision").isin(*POSITIVE), made)).alias("positive"), F.max(F.when(F.col("decision") == NEGATIVE, at)).alias("rejected"), F.max(made).alias("last")
    )

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    settings = {_PROVIDER: _ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():  # a query takes the settings that hold when it starts
        spark.conf.set(name, value)
    try:
        return states.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def current(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    """Positives (vendor, product_id, node_iri, decision, decided_at_ms, seq) and negatives (vendor, product_id, node_iri, decided_at_ms) as of the last micro-batch."""
    rows = spark.read.schema(OUT).parquet(sink)
    names = ["positive", "rejected", "last"]
    nodes = rows.groupBy(*PRODUCT, "node_iri").agg(F.max_by(F.struct(*names), "batch").alias("s")).select(*PRODUCT, "node_iri", "s.*")
    held = nodes.filter("positive IS NOT NULL").groupBy(*PRODUCT).agg(F.max(F.struct("positive", "node_iri", "rejected")).alias("h")).select(*PRODUCT, "h.*")
    standing = held.filter(F.col("rejected").isNull() | (F.col("rejected") < F.struct("positive.decided_at_ms", "positive.seq")))
    positive = standing.select(*PRODUCT, "node_iri", "positive.decision", "positive.decided_at_ms", "positive.seq")
    return positive, nodes.filter(F.col("last.decision") == NEGATIVE).select(*PRODUCT, "node_iri", "last.decided_at_ms")
