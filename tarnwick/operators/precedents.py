"""Decisions on mappings: an append-only event table and the state that follows from it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import unordered_digest
from ..functions.text import vendor_signature
from .ingest import upsert

POSITIVE, NEGATIVE = ("approve", "override"), "reject"
PRODUCT = ["vendor", "product_id"]
BUNDLE_MAJOR = "1"


def validate(decisions: DataFrame, nodes: DataFrame, vendors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted decisions with their confidence, and rejected ones with a reason.

    Approvals need a suggested score of 0 to 1; overrides count 1 and rejections 0.
    """
    known = decisions.join(nodes.select("node_iri", F.lit(True).alias("__node")).distinct(), "node_iri", "left").join(vendors.select("vendor", F.lit(True).alias("__scope")).distinct(), "vendor", "left")
    score = F.col("suggested_confidence")
    reason = (
        F.when(~F.coalesce(F.col("decision").isin(*POSITIVE, NEGATIVE), F.lit(False)), "unknown decision")
        .when(F.coalesce(F.trim("decided_by"), F.lit("")) == "", "decided_by is missing")
        .when(F.coalesce(F.trim("node_iri"), F.lit("")) == "", "node is missing")
        .when((F.col("decision") == "approve") & ~F.coalesce(score.between(0, 1), F.lit(False)), "approval without a score of 0 to 1")
        .when(F.col("__node").isNull(), "unknown node")
        .when(F.col("__scope").isNull(), "vendor out of scope")
    )
    confidence = F.when(F.col("decision") == "override", 1.0).when(F.col("decision") == NEGATIVE, 0.0).otherwise(score)
    checked = known.withColumn("reason", reason).withColumn("confidence", confidence).drop("__node", "__scope")
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def _order():
    return F.struct("decided_at_ms", "seq")


def current_positive(events: DataFrame) -> DataFrame:
    """The positive that holds for each product: its last confirmed one, unless a later rejection of the same node took it back."""
    confirmed = events.filter(~F.coalesce(F.col("provisional"), F.lit(False)))
    names = [c for c in events.columns if c not in PRODUCT]
    last = confirmed.filter(F.col("decision").isin(*POSITIVE)).groupBy(PRODUCT).agg(F.max_by(F.struct(*names), _order()).alias("p"))
    rejected = confirmed.filter(F.col("decision") == NEGATIVE).groupBy(*PRODUCT, "node_iri").agg(F.max(_order()).alias("__no"))
    held = last.select(*PRODUCT, *(F.col(f"p.{n}").alias(n) for n in names)).join(rejected, [*PRODUCT, "node_iri"], "left")
    return held.filter("__no IS NULL OR __no < struct(decided_at_ms, seq)").select(events.columns)


def current_negatives(events: DataFrame) -> DataFrame:
    """Products and nodes whose last confirmed decision is a rejection."""
    confirmed = events.filter(~F.coalesce(F.col("provisional"), F.lit(False)))
    last = confirmed.groupBy(*PRODUCT, "node_iri").agg(F.max_by("decision", _order()).alias("decision"), F.max(_order()).alias("at"))
    return last.filter(F.col("decision") == NEGATIVE).select(*PRODUCT, "node_iri", F.col("at.decided_at_ms").alias("decided_at_ms"))


def rank_signals(positives: DataFrame) -> DataFrame:
    """signature, node_iri and the number of different products that hold it."""
    signature = vendor_signature(F.col("vendor"), F.col("name"), F.col("product_id"))
    return positives.withColumn("signature", signature).groupBy("signature", "node_iri").agg(F.countDistinct("vendor", "product_id").alias("n"))


def frozen_signatures(ingested: DataFrame, events: DataFrame) -> DataFrame:
    """The signature of each product: of its latest ingest, else of its first decision."""
    own = lambda: vendor_signature(F.col("vendor"), F.col("name"), F.col("product_id"))
    first = events.groupBy(PRODUCT).agg(F.min_by(own(), _order()).alias("decided"))
    latest = ingested.groupBy(PRODUCT).agg(F.max_by(own(), "ingested_at").alias("ingested"))
    return latest.join(first, PRODUCT, "full").select(*PRODUCT, F.coalesce("ingested", "decided").alias("signature"))


def replay(journal: DataFrame) -> DataFrame:
    """Journal rows that parsed, each (product, node, decision, time) once: writing a decision again changes nothing."""
    kept = journal.filter("_corrupt IS NULL").drop("_corrupt") if "_corrupt" in journal.columns else journal
    return kept.dropDuplicates([*PRODUCT, "node_iri", "decision", "decided_at_ms"])


def conflicts(positives: DataFrame) -> DataFrame:
    """Products of the same id that different vendors map to different nodes, as one row per product and mapping.

    A product is in conflict if it has more than one vendor and more than one node; that
    is an aggregate, and no pairs of vendors are made.
    """
    disputed = positives.groupBy("product_id").agg(F.min("vendor").alias("v0"), F.max("vendor").alias("v1"), F.min("node_iri").alias("n0"), F.max("node_iri").alias("n1")).filter("v0 <> v1 AND n0 <> n1")
    return positives.join(disputed.select("product_id"), "product_id", "left_semi")


def taxonomy_hash(nodes: DataFrame) -> DataFrame:
    """One row: the digest of all nodes, whatever their order. A node is hashed where it lies; only sums are gathered."""
    line = F.concat_ws("\u001f", "iri", F.coalesce("label", F.lit("")), F.coalesce("parent_iri", F.lit("")))
    return nodes.agg(unordered_digest(line).alias("taxonomy_hash"))


def export_bundle(events: DataFrame) -> DataFrame:
    """One pattern per confirmed positive: its mapping, signature, rank signal and provenance as JSON."""
    held = current_positive(events).withColumn("signature", vendor_signature(F.col("vendor"), F.col("name"), F.col("product_id")))
    rank = held.groupBy("signature", "node_iri").agg(F.countDistinct("vendor", "product_id").alias("rank"))
    at = F.date_format(F.timestamp_millis("decided_at_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    provenance = F.struct("decided_by", at.alias("decided_at"), "decision")
    pattern = F.struct("vendor", "product_id", F.col("name").alias("product_name"), "signature", F.col("node_iri").alias("mapped_node_iri"), "confidence", "rank", provenance.alias("provenance"))
    return held.join(rank, ["signature", "node_iri"]).select("vendor", "product_id", F.to_json(pattern).alias("pattern"))


def bundle_manifest(events: DataFrame, nodes: DataFrame, version: str = f"{BUNDLE_MAJOR}.0.0") -> DataFrame:
    """One row for a bundle: its format version, the fingerprint of the taxonomy that its mappings point into, and its patterns."""
    patterns = current_positive(events).agg(F.count(F.lit(1)).alias("patterns"))
    return taxonomy_hash(nodes).join(patterns).select(F.lit(version).alias("version"), "taxonomy_hash", "patterns")  # one row each


PATTERN = "vendor string, product_id string, product_name string, signature string, mapped_node_iri string, confidence double, rank bigint, provenance struct<decided_by:string,decided_at:string,decision:string>"


def import_bundle(patterns: DataFrame, version: str, nodes: DataFrame, vendors: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to append, and counts by outcome. An unknown node is skipped before the scope is looked at.

    Importing again appends nothing, since decisions that are there already are left out.
    """
    if version.split(".")[0] != BUNDLE_MAJOR:
        raise ValueError(f"bundle version {version} is not {BUNDLE_MAJOR}.x")
    parsed = patterns.select(F.from_json("pattern", PATTERN, {"mode": "FAILFAST"}).alias("p")).select("p.*")
    known = parsed.join(nodes.select(F.col("node_iri").alias("mapped_node_iri"), F.lit(True).alias("__node")).distinct(), "mapped_node_iri", "left").join(vendors.select("vendor", F.lit(True).alias("__scope")).distinct(), "vendor", "left")
    outcome = F.when(F.col("__node").isNull(), "skipped_unknown_node").when(F.col("__scope").isNull(), "skipped_out_of_scope").otherwise("applied")
    judged = known.withColumn("outcome", outcome)
    when = F.unix_millis(F.try_to_timestamp("provenance.decided_at", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))
    made = judged.filter("outcome = 'applied'").select(
        "vendor", "product_id", F.col("product_name").alias("name"), F.col("mapped_node_iri").alias("node_iri"), F.col("provenance.decision").alias("decision"),
        F.col("provenance.decided_by").alias("decided_by"), "confidence", F.lit(False).alias("provisional"), when.alias("decided_at_ms"),
    )
    fresh = made.join(events.select(*PRODUCT, "node_iri", "decision", "decided_at_ms"), [*PRODUCT, "node_iri", "decision", "decided_at_ms"], "left_anti")
    return fresh, judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def hydrate(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Patterns of a bundle written as text lines. No bundle is a cold start, unless strict; a broken one is an error."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        if strict:
            raise
        return spark.createDataFrame([], PATTERN)
    return lines.filter("trim(value) <> ''").select(F.from_json("value", PATTERN, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def priors(memory: DataFrame, key: str, prefix: bool = False) -> DataFrame:
    return memory.filter(F.startswith("memory_key", F.lit(key)) if prefix else F.col("memory_key") == key)


def remember(memory: DataFrame, entries: DataFrame) -> DataFrame:
    """Memory with the entries written by key, the latest update last."""
    return upsert(memory, entries, ["memory_key"], "updated_at_ms")


def newest(memory: DataFrame, n: int) -> DataFrame:
    return memory.orderBy(F.desc("updated_at_ms"), "memory_key").limit(n)
