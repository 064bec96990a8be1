"""Matching quality on golden sets, and monitoring after release."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written

PASS_CUT = 0.80
MIN_SAMPLES, MIN_AUTO = 20, 20
FLOORS, HALVES = (0.75, 0.80, 0.85), (0.03, 0.05, 0.07)


def predictions(results: DataFrame) -> DataFrame:
    """case_id, target_iri, confidence, status, band, abstained, auto_pass of raw results of either form.

    Columns read: case_id, mapped_node_iri, proposed_target_iri, confidence, status, band,
    requires_human_review. Contradictory rows raise an error.
    """
    none, no = F.lit(""), F.lit(False)
    target = F.coalesce("mapped_node_iri", "proposed_target_iri")
    status, review = F.lower(F.coalesce("status", none)), F.coalesce("requires_human_review", no)
    band = F.col("band")
    final = status.isin("auto_mapped", "published", "approved")
    auto = final | ((status == "") & F.coalesce(band.isin("high", "pass"), no) & ~review)
    abstained = review | (F.coalesce(target, none) == "") | status.isin("needs_review", "out_of_scope", "rejected", "retry", "hitl") | ((status == "") & F.coalesce(band.isin("medium", "low", "borderline", "fail", "n/a"), no))
    confidence = F.coalesce("confidence", F.lit(0.0))
    passes = auto & ~abstained
    shown = F.when(status != "", status).when(abstained, "needs_review").otherwise("mapped")
    wrong = (
        F.when(~confidence.between(0, 1), "confidence outside 0 and 1")
        .when(final & ~passes, "a final status needs auto_pass")
        .when(passes & (confidence < PASS_CUT), "auto_pass below the cut")
        .when(passes & F.coalesce(~band.isin("pass", "high"), no), "auto_pass in a band that does not allow it")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(", case "), F.col("case_id").cast("string")))).otherwise(F.col("case_id"))
    return results.select(checked.alias("case_id"), target.alias("target_iri"), confidence.alias("confidence"), shown.alias("status"), "band", abstained.alias("abstained"), passes.alias("auto_pass"))


def _rate(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def judged(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Cases with their predictions; a case without one raises an error."""
    lacking = cases.join(found, "case_id", "left_anti").first()
    if lacking:
        raise ValueError(f"no prediction for case {lacking['case_id']!r}")
    hit = ~F.col("abstained") & F.col("target_iri").eqNullSafe(F.col("expected_target_iri"))
    return cases.join(found, "case_id").withColumn("hit", hit & ~F.col("expected_abstain"))


def metrics(rows: DataFrame, groups: Sequence[Sequence[str]] = ((),)) -> DataFrame:
    """Counts and rates of judged() rows, for each set of grouping columns in one pass.

    Empty denominators give 1 for exact matches and precision, else 0. Error sums over
    cases with an expected target are rounded to six places before they are divided.
    """
    match, auto, away = ~F.col("expected_abstain"), F.col("auto_pass"), F.col("abstained")
    error = F.abs(F.col("confidence") - F.col("hit").cast("double"))
    wrong = auto & (F.col("expected_abstain") | ~F.coalesce(F.col("target_iri") == F.col("expected_target_iri"), F.lit(False)))
    names = list(dict.fromkeys(n for g in groups for n in g))
    aggregates = [
        F.count(F.lit(1)).alias("total_cases"), _count(match).alias("expected_match_cases"), _count(~match).alias("expected_abstain_cases"), _count(away).alias("predicted_abstain_cases"),
        _count(auto).alias("auto_pass_cases"), _count(auto & ~wrong).alias("correct_auto_pass_cases"), _count(F.col("hit")).alias("correct_target_cases"),
        _count(~match & away).alias("correct_abstention_cases"), _count(wrong).alias("false_auto_pass_cases"),
        F.coalesce(F.round(F.sum(F.when(match, error)), 6), F.lit(0.0)).alias("mae_sum"), F.coalesce(F.round(F.sum(F.when(match, error * error)), 6), F.lit(0.0)).alias("brier_sum"),
    ]
    counted = rows.groupingSets([[F.col(n) for n in g] for g in groups], *map(F.col, names)).agg(*aggregates) if names else rows.agg(*aggregates)
    c = F.col
    return counted.select(
        *names, *(n for n in counted.columns if n not in names and not n.endswith("_sum")),
        _rate(c("correct_target_cases"), c("expected_match_cases"), 1.0).alias("exact_match_rate"),
        _rate(c("correct_abstention_cases"), c("expected_abstain_cases")).alias("abstention_recall"),
        _rate(c("total_cases") - c("predicted_abstain_cases"), c("total_cases")).alias("coverage"),
        _rate(c("false_auto_pass_cases"), c("auto_pass_cases")).alias("false_auto_pass_rate"),
        _rate(c("correct_auto_pass_cases"), c("auto_pass_cases"), 1.0).alias("auto_publish_precision"),
        _rate(c("mae_sum"), c("expected_match_cases")).alias("calibration_mae"),
        _rate(c("brier_sum"), c("expected_match_cases")).alias("brier_score"),
    )


def by_group(rows: DataFrame) -> DataFrame:
    """Metrics over all cases, by vendor (trimmed, lower case) and by taxonomy group."""
    return metrics(rows.withColumn("vendor", F.lower(F.trim("vendor"))), ((), ("vendor",), ("taxonomy_group",)))


def monitoring(observations: DataFrame) -> DataFrame:
    """One row: counts, precision and false rate of a window, whether it has enough samples, and what it breaches.

    observations: source_event_id, auto_pass, predicted_iri, actual_iri (null: abstain), violations (array).
    """
    auto = F.col("auto_pass")
    correct = auto & F.coalesce(F.col("predicted_iri") == F.col("actual_iri"), F.lit(False))
    counted = observations.agg(
        F.count(F.lit(1)).alias("sample_count"), _count(auto).alias("auto_pass_count"), _count(correct).alias("correct_auto_pass_count"),
        _count(F.size(F.coalesce("violations", F.array().cast("array<string>"))) > 0).alias("publish_gate_violation_count"),
    )
    c = F.col
    rated = (
        counted.withColumn("false_auto_pass_count", c("auto_pass_count") - c("correct_auto_pass_count"))
        .withColumn("auto_publish_precision", _rate(c("correct_auto_pass_count"), c("auto_pass_count"), 1.0))
        .withColumn("false_auto_pass_rate", _rate(c("false_auto_pass_count"), c("auto_pass_count")))
        .withColumn("sufficient_samples", (c("sample_count") >= MIN_SAMPLES) & (c("auto_pass_count") >= MIN_AUTO))
    )
    reasons = F.array_compact(F.array(F.when(c("auto_publish_precision") < 1, "auto_publish_precision"), F.when(c("false_auto_pass_rate") > 0, "false_auto_pass_rate"), F.when(c("publish_gate_violation_count") > 0, "publish_gate_violations")))
    return rated.withColumn("breach_reasons", F.when(c("sufficient_samples"), reasons).otherwise(F.array().cast("array<string>"))).withColumn("breached", F.size("breach_reasons") > 0)


def calibration(cases: DataFrame, score: str = "score", positive: Column | None = None, floors: Sequence[float] = FLOORS, halves: Sequence[float] = HALVES) -> DataFrame:
    """floor, half, pass_edge, passed and precision of the pass band, for each window in one scan."""
    good = positive if positive is not None else F.col("label") == "positive"
    windows = [(f, h, round(f + h, 2)) for f in floors for h in halves]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("floor"), F.lit(h).alias("half"), F.lit(e).alias("pass_edge")) for f, h, e in windows)))
    rows = cases.select(F.col(score).alias("s"), good.alias("g"), each.alias("w"))
    passed = F.col("s") >= F.col("w.pass_edge")
    counted = rows.groupBy("w").agg(_count(passed).alias("passed"), _count(passed & F.col("g")).alias("tp"))
    return counted.select("w.*", "passed", _rate(F.col("tp"), F.col("passed")).alias("precision"))


def held_out_split(outcomes: DataFrame, order: list[Column], ratio: float = 0.2) -> DataFrame:
    """Adds held_out: the tail of the given order, ratio of all rows rounded up.

    Positions come from counts per range of the order, so no task sorts all rows.
    """
    n = outcomes.count()
    cut = n - -(-int(round(n * ratio * 1e6)) // 1_000_000)
    ranked = outcomes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    ranked = written(ranked, "ordered")
    sizes = sorted((r["__p"], r["count"], r["i"]) for r in ranked.groupBy("__p").agg(F.count(F.lit(1)).alias("count"), F.min("__i").alias("i")).collect())
    starts, total = [], 0
    for p, count, first in sizes:
        starts.append((p, total - first))
        total += count
    at = ranked.sparkSession.createDataFrame(starts or [(0, 0)], "__p int, __s bigint")
    return ranked.join(F.broadcast(at), "__p").withColumn("held_out", F.col("__i") + F.col("__s") >= cut).drop("__p", "__i", "__s")


def leakage(train: DataFrame, held_out: DataFrame, *keys: str) -> DataFrame:
    """Keys on both sides; a sound split has none."""
    return train.select(*keys).join(held_out.select(*keys), list(keys), "left_semi").distinct()


def task_records(trajectories: DataFrame) -> DataFrame:
    """Trajectories with their mined outcome: success if passed automatically and published, mapped or approved."""
    outcome = F.lower(F.trim(F.coalesce("outcome", F.lit(""))))
    good = F.coalesce(F.col("auto_pass"), F.lit(False)) & outcome.isin("published", "auto_mapped", "approved")
    return trajectories.withColumn("mined_outcome", F.when(good, "success").otherwise("failure"))


def verified(observations: DataFrame, source: DataFrame) -> DataFrame:
    """Observations joined to their source records; one whose digest differs raises an error."""
    joined = observations.join(source.select("source_event_id", F.col("digest").alias("__d")), "source_event_id")
    wrong = F.raise_error(F.concat(F.lit("digest differs for event "), F.col("source_event_id").cast("string")))
    return joined.withColumn("digest", F.when(F.col("digest") == F.col("__d"), F.col("digest")).otherwise(wrong)).drop("__d")

