"""Versioned metadata: current versions, changes, and reports over the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any

REPORT_ROWS = 500


def current(entities: DataFrame) -> DataFrame:
    return entities.filter("current_flag = 'y'")


def with_provider(datasets: DataFrame, providers: DataFrame) -> DataFrame:
    """Current datasets that have a current provider, with its name."""
    return current(datasets).join(current(providers).select("provider_id", "provider_name"), "provider_id")


def with_roles(users: DataFrame, roles: DataFrame, grants: DataFrame) -> DataFrame:
    """Users with the sorted names of their roles; one without roles has none."""
    named = grants.join(roles.select("role_id", "role_name"), "role_id").groupBy("user_id").agg(F.array_sort(F.collect_set("role_name")).alias("roles"))
    return users.join(named, "user_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def latest_version(entities: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The row with the highest version of each key; a partial maximum per task, no sort."""
    names = [c for c in entities.columns if c != key]
    latest = entities.groupBy(key).agg(F.max_by(F.struct(*names), F.col(version)).alias("r"))
    return latest.select(key, *(F.col(f"r.{n}").alias(n) for n in names)).select(entities.columns)


def scd2_apply(entities: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Close the current row of each changed key and add the change as its next version.

    changes has the attributes and, optionally, a boolean column deleted; a deletion flags
    the current row d and adds none. A change without difference adds no version.
    """
    attributes = [c for c in entities.columns if c not in (key, "version", "current_flag")]
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    new = changes.select(F.col(key), F.struct(*attributes).alias("__new"), gone.alias("__gone"))
    joined = entities.join(new, key, "left")
    differs = F.col("__new").isNotNull() & (F.col("__gone") | ~F.struct(*attributes).eqNullSafe(F.col("__new")))
    closes = (F.col("current_flag") == "y") & F.coalesce(differs, F.lit(False))
    kept = joined.withColumn("current_flag", F.when(closes & F.col("__gone"), "d").when(closes, "n").otherwise(F.col("current_flag"))).select(entities.columns)
    top = entities.groupBy(key).agg(F.max("version").alias("__v"), F.max_by(F.struct(*attributes), F.when(F.col("current_flag") == "y", F.col("version"))).alias("__old"))
    added = new.filter(~F.col("__gone")).join(top, key, "left").filter(~F.coalesce(F.col("__old").eqNullSafe(F.col("__new")), F.lit(False)))
    fresh = added.select(key, *(F.col(f"__new.{a}").alias(a) for a in attributes), (F.coalesce("__v", F.lit(0)) + 1).alias("version"), F.lit("y").alias("current_flag"))
    return kept.unionByName(fresh.select(entities.columns))


def next_version(versions: DataFrame, column: str = "version", minimum: int = 1) -> DataFrame:
    """One above the highest version that is an integer, the minimum at least."""
    return versions.agg(F.greatest(F.lit(minimum), F.coalesce(F.max(F.col(column).try_cast("bigint")) + 1, F.lit(minimum))).alias("next_version"))


def run_report(log: DataFrame, providers: DataFrame, datasets: DataFrame, status: str | None = None, search: str | None = None, from_date: str | None = None, to_date: str | None = None, limit: int = REPORT_ROWS) -> DataFrame:
    """The newest runs with the current provider and dataset beside them; both days are included."""
    named = log.join(current(providers).select("provider_id", "provider_name"), "provider_id", "left").join(current(datasets).select("dataset_id", "dataset_name"), "dataset_id", "left")
    if status:
        named = named.filter(F.col("run_status") == status)
    if search:
        named = named.filter(contains_any(search, F.col("provider_name"), F.col("dataset_name")))
    if from_date:
        named = named.filter(F.col("run_date") >= F.lit(from_date).cast("timestamp"))
    if to_date:
        named = named.filter(F.col("run_date") <= F.lit(f"{to_date} 23:59:59").cast("timestamp"))
    return named.orderBy(F.desc("run_date"), "run_id").limit(limit)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or an error that names a repeated key."""
    if row := duplicates(df, *keys).first():
        raise ValueError(f"repeated {', '.join(f'{k}={row[k]!r}' for k in keys)}")
    return df


def transforms_on_columns(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """Registered columns with their rules, matched by name without case; columns without rules stay."""
    right = rules.withColumn("__k", F.lower("col_name")).drop("col_name")
    return columns.withColumn("__k", F.lower("col_name")).join(right, "__k", "left").drop("__k")
