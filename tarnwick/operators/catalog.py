"""Snapshot queries: pages, point look-ups, schema and changes since a watermark."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import drift_map, json_or, merged_map

KEY = "vendor_product_ref"
TYPED = (KEY, "title", "description", "theme", "asset_class", "keywords_json", "identifiers_json", "raw_attributes_json", "snapshot_id", "ingested_at", "created_at", "modified_at", "version")
REQUIRED = (KEY, "title")
PAGE = (1, 200)


def encode_cursor(vendor: str, modified_since: str | None, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": vendor, "m": modified_since, "o": offset}).encode()).decode()


def decode_cursor(cursor: str, vendor: str, modified_since: str | None) -> int:
    """The offset; a cursor of another vendor or filter raises ValueError."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        at = found["o"]
    except Exception as error:
        raise ValueError("bad cursor") from error
    if (found.get("v"), found.get("m")) != (vendor, modified_since):
        raise ValueError("cursor belongs to another query")
    return at


def normalise(snapshot: DataFrame) -> DataFrame:
    """Typed product columns with parsed JSON; unknown columns go to raw_attributes, where JSON keys win."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    raw = json_or(F.col("raw_attributes_json"), "map<string,string>", empty)
    extra = drift_map({c: F.col(f"`{c}`") for c in snapshot.columns}, TYPED)
    plain = [c for c in TYPED if not c.endswith("_json") and c in snapshot.columns]
    return snapshot.select(
        *plain,
        json_or(F.col("keywords_json"), "array<string>", F.array().cast("array<string>")).alias("keywords"),
        json_or(F.col("identifiers_json"), "map<string,string>", empty).alias("identifiers"),
        merged_map(raw, extra).alias("raw_attributes"),
    )


def since(snapshot: DataFrame, modified_since: str | Column | None, column: str = "modified_at") -> DataFrame:
    """Rows modified strictly after the instant."""
    if modified_since is None:
        return snapshot
    return snapshot.filter(F.col(column) > (F.lit(modified_since) if isinstance(modified_since, str) else modified_since))


def page(snapshot: DataFrame, offset: int = 0, limit: int = 50, key: str = KEY) -> DataFrame:
    """A page in the order of the key: rows offset to offset + limit.

    The offset form reads all rows before it. keyset_page() doesn't.
    """
    if not PAGE[0] <= limit <= PAGE[1]:
        raise ValueError(f"limit must be {PAGE[0]} to {PAGE[1]}")
    return snapshot.orderBy(key).offset(offset).limit(limit)


def keyset_page(snapshot: DataFrame, after=None, limit: int = 50, key: str = KEY) -> DataFrame:
    """The rows after a key: a pushed-down filter and a top-k, at any depth."""
    rows = snapshot if after is None else snapshot.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def list_products(snapshot: DataFrame, vendor: str, cursor: str | None = None, limit: int = 50, modified_since: str | None = None) -> tuple[list, str | None]:
    """Rows of a page and the cursor of the next, if there is one; versions of a product are rows of their own."""
    at = decode_cursor(cursor, vendor, modified_since) if cursor else 0
    if not PAGE[0] <= limit <= PAGE[1]:
        raise ValueError(f"limit must be {PAGE[0]} to {PAGE[1]}")
    rows = since(snapshot, modified_since).orderBy(KEY).offset(at).limit(limit + 1).collect()
    return rows[:limit], encode_cursor(vendor, modified_since, at + limit) if len(rows) > limit else None


def get_product(snapshot: DataFrame, ref: str, key: str = KEY, version: str = "version") -> DataFrame:
    """The row of the highest version, none for an unknown key."""
    found = snapshot.filter(F.col(key).cast("string") == ref)
    return found.orderBy(F.desc(version)).limit(1)


def get_schema(snapshot: DataFrame) -> list[dict]:
    """Name, type and whether it is required, for the catalogue's columns."""
    names = {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "decimal", "float": "decimal", "boolean": "boolean", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "date"}
    return [{"name": n, "type": names.get(t, "decimal" if t.startswith("decimal") else "string"), "required": n in REQUIRED} for n, t in snapshot.dtypes if n in TYPED]


def delta(snapshot: DataFrame, removed: DataFrame, watermark: Column, key: str = KEY, created: str = "created_at", modified: str = "modified_at", removed_at: str = "removed_at") -> DataFrame:
    """change_type, key and changed_at of everything strictly after the watermark, as a bag.

    Created after it is ADDED, else modified after it is UPDATED; tombstones after it are
    REMOVED. A row at the watermark itself is never seen again.
    """
    for frame, names in ((snapshot, (key, created, modified)), (removed, (key, removed_at))):
        if absent := [n for n in names if n not in frame.columns]:
            raise ValueError(f"missing columns {absent}")
    is_new = F.coalesce(F.col(created) > watermark, F.lit(False))
    kind = F.when(is_new, "ADDED").when(F.col(modified) > watermark, "UPDATED")
    changes = snapshot.select(kind.alias("change_type"), F.col(key), F.when(is_new, F.col(created)).otherwise(F.col(modified)).alias("changed_at")).filter("change_type IS NOT NULL")
    gone = removed.filter(F.col(removed_at) > watermark).select(F.lit("REMOVED").alias("change_type"), F.col(key), F.col(removed_at).alias("changed_at"))
    return changes.unionByName(gone)


def next_watermark(snapshot: DataFrame, removed: DataFrame, watermark: Column, created: str = "created_at", modified: str = "modified_at", removed_at: str = "removed_at") -> DataFrame:
    """The latest instant of the whole tables, or the given watermark where they are empty."""
    own = snapshot.agg(F.max(F.greatest(F.col(created), F.col(modified))).alias("m"))
    other = removed.agg(F.max(removed_at).alias("m"))
    return own.unionByName(other).agg(F.coalesce(F.max("m"), watermark).alias("next_watermark"))


def delta_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def describe() -> dict:
    return {"operations": ["list_products", "get_product", "get_schema", "delta"], "page_limit": list(PAGE), "key": KEY, "watermark": "exclusive"}
