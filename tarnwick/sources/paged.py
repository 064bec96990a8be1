"""Paged catalogues as a Spark data source: each vendor's pages are followed by ``next``.

A page is a JSON object; its ``next`` names the page after it. Pages are landed files: an
address is a file, or a folder that holds one file, as Spark writes it. Where it ends in
``#line=`` and a number, the file has a page a line and the address is that line, counted
from zero; a pull opens such a file once for the pages that it follows within it and holds
it until then, so a file should have a few MB. An address without
a scheme or a leading ``/`` is taken from the folder of the page that names it. A
``next`` that is true but no text asks the vendor's endpoint again; null, false, empty or
missing ends the pull, and so does ``max_pages``, which leaves the vendor ``truncated``.

A vendor is one partition, since only a page tells which one follows it; vendors are pulled
beside each other, and a page is handed on before the next one is opened. ``resume`` pulls
from where an earlier pull was cut off.

Defined cases: a disabled vendor has no pages and is ``skipped``; one named twice is pulled
twice. A page that is no JSON object, or does not exist, fails the pull: its task
is tried again by Spark, and no page is left out silently.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .xlsx import files, opened

MAX_PAGES = 10_000
#: The address of a page in a file of many.
LINE = re.compile(r"(.*)#line=([0-9]+)", re.DOTALL)
PAGES = "vendor string, page int, address string, body string, next string, truncated boolean"
VENDORS = "vendor string, endpoint string, enabled boolean, max_pages int"


def follow(endpoint: str, address: str, following) -> str | None:
    """The address of the page after the one at address, from that one's ``next``."""
    if not following:
        return None
    if not isinstance(following, str):
        return endpoint
    if "://" in following or following.startswith("/"):
        return following
    return f"{address.rstrip('/').rsplit('/', 1)[0]}/{following}"


def _content(address: str) -> str:
    held = files(address)
    if len(held) != 1:
        raise ValueError(f"{address} holds {len(held)} files, a page is in one")
    with opened(held[0]) as f:
        return f.read().decode("utf-8")


class Fetcher:
    """Pages by address; the last file of a page a line is kept."""

    def __init__(self):
        self.path, self.lines = None, []

    def __call__(self, address: str) -> str:
        path, line = (m[1], int(m[2])) if (m := LINE.fullmatch(address)) else (address, None)
        if line is None:
            return _content(path)
        if path != self.path:
            self.path, self.lines = path, _content(path).split("\n")
        if line >= len(self.lines):
            raise ValueError(f"{path} has no line {line}")
        return self.lines[line]


@dataclass
class Vendor(InputPartition):
    vendor: str
    endpoint: str
    start: str
    max_pages: int


class PagedCatalogue(DataSource):
    """``spark.read.format("paged_catalogue").option("vendors", ...)``; vendors are a JSON array of objects as in VENDORS."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalogue"

    def schema(self):
        return PAGES

    def reader(self, schema):
        return _Reader(json.loads(self.options["vendors"]))


class _Reader(DataSourceReader):
    def __init__(self, vendors):
        self.vendors = [v for v in vendors if v.get("enabled")]

    def partitions(self):
        return [Vendor(v["vendor"], v["endpoint"], v.get("start") or v["endpoint"], int(MAX_PAGES if v.get("max_pages") is None else v["max_pages"])) for v in self.vendors]

    def read(self, own):
        if own is None:  # no vendor is enabled
            return
        address, page, fetch = own.start, 0, Fetcher()
        while address and page < own.max_pages:
            body = fetch(address)
            found = json.loads(body)
            if not isinstance(found, dict):
                raise ValueError(f"{address} is no JSON object")
            page += 1
            following = follow(own.endpoint, address, found.get("next"))
            yield own.vendor, page, address, body, following, bool(following) and page == own.max_pages
            address = following


def _listed(vendors: DataFrame) -> list[dict]:
    """The configuration, which names one endpoint a vendor."""
    return [r.asDict() for r in vendors.collect()]


def pull(spark: SparkSession, vendors: DataFrame, start: str | None = None) -> DataFrame:
    """Pages (as in PAGES) of the enabled vendors; column start of vendors, where named, is the page to begin with."""
    spark.dataSource.register(PagedCatalogue)
    wanted = vendors.select("vendor", "endpoint", F.coalesce("enabled", F.lit(False)).alias("enabled"), "max_pages", *([F.col(start).alias("start")] if start else []))
    return spark.read.format("paged_catalogue").option("vendors", json.dumps(_listed(wanted))).load()


def summary(vendors: DataFrame, pages: DataFrame) -> DataFrame:
    """vendor, pages, skipped (not enabled) and truncated (max_pages reached before the end) of each vendor."""
    counts = pages.groupBy("vendor").agg(F.count(F.lit(1)).alias("pages"), F.max("truncated").alias("truncated"))
    enabled = F.coalesce("enabled", F.lit(False))
    # A vendor that may not pull any page is cut off before its first one.
    none = enabled & (F.coalesce("max_pages", F.lit(MAX_PAGES)) <= 0)
    return vendors.join(counts, "vendor", "left").select("vendor", F.coalesce("pages", F.lit(0)).alias("pages"), (~enabled).alias("skipped"), F.coalesce("truncated", none).alias("truncated"))


def resume(spark: SparkSession, vendors: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages after those of an earlier pull, for vendors that it left truncated."""
    ends = pages.filter("truncated").select("vendor", F.col("next").alias("start"))
    return pull(spark, vendors.join(ends, "vendor"), "start")


def items(pages: DataFrame, schema: str, field: str = "items") -> DataFrame:
    """One row for each entry of the array ``field`` of each page, with vendor and page."""
    found = F.from_json("body", f"struct<`{field}`: array<struct<{schema}>>>")
    return pages.select("vendor", "page", F.explode(found[field]).alias("item")).select("vendor", "page", "item.*")
