"""Deterministic identifiers as native expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of this library's identifiers.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "tarnwick.example")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The version-5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*map(F.lit, "89ab")), nibble + 1)
    fixed = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(fixed, a, n) for a, n in cuts))


def slug(c: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(c)), F.lit("&"), F.lit("and")), F.lit(" "), F.lit(""))


def product_iri(vendor: Column, product_id: Column) -> Column:
    """Stable over the vendor's case and white space around either part."""
    seed = F.concat(F.lower(F.trim(vendor)), F.lit("::"), F.trim(product_id))
    return F.concat(F.lit("mds."), slug(vendor), F.lit(":"), uuid5(seed))


def concept_iri(kind: Column, local: Column) -> Column:
    return F.concat(F.lit("catalog:"), kind, F.lit(":"), uuid5(F.concat(F.lit("concept::"), kind, F.lit("::"), F.lower(local))))


def url_product_id(url: Column) -> Column:
    return uuid5(url, uuid.NAMESPACE_URL)


def job_id(bucket: Column, key: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("/", bucket, key), 256), F.lit(24))


def unordered_digest(line: Column) -> Column:
    """An aggregate: the digest of a group's lines, whatever their order.

    Each line's SHA-256 counts as two numbers, and the sums and the count of lines are
    hashed. Sums are taken per task before the shuffle, so nothing is gathered.
    """
    digest = F.sha2(line, 256)
    part = lambda start: F.coalesce(F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return F.sha2(F.concat_ws(":", part(1), part(16), F.count(line).cast("string")), 256)
