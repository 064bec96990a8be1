"""Dates and intervals in a closed ISO grammar, and watermarks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_truthy, map_value, trim

#: Range separators in the order they are tried.
SEPARATORS = (" to ", " -- ", "/", " – ", " — ", "..")
#: Keys under which raw rows declare what they cover.
START_END_KEYS = (("coverage_start", "coverage_end"), ("coverageStart", "coverageEnd"), ("start_date", "end_date"), ("startDate", "endDate"))
COVERAGE_KEYS = ("temporal_coverage", "temporalCoverage", "coverage_period", "coveragePeriod", "coverage_start", "coverageStart")


def _guarded(parts: Column, pattern: str) -> Column:
    return F.when((parts.substr(1, 4) >= "0001"), F.try_to_date(parts, pattern))


def point(text: Column) -> Column:
    """(lo, hi) of a year, a month or a day; null outside the grammar or the calendar."""
    return let(trim(text), _point)


def _point(t: Column) -> Column:
    year = F.when(t.rlike(r"^\d{4}$"), _guarded(F.concat(t, F.lit("-01-01")), "yyyy-MM-dd"))
    month = F.when(t.rlike(r"^\d{4}-\d{2}$"), _guarded(F.concat(t, F.lit("-01")), "yyyy-MM-dd"))
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), _guarded(t, "yyyy-MM-dd"))
    lo = F.coalesce(year, month, day)
    hi = F.when(year.isNotNull(), F.last_day(F.add_months(year, 11))).when(month.isNotNull(), F.last_day(month)).otherwise(day)
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once; nested conditions would otherwise repeat it at every place."""
    return F.transform(F.array(value), use)[0]


def interval(text: Column) -> Column:
    """(lo, hi) of a declaration, each null where open; null as a whole where nothing can be compared."""
    return let(trim(F.coalesce(text, F.lit(""))), lambda t: let(_halves(t), lambda h: F.when(h.isNull(), point(t)).when(F.size(h) == 2, _ranged(trim(h[0]), trim(h[1])))))


def _halves(t: Column) -> Column:
    out = F.when(t.rlike(r"^\d{4}\s*-\s*\d{4}$"), F.split(t, r"\s*-\s*"))
    for sep in reversed(SEPARATORS):
        out = F.when(F.contains(t, F.lit(sep)), F.split(t, re.escape(sep))).otherwise(out)
    return out


def _ranged(low: Column, high: Column) -> Column:
    low_open, high_open = low.isin("..", ""), high.isin("..", "")

    def bounds(lo: Column, hi: Column) -> Column:
        fits = ~(low_open & high_open) & (low_open | lo.isNotNull()) & (high_open | hi.isNotNull()) & ~F.coalesce(lo > hi, F.lit(False))
        return F.when(fits, F.struct(lo.alias("lo"), hi.alias("hi")))

    return let(point(low)["lo"], lambda lo: let(point(high)["hi"], lambda hi: bounds(lo, hi)))


def overlap(a: Column, b: Column) -> Column:
    """Whether two inclusive intervals share a day; an open side reaches without end."""
    apart = F.coalesce(a["hi"] < b["lo"], F.lit(False)) | F.coalesce(b["hi"] < a["lo"], F.lit(False))
    return ~apart


def compatible(a: Column, b: Column) -> Column:
    """Whether two declarations share a day or one of them cannot be compared; each is read once, and the second only where the first can be."""
    apart = lambda x: let(interval(b), lambda y: y.isNotNull() & ~overlap(x, y))
    return let(interval(a), lambda x: F.when(x.isNull(), True).otherwise(~apart(x)))


def coverage(declared: Column, raw: Column) -> Column:
    """The declared coverage, else start and end keys (a lone start is open-ended), else a coverage key."""
    ranges = []
    for start, end in START_END_KEYS:
        s, e = map_value(raw, [start]), map_value(raw, [end])
        ranges.append(F.when(s.isNotNull(), F.concat(s, F.lit("/"), F.coalesce(e, F.lit("")))))
    return F.coalesce(first_truthy(declared), *ranges, map_value(raw, COVERAGE_KEYS))


def parse_watermark(c: Column, vendor: str) -> Column:
    """A watermark as an instant: the vendor prefix is optional, a date alone is its midnight, no zone is UTC."""
    bare = F.when(F.startswith(c, F.lit(f"{vendor}-")), F.substring(c, len(vendor) + 2, 64)).otherwise(c)
    return F.coalesce(F.try_to_timestamp(bare), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def format_watermark(c: Column, vendor: str) -> Column:
    return F.concat(F.lit(f"{vendor}-"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
