"""String and vector similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .identity import NAMESPACE
from .text import TOKEN

PREFIX, PREFIX_WEIGHT = 4, 0.1


def jaro_winkler_of(a: str | None, b: str | None) -> float:
    """Jaro-Winkler of the lower-cased, stripped strings; the prefix always counts."""
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, ch in enumerate(a):
        j = b.find(ch, max(0, i - reach), i + reach + 1)
        while j >= 0 and taken[j]:
            j = b.find(ch, j + 1, i + reach + 1)
        if j >= 0:
            taken[j] = True
            left.append(ch)
    if not left:
        return 0.0
    right = [ch for ch, own in zip(b, taken) if own]
    swapped = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:PREFIX], b[:PREFIX])) if x != y), min(PREFIX, len(a), len(b)))
    return jaro + prefix * PREFIX_WEIGHT * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = jaro_winkler_of(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def score_pairs(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Score each different pair of texts once and join the scores back."""
    scored = pairs.select(a, b).distinct().withColumn(out, jaro_winkler(F.col(a), F.col(b)))
    return pairs.join(scored, [a, b])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def lexical_score(term: Column, label: Column, synonyms: Column) -> Column:
    """0.95 where the label contains the term, 0.85 where a synonym does, 0.6 where a synonym has one of its words, else 0."""
    t = F.lower(term)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    inside = F.exists(synonyms, lambda s: F.contains(F.lower(s), t))
    word = F.exists(synonyms, lambda s: F.exists(words, lambda w: F.contains(F.lower(s), w)))
    return F.when(F.contains(F.lower(label), t), 0.95).when(inside, 0.85).when(word, 0.6).otherwise(0.0)


def register(spark) -> None:
    """Make functions callable from SQL: jaro_winkler, bm25_tokens, uuid5, and parse_temporal for a year, a month or a day."""
    spark.udf.register("jaro_winkler", jaro_winkler)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bm25_tokens(x STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(coalesce(x, '')), '{TOKEN}', 0)")
    digest = f"sha1(concat(unhex('{NAMESPACE.hex}'), encode(x, 'UTF-8')))"
    variant = f"substr('89ab', 1 + cast(conv(substr({digest}, 17, 1), 16, 10) AS INT) % 4, 1)"
    cuts = f"substr({digest}, 1, 8), substr({digest}, 9, 4), concat('5', substr({digest}, 14, 3)), concat({variant}, substr({digest}, 18, 3)), substr({digest}, 21, 12)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION uuid5(x STRING) RETURNS STRING RETURN concat_ws('-', {cuts})")
    whole = "concat(trim(x), CASE length(trim(x)) WHEN 4 THEN '-01-01' WHEN 7 THEN '-01' ELSE '' END)"
    day = f"CASE WHEN trim(x) RLIKE '^[0-9]{{4}}(-[0-9]{{2}}){{0,2}}$' AND left(trim(x), 4) >= '0001' THEN try_to_date({whole}, 'yyyy-MM-dd') END"
    last = f"CASE length(trim(x)) WHEN 4 THEN last_day(add_months({day}, 11)) WHEN 7 THEN last_day({day}) ELSE {day} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_temporal(x STRING) RETURNS STRUCT<lo: DATE, hi: DATE> RETURN CASE WHEN {day} IS NOT NULL THEN named_struct('lo', {day}, 'hi', {last}) END")
