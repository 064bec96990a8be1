"""The labels most similar to a text by Jaro-Winkler: an exact filter-and-verify join over blocks of labels.

Labels of one length class with like characters are put into blocks. A block has a summary:
its shortest and longest length, the most of each class of characters in one label, and
which characters its labels begin with. From that follows an upper bound of the similarity
of any of its labels to a text. Summaries are at most about MOST_BLOCKS rows whatever the
number of labels, as blocks grow beyond BLOCK where there are more.

1. Each text visits the FIRST blocks with the highest bounds. The k-th best similarity
   found there is a floor for all that follows.
2. Each text visits all other blocks whose bound reaches its floor, and no others.
3. The best k of both rounds are the best of all labels.

Visits meet blocks in groups of at most about VISITS texts, so a block that all texts visit
is dealt out; within a group labels are taken in the order of their own bounds until none of
the rest can be among the best. Taxonomies of at most HELD_BYTES (measured) are broadcast
instead and compared in the same manner.
"""

from __future__ import annotations

import bisect
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import PREFIX, PREFIX_WEIGHT, jaro_winkler_of
from ..runtime import written

MOST_RESULTS = 25
#: Largest taxonomy that goes to every task as it is.
HELD_BYTES = 4 << 20
BLOCK, MOST_BLOCKS, FIRST, VISITS = 1024, 16_384, 2, 2048
#: A text asked for by over a HOT-th of all products is salted; there are at most HOT of them.
HOT, SALTS = 1024, 64
#: Classes that characters are counted in. Equal characters agree in their class, so the common part of two counts is at least the number of matches.
FOLD = 64
#: More than rounding to four places adds.
SLACK = 1e-4


def _folded(text: str | None) -> str:
    return (text or "").lower().strip()


def _count(text: str) -> np.ndarray:
    return np.bincount(np.array([ord(c) % FOLD for c in text], dtype=np.int64), minlength=FOLD)


def _head(text: str, missing: int) -> list[int]:
    return [ord(c) for c in text[:PREFIX]] + [missing] * (PREFIX - len(text))


def _raised(jaro: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return jaro + prefix * PREFIX_WEIGHT * (1 - jaro)


class Labels:
    """Labels (iri, label) with what bounds their similarity from above: length, first characters and counts of characters."""

    def __init__(self, nodes: list[tuple[str | None, str | None]]):
        self.nodes = [(iri, _folded(label)) for iri, label in nodes]
        self.counts = np.array([_count(label) for _, label in self.nodes], dtype=np.int32).reshape(-1, FOLD)
        self.heads = np.array([_head(label, -1) for _, label in self.nodes], dtype=np.int64).reshape(-1, PREFIX)
        self.sizes = np.array([len(label) for _, label in self.nodes], dtype=np.int64)

    def bounds(self, query: str) -> np.ndarray:
        if not query:
            return (self.sizes == 0).astype(float)
        common = np.minimum(self.counts, _count(query)).sum(axis=1)
        jaro = (common / len(query) + common / np.maximum(self.sizes, 1) + 1) / 3
        prefix = np.cumprod(self.heads == _head(query, -2), axis=1).sum(axis=1)
        return np.where(common > 0, _raised(jaro, prefix), 0.0)

    def best(self, query: str | None, k: int, least: float) -> list[tuple[str | None, float]]:
        query = _folded(query)
        bounds = self.bounds(query)
        found: list[tuple] = []
        for i in np.argsort(-bounds, kind="stable"):
            iri, label = self.nodes[i]
            if bounds[i] + SLACK < (-found[k - 1][0] if len(found) >= k else least):
                break
            score = float(Decimal(repr(jaro_winkler_of(query, label))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
            if score >= least:
                bisect.insort(found, (-score, iri is not None, iri or ""))
                del found[k:]
        return [(iri if named else None, -score) for score, named, iri in found]


class Summaries:
    """What bounds the similarity of every label of a block."""

    def __init__(self, rows: list[tuple]):
        """rows: block, shortest, longest, counts (FOLD) and begins (PREFIX masks of character classes); a block may have several."""
        merged: dict[int, tuple] = {}
        for block, low, high, counts, begins in rows:
            counts, begins = np.array(counts, np.int32), np.array(begins, np.int64)
            if block in merged:
                a, b, c, d = merged[block]
                low, high, counts, begins = min(a, low), max(b, high), np.maximum(c, counts), d | begins
            merged[block] = low, high, counts, begins
        self.blocks = np.array(list(merged), np.int64)
        self.low, self.high = (np.array([m[i] for m in merged.values()], np.int64) for i in (0, 1))
        self.counts = np.array([m[2] for m in merged.values()], np.int32).reshape(-1, FOLD)
        self.begins = np.array([m[3] for m in merged.values()], np.int64).reshape(-1, PREFIX)

    @staticmethod
    def of(labels: Labels, block: int) -> tuple:
        begins = [int(np.bitwise_or.reduce(np.where(labels.heads[:, j] < 0, 0, np.left_shift(np.int64(1), labels.heads[:, j] % FOLD)))) for j in range(PREFIX)]
        return block, int(labels.sizes.min()), int(labels.sizes.max()), labels.counts.max(axis=0).tolist(), begins

    def bounds(self, query: str) -> np.ndarray:
        """An upper bound for each block of the similarity of its labels to a folded text."""
        if not query:
            return (self.low == 0).astype(float)
        common = np.minimum(np.minimum(self.counts, _count(query)).sum(axis=1), self.high)
        jaro = (common / len(query) + np.minimum(1.0, common / np.maximum(self.low, 1)) + 1) / 3
        head = np.array([ord(c) % FOLD for c in query[:PREFIX]], np.int64)
        prefix = np.cumprod((self.begins[:, : len(head)] >> head) & 1, axis=1).sum(axis=1)
        return np.where(common > 0, _raised(jaro, prefix), 0.0)


def _blocks(nodes: DataFrame, k: int, block: int) -> DataFrame:
    """block, label and iris of each different label: the first k of its nodes, which are all that can be among the best k."""
    named = nodes.select("iri", F.coalesce("label", F.lit("")).alias("label"))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("iri"))).filter(F.col("n") <= k)
    # an array leaves nulls out, so each iri is in a struct of its own
    labels = first.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("iri"))).alias("iris"))
    like = F.array_join(F.array_sort(F.split(F.substring(F.lower("label"), 1, 64), "")), "")
    keyed = labels.withColumns({"class": F.floor(F.length("label") / 4), "like": like})
    ordered = keyed.repartitionByRange("class", "like").sortWithinPartitions("class", "like")
    placed = written(ordered.select("label", "iris", F.monotonically_increasing_id().alias("place")), "labels")
    size = max(block, -(-placed.count() // MOST_BLOCKS))
    part = F.shiftright("place", 33)
    inside = F.floor((F.col("place") - F.shiftleft(part, 33)) / size)
    return placed.select((F.shiftleft(part, 33) + inside).cast("bigint").alias("block"), "label", "iris")


def _summaries(blocks: DataFrame) -> Summaries:
    def run(frames):
        held, own = [], None
        for frame in frames:
            for block, label in frame.itertuples(index=False):
                if held and block != own:
                    yield row(held, own)
                    held = []
                held.append((None, label))
                own = block
        if held:
            yield row(held, own)

    def row(held, own):
        return pd.DataFrame([Summaries.of(Labels(held), own)], columns=["block", "low", "high", "counts", "begins"])

    found = blocks.select("block", "label").mapInPandas(run, "block bigint, low bigint, high bigint, counts array<int>, begins array<bigint>")
    return Summaries([tuple(r) for r in found.collect()])  # one row a block, and one more for each task that starts within one


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores: few bytes are much work here, so the sizes that adaptive execution goes by would leave it to few tasks."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _visits(asked: DataFrame, shared, first: bool) -> DataFrame:
    """id, query, floor and block of the visits of a round; asked: id, query and floor."""
    def run(frames):
        known: Summaries = shared.value
        for frame in frames:
            out = []
            for number, query, floor in frame[["id", "query", "floor"]].itertuples(index=False):
                bounds = known.bounds(_folded(query))
                ranked = np.argsort(-bounds, kind="stable")
                chosen = ranked[:FIRST] if first else ranked[FIRST:]
                out += [(number, query, floor, int(b)) for b in known.blocks[chosen[bounds[chosen] + SLACK >= floor]]]
            yield pd.DataFrame(out, columns=["id", "query", "floor", "block"])

    return _spread(asked.select("id", "query", "floor"), "id").mapInPandas(run, "id bigint, query string, floor double, block bigint")


def _searched(visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """id, iri and similarity of the best k of each visit that reach its floor."""
    visits = written(visits, "visits")
    parts = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("parts"))  # a row a block
    parts = F.broadcast(parts)
    asking = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(texts: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(labels):
            return pd.DataFrame([], columns=["id", "iri", "similarity"])
        known = Labels([(iri["iri"], label) for label, iris in zip(labels["label"], labels["iris"]) for iri in iris])
        rows = [(number, iri, score) for number, query, floor in texts[["id", "query", "floor"]].itertuples(index=False) for iri, score in known.best(query, k, floor)]
        return pd.DataFrame(rows, columns=["id", "iri", "similarity"])

    asking, asked = (_spread(side, "block", "part") for side in (asking, asked))
    return asking.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(run, "id bigint, iri string, similarity double")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), F.asc("iri"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _by_blocks(products: DataFrame, nodes: DataFrame, k: int, least: float, block: int) -> DataFrame:
    blocks = _blocks(nodes, k, block)
    shared = products.sparkSession.sparkContext.broadcast(_summaries(blocks))
    rows = products.select("product", F.coalesce("query", F.lit("")).alias("query"))
    counts = written(rows.groupBy("query").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "texts")
    asked = counts.withColumn("floor", F.lit(least).cast("double"))
    early = written(_first(_searched(_visits(asked, shared, True), blocks, k), k), "near")
    floors = early.filter(F.col("rank") == k).select("id", F.col("similarity").alias("reached"))
    later = asked.join(floors, "id", "left").withColumn("floor", F.coalesce("reached", "floor"))
    late = _searched(_visits(later, shared, False), blocks, k)
    best = written(_first(early.drop("rank").unionByName(late), k), "near")
    listed = best.groupBy("id").agg(F.collect_list(F.struct("iri", "similarity", "rank")).alias("best"))  # k at most
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > max(total / HOT, 1000)).select(F.xxhash64("query").alias("h")).distinct()  # HOT at most
    salted = lambda df, salt: df.withColumn("h", F.xxhash64("query")).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "h", "left").withColumn("salt", salt).drop("h", "hot")
    own = salted(rows, F.when(F.col("hot"), F.pmod(F.xxhash64("product") + F.spark_partition_id(), F.lit(SALTS)).cast("int")).otherwise(0))
    answers = counts.join(listed, "id").select("query", "best")
    answers = salted(answers, F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return own.join(answers, ["query", "salt"]).select("product", F.inline("best")).select("product", "iri", "similarity", "rank")


def _in_tasks(products: DataFrame, nodes: DataFrame, k: int, least: float) -> DataFrame:
    shared = products.sparkSession.sparkContext.broadcast([tuple(r) for r in nodes.collect()])  # HELD_BYTES at most

    def run(frames):
        labels = Labels(shared.value)
        for frame in frames:
            rows = [(product, iri, score, rank) for product, query in frame[["product", "query"]].itertuples(index=False) for rank, (iri, score) in enumerate(labels.best(query, k, least), 1)]
            yield pd.DataFrame(rows, columns=["product", "iri", "similarity", "rank"])

    kind = products.schema["product"].dataType.simpleString()
    return products.mapInPandas(run, f"product {kind}, iri string, similarity double, rank int")


def nearest(products: DataFrame, nodes: DataFrame, k: int = 10, min_similarity: float = 0.0, held_bytes: int = HELD_BYTES, block: int = BLOCK) -> DataFrame:
    """product, iri, similarity and rank of the k nodes most similar to each product, without a row per pair.

    products: product, query. nodes: iri, label. The similarity is Jaro-Winkler at four
    places, equal ones are ordered by iri, a null one first. The result is that of comparing
    all, for any number of nodes. A null text is empty; a repeated product has its nodes once
    for each row, a repeated node counts each time; without nodes there are no rows.
    """
    k = max(1, min(k, MOST_RESULTS))
    products, nodes = products.select("product", "query"), nodes.select("iri", "label")
    size = nodes.agg(F.sum(F.coalesce(F.octet_length("iri"), F.lit(0)) + F.coalesce(F.octet_length("label"), F.lit(0)) + 512)).first()[0] or 0
    if size == 0 or size <= held_bytes:
        return _in_tasks(products, nodes, k, min_similarity)
    return _by_blocks(products, nodes, k, min_similarity, block)
