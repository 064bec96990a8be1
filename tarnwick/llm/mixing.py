"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Every source is cut into blocks by a seeded hash of its rows, 64 rows to
a block and BLOCKS blocks at most. A source's quota is the number of blocks, in a permuted
order and once more in another one where its target is above its size, that reach its
target; the last of them is taken in part. A tree splits the quotas of all sources among
the output shards: at each node the shards are halved, and the numbers of blocks that each
source sends to the left half are drawn from the multivariate hypergeometric distribution.
Each leaf then draws its count of the source's permuted blocks, next to those of the leaf
before it, so every drawn block goes to exactly one shard and every shard holds a random
mixture. What is taken of a row is the number of leaves that drew its block. Each shard is
shuffled by itself.

The tree's first levels split whole chunks of CHUNK sources, on the driver; below them each
chunk is split in its own task. The driver sees one row for each chunk and for each
partition of the sources, and sums. Sources are numbered, weighed and given their targets by DataFrame
operations, so any number of them will do; numpy draws where all blocks are below LIMIT,
above it draw() does, by inversion over all values within SPAN standard deviations of the
mode, so totals have no limit either. A window holds the blocks of one source, which
are twice BLOCKS at most. All rows of a part-taken block, a BLOCKS-th of its source, are
looked at in one task.

Defined cases: a null text has size 0, a null source is a source of its own and the last.
Sources of size 0 have target 0. Sources of any type are ordered as Spark orders them.
Repeated rows (same id, same text) are taken alike, so the last block may miss the target
by more where they weigh much. Other columns, whatever their names, come through mix() as
they are. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import written

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
BLOCK_ROWS, BLOCKS, CHUNK, SHARDS = 64, 4096, 4096, 64
#: Rows that end a part-taken block by a subset sum, and the sum's finest unit as a part of what is left.
EXACT, FINEST = 64, 1 << 20
#: Parts in which the rows of one shard are written, so that a shard may be of any size.
PARTS = 1024
SEED = 20240229
#: numpy's hypergeometric draws take totals below this.
LIMIT = 10**9
#: Standard deviations around the mode that draw() looks at; less than one draw in 10**18 would lie outside.
SPAN = 9


def words(text: Column) -> Column:
    """The number of runs of characters other than x20 and x09 to x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def even(total: int, shards: int) -> list[int]:
    """total shared out evenly, halving the shards."""
    if shards == 1:
        return [total]
    left = round(total * (shards // 2) / shards)
    return even(left, shards // 2) + even(total - left, shards - shards // 2)


def draw(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of n drawn from good + bad are good, for any total.

    Chances come from the ratios of neighbours, so no logarithm of a factorial of a huge
    number loses their digits. Memory grows with the standard deviation, which is below
    half the root of the smallest of good, bad, n and the rest.
    """
    if good + bad < LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    low, high, total = max(0, n - bad), min(good, n), good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    sd = (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    reach = int(SPAN * sd) + 64  # far more than the tails need where the mean is small
    first = max(low, mode - reach)
    k = np.arange(first, min(high, mode + reach), dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1) * ((n - k) / (bad - n + k + 1))))])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def halve(quotas: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n blocks drawn without replacement from the quotas of all sources: how many of each."""
    rest = int(quotas.sum())
    if rest < LIMIT:
        return rng.multivariate_hypergeometric(quotas, n, method="marginals")
    out = np.zeros_like(quotas)
    for i, quota in enumerate(quotas.tolist()):
        rest -= quota
        out[i] = draw(quota, rest, n, rng)
        n -= int(out[i])
    return out


def deal(quotas: np.ndarray, totals: list[int], rng: np.random.Generator) -> list[np.ndarray]:
    """Blocks of each source for each shard; the sums over shards are the quotas, those over sources the totals."""
    if len(totals) == 1:
        return [quotas]
    half = len(totals) // 2
    left = halve(quotas, int(sum(totals[:half])), rng)
    return deal(left, totals[:half], rng) + deal(quotas - left, totals[half:], rng)


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """deal() to shards of even totals."""
    return deal(quotas, even(int(quotas.sum()), shards), rng)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size and a hash that tells rows apart unless they are equal."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text).alias("size"), F.xxhash64(F.lit(SEED), F.col(id_col), text).alias("hash")
    )


def numbered(sources: DataFrame) -> DataFrame:
    """sources with s, a source's place by code point, null last, without one task sorting all."""
    held = written(sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(held.groupBy(part.alias("part")).count().collect())  # one row for each partition
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    firsts = held.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, starts)], "part bigint, start bigint")
    return held.withColumn("part", part).join(F.broadcast(firsts), "part").withColumn("s", F.col("start") + place).drop("part", "start", "at")


def targeted(sources: DataFrame, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """sources (s, size) with target: share of all sizes by weight, where what a source would get above repeats times its size goes to the others by weight.

    A source gets unit * weight words or is full. The unit grows, by one sum over all
    sources a step, until no more sources are full; these are Newton's steps on a function
    of straight pieces, so there are few of them.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    weighed, most = sources.withColumn("weight", weight), F.col("size") * float(repeats)
    total, unit = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], 0.0
    while True:
        full = most < F.col("weight") * unit
        given, free = weighed.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            return weighed.withColumn("target", most)
        new = (share * total - given) / free
        if new <= unit:
            return weighed.withColumn("target", F.when(full, most).otherwise(F.col("weight") * unit))
        unit = new


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, hash, size, source_size, target, copies and the shards of the copies."""
    rows = written(sized(docs, id_col, text_col, source_col), "sizes")
    sources = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "sources")
    blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("n") / BLOCK_ROWS)))
    named = written(targeted(numbered(sources)).select(F.col("source").alias("name"), "s", F.col("size").alias("source_size"), "target", blocks.alias("blocks")), "targets")
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "hash", "size", "source_size", "target", "s", F.expr("cast(pmod(hash, blocks) AS int)").alias("block"))
    totals = placed.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    plan = written(_leaves(written(_quotas(totals), "drawn"), shards), "plan")
    at = placed.join(plan, ["s", "block"], "left").withColumn("full", F.coalesce("full", F.lit(0)))
    whole = at.filter("rest IS NULL").withColumn("copies", F.col("full"))
    part = at.filter("rest IS NOT NULL")
    partly = part.groupBy("s", "block").applyInPandas(_fill, part.withColumn("copies", F.lit(0)).schema)
    return whole.unionByName(partly).select("doc_id", "hash", "size", "source_size", "target", "copies", F.col("to").alias("shards"))


def _quotas(totals: DataFrame) -> DataFrame:
    """s, block, pos (the draw's number within the source) and rest (the words wanted where the block is taken in part)."""
    each = totals.withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    order = Window.partitionBy("s").orderBy("again", F.xxhash64(F.lit(SEED), "again", "s", "block"), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("target") - before
    drawn = each.withColumn("left", left).withColumn("pos", F.row_number().over(order)).filter("left > 0.5")
    return drawn.select("s", "block", "pos", F.when(F.col("words") > F.col("left"), F.col("left")).alias("rest"))


def _leaves(drawn: DataFrame, shards: int) -> DataFrame:
    """s, block, full (how often it is taken whole), rest and to (the shards that drew it, a part-taken draw last)."""
    quotas = drawn.groupBy("s").agg(F.count(F.lit(1)).alias("quota")).withColumn("chunk", F.floor(F.col("s") / CHUNK))
    chunks = sorted(quotas.groupBy("chunk").agg(F.sum("quota")).collect())  # one row for CHUNK sources
    top = split(np.array([n for _, n in chunks], np.int64), shards, np.random.default_rng(SEED))
    shares = drawn.sparkSession.createDataFrame([(c, [int(leaf[i]) for leaf in top]) for i, (c, _) in enumerate(chunks)], "chunk bigint, totals array<bigint>")

    def below(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("s")
        rng = np.random.default_rng([SEED, int(own["chunk"].iloc[0])])
        leaves = deal(own["quota"].to_numpy(np.int64), own["totals"].iloc[0].tolist(), rng)
        return pd.DataFrame({"s": own["s"].to_numpy(), "ends": list(np.cumsum(leaves, axis=0).T)})

    tree = quotas.join(shares, "chunk").groupBy("chunk").applyInPandas(below, "s bigint, ends array<bigint>")
    leaf = F.size(F.filter("ends", lambda end: end < F.col("pos")))  # the leaves before the one that draws it
    dealt = drawn.join(tree, "s").withColumn("shard", leaf)
    to = F.transform(F.array_sort(F.collect_list(F.struct("pos", "shard"))), lambda x: x["shard"])  # REPEATS at most
    return dealt.groupBy("s", "block").agg(F.count_if(F.col("rest").isNull()).cast("int").alias("full"), F.max("rest").alias("rest"), to.alias("to"))


def _fill(block: pd.DataFrame) -> pd.DataFrame:
    """Largest rows first, each that still fits; among the last EXACT, the subset nearest to what is left. Equal rows are one."""
    unit = block.groupby(["doc_id", "hash"], dropna=False, sort=False).ngroup().to_numpy()
    own = pd.DataFrame({"unit": unit, "size": block["size"], "hash": block["hash"]}).groupby("unit").agg(size=("size", "sum"), hash=("hash", "first"))
    own = own.sort_values(["size", "hash"], ascending=[False, True], kind="stable")
    left, sizes, order = float(block["rest"].iloc[0]), own["size"].tolist(), own.index.to_numpy()
    taken, head = np.zeros(len(own), np.int32), max(0, len(sizes) - EXACT)
    for i in range(head):
        if 0 < sizes[i] <= left:
            taken[order[i]] = 1
            left -= sizes[i]
    for i in _nearest(sizes[head:], left):
        taken[order[head + i]] = 1
    return block.assign(copies=(block["full"].to_numpy() + taken[unit]).astype(np.int32))


def _nearest(sizes: list[int], left: float) -> list[int]:
    """Places of a subset whose sum comes nearest to left; the smaller of two equally near sums.

    Sums are counted in words, or in a FINEST-th of left where that is more, which bounds memory.
    """
    if left <= 0:
        return []
    unit = max(1.0, left / FINEST)
    if unit > 1:
        sizes, left = [round(size / unit) for size in sizes], left / unit
    mask, reach = (1 << (int(2 * left) + 2)) - 1, [1]  # bit k: a subset has the sum k
    for size in sizes:
        reach.append((reach[-1] | reach[-1] << size) & mask if size <= 2 * left + 1 else reach[-1])
    below = (reach[-1] & ((1 << (int(left) + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> (int(left) + 1)
    best = below
    if above:
        over = int(left) + (above & -above).bit_length()
        best = over if over - left < left - below else below
    out = []
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> best & 1:
            out.append(i)
            best -= sizes[i]
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """The mixture: the rows of docs as often as they are drawn, shard by shard, shuffled within."""
    drawn = draws(docs, id_col, text_col, source_col, shards).filter("copies > 0").select(F.col("doc_id").alias("__tw_id"), F.col("hash").alias("__tw_hash"), F.slice("shards", F.lit(1), F.col("copies")).alias("__tw_to")).dropDuplicates(["__tw_id", "__tw_hash"])
    keyed = docs.withColumn("__tw_key", F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)))
    on = (keyed["__tw_key"] == drawn["__tw_hash"]) & keyed[id_col].eqNullSafe(drawn["__tw_id"])
    rows = keyed.join(drawn, on).withColumn("__tw_shard", F.explode("__tw_to"))
    dealt = rows.withColumn("__tw_order", F.xxhash64(F.lit(SEED), "__tw_shard", "__tw_key")).withColumn("__tw_part", F.pmod("__tw_order", F.lit(PARTS)))
    return dealt.repartition("__tw_shard", "__tw_part").sortWithinPartitions("__tw_shard", "__tw_part", "__tw_order").select(*docs.columns)
