"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions. A decision's context is the decisions before it in
the same byte and up to DEPTH bytes before; for each of the 255 decisions the contexts
form a tree. A node estimates with Krichevsky-Trofimov counts, and a node's weighted
probability is half its own estimate and half the product of its children's, so that all
depths are mixed by what the corpus says for them. Trees are built bottom-up over exact
counts of all training texts, one aggregation per depth.

For scoring every byte of every text that is to be scored has a leaf in the trees, with
counts of zero where the corpus never saw it, so that one pass down from the root gives
each node the mixed probability of a path that ends there: a path ends at the first depth
that the corpus never saw, and a node that it never saw has its parent's value. A node
joins with its parent only, which has at most 256 children, so no join has a hot key.
A text's score is log10 of the probability of its bytes, with A-Z lower-cased, and of one
end mark. Keys (a byte in its context) of at least one 2**-HOT of all bytes, 2**HOT of
them at most, are looked up in a broadcast table; the others are joined by the key itself.

The base score beside it is a smoothed unigram model over words. Words of at least one
2**-HEAVY of all tokens (2**HEAVY of them at most) are looked up in a broadcast table; the
others are joined by a 64-bit hash.

Defined cases: null texts are empty and have the end token alone; a null id counts as
empty text where ids decide what is held out. Repeated rows count and score one by one.
Without training rows all estimates are even. Other columns are not read; an empty table
gives no rows.

The published method halves the weight once more at every depth that the corpus never saw
on the way, which spends probability on contexts that can't tell anything. published=True
scores that way; the default ends a path there, which is a distribution just the same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .bpe import pieces
from .simhash import LOWER

DEPTH = 5
HEAVY, HOT = 20, 22
PIECE = 1 << 20
#: Different keys that a counting task holds before it hands out what it has.
HELD = 1_000_000
#: A byte that UTF-8 never uses: the end mark, and what stands before a text.
MARK = b"\xff"
END_WORD = b" "
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of every byte of the texts and of their end marks, and where each text's keys start.

    A key is the byte and, from the next higher byte on, the DEPTH bytes before it, the
    latest first.
    """
    data = np.frombuffer(MARK * DEPTH + (MARK * DEPTH).join(texts) + MARK, np.uint8)
    wide = data.astype(_U)
    key = wide[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        key |= wide[DEPTH - back : len(wide) - back] << _U(8 * back)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = sizes.cumsum() - sizes
    padded = starts + np.arange(len(texts)) * (DEPTH - 1)
    own = np.ones(len(key), bool)
    for i in range(1, DEPTH):
        own[padded[1:] - i] = False
    return key[own], starts


class _Tally:
    """Counts of keys of one kind. A task holds HELD of them and a part at most, and then hands them out; Spark adds the parts up."""

    def __init__(self, kind: int):
        self.kind, self.key, self.n = kind, np.zeros(0, _U), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, n: np.ndarray):
        both, counts = np.concatenate([self.key, key]), np.concatenate([self.n, n])
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        self.key, self.n = both[first], np.add.reduceat(counts[order], first) if len(both) else counts
        if len(self.key) > HELD:
            yield from self.flush()

    def flush(self):
        for i in range(0, len(self.key), 1 << 18):
            part = self.key[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), self.kind, np.int32)), pa.array(part.view(np.int64)), pa.array(self.n[i : i + (1 << 18)])], ["kind", "key", "n"])
        self.key, self.n = np.zeros(0, _U), np.zeros(0, np.int64)


def _hashes(words) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], _U)


def count(docs: DataFrame, words: bool = True) -> DataFrame:
    """kind (0: bytes in context, 1: words by hash, unless left out), key and n over all texts of docs."""
    def run(batches):
        from collections import Counter

        grams, tally, own = _Tally(0), _Tally(1), Counter()
        for batch in batches:
            for _, texts in pieces(batch, "text", PIECE):
                low = [(t or "").encode().translate(LOWER) for t in texts]
                yield from grams.add(*np.unique(keys(low)[0], return_counts=True))
                if not words:
                    continue
                for t in low:
                    own.update(t.split())
                own[END_WORD] += len(low)
                if len(own) > HELD // 10:
                    yield from tally.add(_hashes(own), np.array(list(own.values()), np.int64))
                    own.clear()
        yield from tally.add(_hashes(own), np.array(list(own.values()), np.int64))
        yield from grams.flush()
        yield from tally.flush()

    rows = docs.select("text").mapInArrow(run, "kind int, key bigint, n bigint")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series at x + 7."""
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    shift = F.ln(x * (x + 1) * (x + 2) * (x + 3)) + F.ln((x + 4) * (x + 5) * (x + 6))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _kt(n0: Column, n1: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    a, b = n0.cast("double"), n1.cast("double")
    return F.when(a + b == 0, 0.0).otherwise(_lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi))


def trees(grams: DataFrame) -> list[DataFrame]:
    """Per depth, node, n0, n1 and weight: what a node's own estimate counts against its children's.

    A node is its context bytes above the decisions taken in the byte, led by a 1. The last
    level also has asked0 and asked1: how often texts to be scored take each way there
    (column asked of grams; n if there is none). Nodes that are only asked for count nothing.
    """
    asked = F.col("asked" if "asked" in grams.columns else "n").alias("asked")
    byte, context = F.col("key").bitwiseAND(255), F.shiftleft(F.shiftright("key", 8), 8)
    steps = [
        F.struct(
            context.bitwiseOR(F.shiftright(byte, 8 - j).bitwiseOR(1 << j)).alias("node"),
            F.shiftright(byte, 7 - j).bitwiseAND(1).alias("bit"),
        )
        for j in range(8)
    ]
    each = grams.select(F.explode(F.array(*steps)).alias("s"), "n", asked).select("s.node", "s.bit", "n", "asked")
    counts = each.groupBy("node").agg(*(F.sum(F.when(F.col("bit") == bit, F.col(c)).otherwise(0)).alias(f"{to}{bit}") for c, to in (("n", "n"), ("asked", "asked")) for bit in (0, 1)))
    level = written(counts.withColumn("log_p", _kt(F.col("n0"), F.col("n1"))).withColumn("weight", F.lit(1.0)), "tree")
    out = [level]
    for depth in range(DEPTH - 1, -1, -1):
        above = F.col("node").bitwiseAND((1 << (8 * depth + 8)) - 1).alias("node")
        joined = level.groupBy(above).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_p").alias("below"))
        own = joined.withColumn("own", _kt(F.col("n0"), F.col("n1")))
        more = F.greatest("own", "below")
        mixed = more + F.ln(F.exp(F.col("own") - more) + F.exp(F.col("below") - more)) - math.log(2)
        weight = 1 / (1 + F.exp(F.least(F.lit(700.0), F.col("below") - F.col("own"))))
        level = written(own.select("node", "n0", "n1", mixed.alias("log_p"), weight.alias("weight")), "tree")
        out.append(level)
    return out[::-1]


def fold(levels: list[DataFrame], published: bool = False) -> list[DataFrame]:
    """Per depth, node and p: the mixed probability of a one if the path ends at the node.

    With base and keep the mixture over depths 0 to d is base + keep * own estimate at d.
    A node that the corpus never saw has the value of the path's last seen node, or, as
    published, the mixture that goes on with an even estimate.
    """
    n = F.col("n0") + F.col("n1")
    own, seen = (F.col("n1") + 0.5) / (n + 1), n > 0
    out = []
    for depth, level in enumerate(levels):
        if depth:
            above = F.col("node").bitwiseAND((1 << (8 * depth)) - 1).alias("parent")
            taken = out[-1].select(F.col("node").alias("parent"), F.col("p").alias("up"), F.col("base").alias("more"), F.col("keep").alias("left"))
            rows = level.withColumn("parent", above).join(taken, "parent")
        else:
            rows = level.select("*", F.lit(0.5).alias("up"), F.lit(0.0).alias("more"), F.lit(1.0).alias("left"))
        p = F.when(seen, F.col("more") + F.col("left") * own).otherwise(F.col("more") + F.col("left") * 0.5 if published else F.col("up"))
        base, keep = F.col("more") + F.col("left") * F.col("weight") * own, F.col("left") * (1 - F.col("weight"))
        extra = [c for c in ("asked0", "asked1") if c in level.columns]
        out.append(rows.select("node", p.alias("p"), base.alias("base"), keep.alias("keep"), *extra))
    return out


def key_scores(leaves: DataFrame) -> DataFrame:
    """key, n and log_p (log10 of the byte's probability in its context) of every key asked for."""
    def run(batches):
        for batch in batches:
            nodes, context = batch.column("nodes"), batch.column("context").to_numpy()
            flat, row = nodes.flatten(), np.repeat(np.arange(len(context)), nodes.value_lengths().to_numpy(zero_copy_only=False))
            prefix, p = flat.field("prefix").to_numpy(), flat.field("p").to_numpy()
            table = np.full((len(context), 256), 0.5)
            table[row, prefix] = p
            for bit in (0, 1):
                n = flat.field(f"asked{bit}").to_numpy()
                at = np.flatnonzero((prefix >= 128) & (n > 0))
                byte, log_p = (prefix[at] << 1 & 255) | bit, np.zeros(len(at))
                for j in range(8):
                    one = table[row[at], byte >> (8 - j) | 1 << j]
                    log_p += np.log10(np.where(byte >> (7 - j) & 1, one, 1 - one))
                yield pa.RecordBatch.from_arrays([pa.array(context[row[at]] | byte), pa.array(n[at]), pa.array(log_p)], ["key", "n", "log_p"])

    node = F.col("node")
    entry = F.struct(node.bitwiseAND(255).alias("prefix"), "p", "asked0", "asked1")
    grouped = leaves.groupBy(node.bitwiseAND(-256).alias("context")).agg(F.collect_list(entry).alias("nodes"))  # 255 nodes at most
    return grouped.mapInArrow(run, "key bigint, n bigint, log_p double")


def log10_bytes(key: np.ndarray, tables: list[DataFrame]) -> np.ndarray:
    """log10 of the mixed probability of each key's byte in its context, for a few keys that may be unknown to the tables."""
    spark, byte, context = tables[0].sparkSession, key & _U(255), key >> _U(8)
    prefix = np.array([byte >> _U(8 - j) | _U(1 << j) for j in range(8)])
    one = np.array([byte >> _U(7 - j) & _U(1) for j in range(8)]).astype(bool)
    mixed = np.full(prefix.shape, 0.5)
    for depth, table in enumerate(tables):
        node = (context & _U((1 << (8 * depth)) - 1)) << _U(8) | prefix
        asked = spark.createDataFrame([(int(x),) for x in np.unique(node)], "node bigint")
        found = {r["node"]: r["p"] for r in table.join(F.broadcast(asked), "node").select("node", "p").collect()}
        mixed = np.array([[found.get(int(x), m) for x, m in zip(*pair)] for pair in zip(node, mixed)])
    return np.log10(np.where(one, mixed, 1 - mixed)).sum(axis=0)


class Hot:
    """Positions of keys among the hot ones, which come with the most frequent first."""

    def __init__(self, hot: np.ndarray):
        self.hot, self.order = hot, np.argsort(hot)
        self.first = np.zeros(1 << HOT, np.int32)
        self.first[self.at(hot[::-1])] = np.arange(len(hot), dtype=np.int32)[::-1]

    @staticmethod
    def at(key: np.ndarray) -> np.ndarray:
        return ((key * _U(0x9E3779B97F4A7C15)) >> _U(64 - HOT)).astype(np.int64) if HOT else np.zeros(len(key), np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it is not hot."""
        if not len(self.hot):
            return np.full(len(key), -1, np.int32)
        out = self.first[self.at(key)]
        missed = np.flatnonzero(self.hot[out] != key)
        near = np.minimum(np.searchsorted(self.hot, key[missed], sorter=self.order), len(self.hot) - 1)
        place = self.order[near]
        out[missed] = np.where(self.hot[place] == key[missed], place, -1)
        return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", published: bool = False) -> DataFrame:
    """Per row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes (with the end mark), bits_per_byte; rows where train holds are learnt from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    counts = written(count(rows.filter("train")), "corpus_counts")
    words = counts.filter("kind = 1").select(F.col("key").alias("word"), F.col("n").alias("c"))
    whole = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_train, types = whole
    common = words.filter(F.col("c") * (1 << HEAVY) >= n_train).toArrow()  # at most 2**HEAVY words have so large a share
    order = np.argsort(common["word"].to_numpy().view(_U))
    heavy = spark.sparkContext.broadcast((common["word"].to_numpy().view(_U)[order], common["c"].to_numpy()[order]))
    learnt = counts.filter("kind = 0").select("key", "n", F.col("n").alias("asked"))
    others = count(rows.filter(~F.coalesce("train", F.lit(False))), words=False).select("key", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("asked"))
    grams = learnt.unionByName(others).groupBy("key").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    known = written(key_scores(fold(trees(grams), published)[-1]), "key_scores")
    n_bytes = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * (1 << HOT) >= n_bytes
    top = known.filter(is_hot).toArrow()  # at most 2**HOT keys have so large a share
    order = np.argsort(-top["n"].to_numpy(), kind="stable")
    hot = spark.sparkContext.broadcast((top["key"].to_numpy().view(_U)[order], top["log_p"].to_numpy()[order]))
    del top

    def run(batches):
        from collections import Counter

        (hot_keys, hot_logs), (hashes, c) = hot.value, heavy.value
        lookup = Hot(hot_keys)
        logs, part_id, number = np.log10(c + 0.1), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, texts in pieces(batch, "text", PIECE):
                low = [(t or "").encode().translate(LOWER) for t in texts]
                key, begins = keys(low)
                place = lookup.find(key)
                is_rare = place < 0
                scores = np.add.reduceat(np.where(is_rare, 0.0, hot_logs[place]) if len(hot_keys) else np.zeros(len(key)), begins)
                ends = np.concatenate([[0], np.add.reduceat(is_rare.astype(np.int64), begins).cumsum()]).astype(np.int32)
                rare_keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[is_rare].view(np.int64)))
                met = [Counter(t.split()) for t in low]
                for m in met:
                    m[END_WORD] = 1
                sizes = np.array([len(m) for m in met])
                starts = sizes.cumsum() - sizes
                word = _hashes(w for m in met for w in m)
                times = np.fromiter((n for m in met for n in m.values()), np.int64, len(word))
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
                    is_heavy = hashes[at] == word
                    base, known = np.where(is_heavy, times * logs[at], 0.0), np.where(is_heavy, times, 0)
                else:
                    is_heavy, base, known = np.zeros(len(word), bool), np.zeros(len(word)), np.zeros(len(word), np.int64)
                rare = np.repeat(word.view(np.int64), np.where(is_heavy, 0, times))
                lengths = np.add.reduceat(np.where(is_heavy, 0, times), starts)
                offsets = np.concatenate([[0], lengths.cumsum()]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare))
                row = (part_id << 40) + number + np.arange(len(low))
                number += len(low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), part.column("doc_id"), part.column("train"), pa.array(np.add.reduceat(times, starts)), pa.array(np.add.reduceat(known, starts)), pa.array(np.add.reduceat(base, starts)), pa.array(scores), pa.array([len(t) + 1 for t in low], pa.int64()), lists, rare_keys],
                    ["row", "doc_id", "train", "n_tokens", "known", "base", "score", "n_bytes", "rare", "rare_keys"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = written(rows.mapInArrow(run, f"row bigint, doc_id {kind}, train boolean, n_tokens bigint, known bigint, base double, score double, n_bytes bigint, rare array<bigint>, rare_keys array<bigint>"), "scored")
    light = words.filter(F.col("c") * (1 << HEAVY) < n_train)
    met = scored.select("row", F.explode("rare").alias("word")).join(light, "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    sums = met.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.1)).alias("rest"), F.sum((F.col("c") > 0).cast("bigint")).alias("more"))
    read = scored.select("row", F.explode("rare_keys").alias("key")).join(known.filter(~is_hot).select("key", "log_p"), "key")
    bits = read.groupBy("row").agg(F.sum("log_p").alias("log_p"))
    total = F.col("score") + F.coalesce("log_p", F.lit(0.0))
    out = scored.drop("rare", "rare_keys").join(sums, "row", "left").join(bits, "row", "left")
    return out.select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * math.log10(n_train + 0.1 * (types + 1))).alias("base_score"),
        total.alias("score"),
        "n_bytes",
        (-total / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
