"""Phrase collocation mining: sketch upper bounds give candidates, guarded automata count them.

1. Sketches. Tasks hash every word into one of 2^bits cells and send counts by cell; a
   cell's sum over all tasks is an upper bound of the count of each word in it. Cells that
   reach LEAST become a bitmap. Pairs of words that are both marked are sketched likewise,
   then phrases of three and four words whose pairs are all marked. bits follows the size
   of the texts within MOST_BITS, so a bitmap has a fixed greatest size; a full one passes
   more candidates and changes no result.
2. Candidates. A further pass takes the different phrases whose cells all pass, as
   strings. No phrase that reaches LEAST can be missing: within a task phrases are told
   apart by 64 bits of hash and their length.
3. Counts. Candidates, with the words that are parts of them, are dealt into shards of at
   most SHARD phrases in the order of lang and phrase. Each shard is compiled into one
   pyahocorasick automaton for each lang, whose patterns have a space on both sides, as
   every word of the scanned text has; line ends between pieces keep matches within a
   piece. All texts of the shard's langs are scanned and all overlapping matches counted; the
   counts of all tasks are summed. Only these exact counts decide anything from here on.
4. Thresholds, cuts and the rule of longer candidates are joins and aggregations on lang and
   phrase; arithmetic on counts is done in decimals.

The work of step 3 is one pass over the texts for every SHARD candidates. A task holds a
segment of text, one shard's automata and the counts of its patterns.

Defined cases: a null text is empty, a null lang is und (and the same as it). Texts of any
length are read in segments of about SEGMENT bytes that overlap by three words within a piece;
a phrase counts where its last word lies, so none is lost or counted twice. A single longer
word is one segment. Repeated rows count each time; ids are not read. Ties in score go by
count, then by phrase in byte order. An empty table gives no rows. Other columns, whatever
their names, are not touched.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import written

LEAST, LONGEST, TOP = 30, 4, 2000
#: Percent of a phrase's count from which a longer phrase that holds it replaces it.
SHARE = 80
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
SHARD, SEGMENT, CHUNK = 200_000, 1 << 20, 1 << 22
LEAST_BITS, MOST_BITS = 16, 30
#: Tasks for each core in passes that give out every phrase once a task, and the most input partitions that one of them takes.
WAVES, MERGED = 2, 16
#: Rows of a lang are first ranked in so many parts.
PARTS = 64
#: Lower-cases A-Z; ends of pieces become line ends and tabs spaces.
NORMAL = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_SEED = np.random.default_rng(11)
_BYTES = _SEED.integers(0, 1 << 64, 256, dtype=_U)
#: Odd factors by place in a word (low part, high part of the place) and by place in a phrase.
_LOW, _HIGH, _PLACE = (_SEED.integers(0, 1 << 63, n, dtype=_U) * _U(2) + _U(1) for n in (4096, 4096, LONGEST))


def segments(text: str | None) -> Iterator[tuple[bytes, bytes]]:
    """Pairs (context, fresh) of a normalised text: what precedes in the piece (three words at most) and what is to be counted."""
    data, start, context = (text or "").encode().translate(NORMAL), 0, b""
    while start < len(data):
        end = start + SEGMENT
        if end >= len(data):
            end = len(data)
        else:
            end = max(data.rfind(b"\n", start, end), data.rfind(b" ", start, end))
            if end < 0:
                found = [p for p in (data.find(b"\n", start), data.find(b" ", start)) if p >= 0]
                end = min(found, default=len(data))
        fresh = data[start:end]
        yield context, fresh
        last = fresh.rpartition(b"\n")
        tail = last[2].split(b" ") if last[1] else [*context.split(b" "), *last[2].split(b" ")]
        context = b"" if data[end : end + 1] == b"\n" else b" ".join([w for w in tail if w][1 - LONGEST :])
        start = end + 1


class Words:
    """The words of normalised bytes: where they start and end, a hash of each, whether a piece begins at them, and whether they count."""

    def __init__(self, data: bytes, contexts: list[tuple[int, int]]):
        chars = np.frombuffer(data, np.uint8)
        space = np.empty(len(chars) + 2, bool)
        space[[0, -1]] = True
        np.less_equal(chars, 32, out=space[1:-1])
        space[1:-1] &= (chars == 32) | (chars == 10)
        self.starts = np.flatnonzero(space[:-2] & ~space[1:-1])
        self.ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
        breaks = np.flatnonzero(chars == 10)
        before = np.searchsorted(breaks, self.starts)
        self.first = np.r_[True, before[1:] != before[:-1]][: len(self.starts)]
        self.fresh = np.ones(len(self.starts), bool)
        for a, b in contexts:
            self.fresh[np.searchsorted(self.starts, a) : np.searchsorted(self.starts, b)] = False
        self.hashes = np.zeros(len(self.starts), _U)
        for at in range(0, len(chars), CHUNK // 4):
            self._hash(chars, at, min(at + CHUNK // 4, len(chars)))
        self.hashes ^= self.hashes >> _U(32)

    def _hash(self, chars: np.ndarray, start: int, end: int) -> None:
        """Add what the bytes from start to end give to the hashes of their words."""
        low, high = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.starts, end)
        if low >= high:
            return
        a, b = np.maximum(self.starts[low:high], start), np.minimum(self.ends[low:high], end)
        sizes = b - a
        offsets = np.r_[0, sizes.cumsum()[:-1]]
        inside = np.arange(sizes.sum()) - np.repeat(offsets, sizes)
        at, place = inside + np.repeat(a, sizes), inside + np.repeat(a - self.starts[low:high], sizes)
        values = _BYTES[chars[at]] * _LOW[place & 4095]
        far = place >= 4096
        if far.any():
            values[far] *= _HIGH[(place[far] >> 12) & 4095] + (place[far] >> 24).astype(_U)
        self.hashes[low:high] += np.add.reduceat(values, offsets)

    def phrases(self, n: int) -> np.ndarray:
        """Where phrases of n words within a piece begin whose last word counts."""
        size = max(0, len(self.starts) - n + 1)
        good = self.fresh[n - 1 :].copy()
        for k in range(1, n):
            good &= ~self.first[k : k + size]
        return np.flatnonzero(good)

    def hash(self, at: np.ndarray, n: int) -> np.ndarray:
        found = np.full(len(at), n, _U)
        for j in range(n):
            found += self.hashes[at + j] * _PLACE[j]
        found ^= found >> _U(29)
        found *= _U(0xBF58476D1CE4E5B9)
        return found ^ (found >> _U(32))


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64)


def _marked(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 6] >> (cells & 63).astype(_U)) & _U(1) == 1


def _passing(words: Words, n: int, size: int, marks: np.ndarray, bits: int) -> np.ndarray:
    """Where phrases of n words begin whose contiguous parts of size words are all marked."""
    at = words.phrases(n)
    for k in range(n - size + 1):
        at = at[_marked(marks, _cells(words.hash(at + k, size), bits))]
    return at


def _chunks(batches) -> Iterator[tuple[str, bytes, list[tuple[int, int]]]]:
    """lang, bytes and the ranges that do not count, of about CHUNK bytes of one lang at a time."""
    held: dict[str, list] = {}
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang")
        for i in range(batch.num_rows):
            lang = langs[i].as_py()
            own = held.setdefault(lang, [[], [], 0])
            for context, fresh in segments(texts[i].as_py()):
                if context:
                    own[1].append((own[2], own[2] + len(context)))
                    fresh = context + b" " + fresh
                own[0].append(fresh)
                own[2] += len(fresh) + 1
                if own[2] >= CHUNK:
                    yield lang, b"\n".join(own[0]), own[1]
                    own[:] = [[], [], 0]
            if len(held) > 64:  # rows of many langs: give out what is held
                for lang, (parts, contexts, _) in held.items():
                    yield lang, b"\n".join(parts), contexts
                held.clear()
    for lang, (parts, contexts, _) in held.items():
        yield lang, b"\n".join(parts), contexts


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def _gathered(texts: DataFrame) -> DataFrame:
    """texts in fewer, larger partitions: most tasks meet most phrases, so what they give out grows with their number."""
    n, cores = texts.rdd.getNumPartitions(), texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(max(WAVES * cores, -(-n // MERGED)))


def _lang_seed(lang: str) -> np.uint64:
    import xxhash

    return _U(xxhash.xxh64_intdigest(lang.encode()))


def sketch(texts: DataFrame, bits: int, sizes: tuple[int, ...], parts: int = 0, marks=None) -> DataFrame:
    """cell and total of the phrases of these sizes; with marks (broadcast), of those whose parts of so many words are all marked."""
    def run(batches):
        for lang, data, contexts in _chunks(batches):
            words, salt = Words(data, contexts), _lang_seed(lang)
            words.hashes ^= salt
            found = [words.hash(_passing(words, n, parts, marks.value, bits) if marks else words.phrases(n), n) for n in sizes]
            cells, counts = np.unique(np.concatenate([_cells(h, bits) for h in found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts.astype(np.int64))], ["cell", "total"])

    return texts.mapInArrow(run, "cell bigint, total bigint").groupBy("cell").agg(F.sum("total").alias("total"))


def bitmap(sketched: DataFrame, bits: int, least: int) -> np.ndarray:
    """The cells of a sketch that reach least, as 64-bit words; 2^bits / 8 bytes."""
    heavy = sketched.filter(F.col("total") >= least)
    packed = heavy.groupBy(F.expr("cell div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(cell % 64 AS INT)))").alias("mask")).toArrow()
    found = np.zeros(1 << (bits - 6), _U)
    found[packed["word"].to_numpy()] = packed["mask"].to_numpy().view(_U)
    return found


def _added(own: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of named are not in own (sorted, each once), and own with them; own is searched and not sorted again."""
    at = np.searchsorted(own, named)
    there = at < len(own)
    there[there] = own[at[there]] == named[there]
    new = np.unique(named[~there])
    return ~there, np.insert(own, np.searchsorted(own, new), new)


def candidates(texts: DataFrame, bits: int, pairs, longer) -> DataFrame:
    """lang and phrase (words joined by spaces), each once, of every phrase whose cells are all marked."""
    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for lang, data, contexts in _chunks(batches):
            words, salt = Words(data, contexts), _lang_seed(lang)
            words.hashes ^= salt
            own, out = seen.get(lang, np.zeros(0, _U)), []
            sizes = np.r_[0, (words.ends - words.starts).cumsum()]
            for n in range(2, LONGEST + 1):
                at = _passing(words, n, 2, pairs.value, bits)
                h = words.hash(at, n)
                if n > 2:
                    passed = _marked(longer.value, _cells(h, bits))
                    at, h = at[passed], h[passed]
                size = sizes[at + n] - sizes[at]
                kept, first, back = np.unique(h, return_index=True, return_inverse=True)
                clash = np.flatnonzero(size != size[first][back])  # another phrase of the same hash
                named = kept ^ (size[first].astype(_U) * _PLACE[0])
                fresh, own = _added(own, named)
                out += [(i, n) for i in (*at[first[fresh]].tolist(), *at[clash].tolist())]
            seen[lang] = own
            if sum(map(len, seen.values())) > 1 << 21:
                seen.clear()
            found = [" ".join(data[words.starts[i + j] : words.ends[i + j]].decode() for j in range(n)) for i, n in out]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], ["lang", "phrase"])

    return _gathered(texts).mapInArrow(run, "lang string, phrase string").distinct()


@functools.lru_cache(maxsize=1)
def _automata(shard: str) -> dict[str, tuple]:
    """The automata of one shard by lang; a worker process keeps those of its latest shard."""
    return {}


def _scanned(texts: DataFrame, shard) -> DataFrame:
    """lang, phrase and n of each pattern of a shard (broadcast: phrases by lang) in all texts."""
    name = uuid.uuid4().hex

    def run(batches):
        import ahocorasick

        made, counts, waiting = _automata(name), {}, {}

        def settle(lang: str) -> None:
            if waiting.get(lang):
                counts[lang] += np.bincount(waiting.pop(lang), minlength=len(counts[lang]))

        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            for i in range(batch.num_rows):
                lang = langs[i].as_py()
                if lang not in shard.value:
                    continue
                if lang not in made:
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    for k, phrase in enumerate(shard.value[lang]):
                        automaton.add_word(f" {phrase} ", k)
                    automaton.make_automaton()
                    made[lang] = automaton
                if lang not in counts:
                    counts[lang] = np.zeros(len(shard.value[lang]), np.int64)
                for context, fresh in segments(texts[i].as_py()):
                    guard = len(_guarded(context)) if context else 0
                    found = made[lang].iter(_guarded(context + b" " + fresh))
                    waiting.setdefault(lang, []).extend([k for end, k in found if end >= guard] if guard else [k for _, k in found])
                    if len(waiting[lang]) >= 1 << 18:
                        settle(lang)
        for lang, own in counts.items():
            settle(lang)
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([shard.value[lang][k] for k in some], pa.string()), pa.array(own[some])], ["lang", "phrase", "n"])

    return _gathered(texts).mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _guarded(data: bytes) -> str:
    """Words with one space on each side; line ends stand as words of their own."""
    words = data.replace(b"\n", b" \n ").split(b" ")
    return " " + b" ".join(filter(None, words)).decode() + " "


def shards(patterns: DataFrame, size: int) -> tuple[DataFrame, int]:
    """lang, phrase and shard, in order and with size phrases each but the last; and the number of shards."""
    ordered = patterns.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase")
    placed = written(ordered.select("lang", "phrase", F.monotonically_increasing_id().alias("place")), "patterns")
    part = F.shiftright("place", 33)
    held = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # a row for each task
    bases, total = [], 0
    for at, n in held:
        bases.append((at, total))
        total += n
    known = placed.sparkSession.createDataFrame(bases, "part bigint, base bigint")
    inside = F.col("place") - F.shiftleft("part", 33)
    dealt = placed.withColumn("part", part).join(F.broadcast(known), "part")
    return dealt.select("lang", "phrase", F.floor((F.col("base") + inside) / size).alias("shard")), math.ceil(total / size)


def count(texts: DataFrame, patterns: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """lang, phrase and n of each pattern (lang, phrase) that occurs, by one scan of the texts of its langs for each shard."""
    dealt, n_shards = shards(patterns, shard_size)
    dealt = written(dealt, "shards")
    done = [dealt.select("lang", "phrase", F.lit(0).cast("bigint").alias("n")).limit(0)]
    for k in range(n_shards):
        rows = dealt.filter(F.col("shard") == k).select("lang", "phrase").toArrow()  # shard_size phrases at most
        own: dict[str, list[str]] = {}
        for lang, phrase in zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist()):
            own.setdefault(lang, []).append(phrase)
        shared = texts.sparkSession.sparkContext.broadcast(own)
        done.append(written(_scanned(texts.filter(F.col("lang").between(min(own), max(own))), shared), "phrase-counts"))
        shared.unpersist()
    return functools.reduce(DataFrame.unionByName, done)


def parts(phrases: DataFrame) -> DataFrame:
    """lang, phrase, k, left and right of every cut of a phrase after its first k words."""
    words = F.split("phrase", " ", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.size("w") - k), " ").alias("right")))
    each = phrases.select("lang", "phrase", words.alias("w")).select("lang", "phrase", F.explode(cuts).alias("c"))
    return each.select("lang", "phrase", "c.k", "c.left", "c.right")


def word_totals(texts: DataFrame) -> DataFrame:
    """lang and n, all its word occurrences."""
    return texts.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("bigint").alias("n"))


def phrase_counts(texts: DataFrame, least: int = LEAST, bits: int | None = None, shard_size: int = SHARD) -> DataFrame:
    """lang, phrase and n of every phrase of two to four words that occurs least times, and of the words at its ends."""
    sc = texts.sparkSession.sparkContext
    if bits is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / 4 + 1))))
    words = sc.broadcast(bitmap(sketch(texts, bits, (1,)), bits, least))
    pairs = sc.broadcast(bitmap(sketch(texts, bits, (2,), 1, words), bits, least))
    longer = sc.broadcast(bitmap(sketch(texts, bits, tuple(range(3, LONGEST + 1)), 2, pairs), bits, least))
    words.unpersist()
    found = written(candidates(texts, bits, pairs, longer), "candidates")
    split = F.split("phrase", " ", -1)
    ends = found.select("lang", F.explode(F.array(split[0], F.element_at(split, -1))).alias("phrase")).distinct()
    counted = count(texts, found.unionByName(ends), shard_size)
    return written(counted.filter((F.col("n") >= least) | ~F.contains("phrase", F.lit(" "))), "phrase-counts")


def scores(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of the lowest-scoring cut of each phrase of several words."""
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    phrases = counts.filter(F.contains("phrase", F.lit(" ")))
    cut = parts(phrases.select("lang", "phrase")).join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(phrases.select("lang", "phrase", F.col("n").alias("a")), ["lang", "phrase"])
    scored = cut.withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) div CAST(l + r AS DECIMAL(20,0))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("c"))
    return lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def free(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of phrases (lang, phrase, a) that no longer one contains which is at least share percent as frequent."""
    words = F.split("phrase", " ", -1)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    held = phrases.select("lang", "a", words.alias("w")).filter(F.size("w") > 2).select("lang", "a", F.explode(inner).alias("phrase"))
    most = held.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    wide = "decimal(22,0)"
    dropped = F.col("outer").cast(wide) * 100 >= F.col("a").cast(wide) * share
    return phrases.join(most, ["lang", "phrase"], "left").filter(~F.coalesce(dropped, F.lit(False))).drop("outer")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, bits: int | None = None, shard_size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's best phrases."""
    texts = _texts(docs, lang_col, text_col)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = free(scores(phrase_counts(texts, least, bits, shard_size)))
    # a lang's rows are first ranked in parts, so that none of them meet in one task but top for each part
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(word_totals(texts), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
