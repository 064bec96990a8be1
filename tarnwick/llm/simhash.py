"""SimHash near-deduplication by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is 1 if bit i is set in over half of the XXH64 hashes of
the text's three-word shingles. Fingerprints link at RADIUS or fewer differing bits.

For a radius r each bit position gets a nonzero vector of r + 1 bits, and each of the
2**(r+1) - 1 nonzero vectors v gives one mask: the positions whose vector has an odd
product with v. Up to r differing positions always leave some v even with all of their
vectors, so any pair within the radius agrees under some mask and meets in that bucket.

Equal fingerprints are one row from the start. A bucket of over BUCKET fingerprints is
not compared as it stands: its members are dealt out once more under the masks of another
assignment, joined to the first mask. That keeps the guarantee, and the key grows from
about half of the bits to three quarters and at least 48 bits, where at most 2**16 different
fingerprints can share one. So no bucket is cut and none is unbounded.
A bucket is compared in blocks of BLOCK cells, in memory that grows with its members, not
their pairs, and yields a spanning forest of its links, never all pairs.

Near-duplicates for deduplicate() are texts whose sets of FIVE-word shingles have a Jaccard
similarity of 0.8 or more. For them a fingerprint has 128 bits, in four parts of 32, and
covering masks of radius PART_RADIUS in each part: pairs that differ in at most that many
bits of any part meet, so all pairs do that differ in 15 bits or fewer. Each member of a
bucket proposes the member before it that is nearest, if it is within NEAR bits. Shingle
sets decide: first on each text's nearest proposal, then on all other proposals that lie
between different components. What is left is found by prefixes: in one order of all
shingles, two sets of similarity s share one of the first n - ceil(s * n) + 1 of each, so
nodes of different components that share such a shingle are compared too, if what follows
it in both leaves room for that similarity, and no pair is lost. Of those pairs only the
ones go to the sets whose counts of shingles by cell leave room for it too: sets share at
most the lesser count of each cell. Shingles that are frequent in a sample come last in that
order, the most frequent at its end, which keeps groups small and decides nothing else. Keys of over HOT members are compared in tiles, pairs of
parts of at most HOT members, which any number of tasks share.

Defined cases: null texts count as empty; a text without words has fingerprint zero and
links like any other. A row with a null id has its fingerprint and takes the component of
equal fingerprints, null if no row with an id has it. Repeated rows share a component.
Columns other than the id and the text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from ..runtime import batched, written
from .bpe import pieces, release

SEED, SHINGLE, RADIUS = 42, 3, 3
BUCKET = 512
#: Pairs of members compared at once, or those of one member if that is more.
BLOCK = 1 << 20
#: Odd multipliers that reorder the bit positions for each round of masks.
ROUNDS = (1, 27, 45)
#: Shingles of similarity, bits of a part that may differ, bits of a proposal, members of a tile.
FIVE, PART_RADIUS, NEAR, HOT = 5, 3, 32, 4096
#: Shingles put last in the order of prefixes, at most; they have at least FREQUENT nodes among one in SAMPLE.
LAST, FREQUENT, SAMPLE = 1 << 18, 4, 16
#: Cells into which a set's shingles are counted to bound what it can share with another.
CELLS = 256
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().translate(LOWER).split()  # at x20 and x09 to x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    counts, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for start in range(0, n, 1 << 14):  # a long text is counted in parts
        part = words[start : start + (1 << 14) + SHINGLE - 1]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(SHINGLE)))], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of each row."""
    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def masks(radius: int, step: int) -> list[int]:
    """The covering masks over 64 positions, as signed longs; step reorders the positions."""
    vectors = [1 + (i * step % 64) % (2 ** (radius + 1) - 1) for i in range(64)]
    found = [sum(((v & x).bit_count() & 1) << i for i, x in enumerate(vectors)) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def forest(members: list[dict], radius: int) -> list[tuple[int, int]]:
    """Links from the least node of each connected part of a bucket to its other nodes."""
    fp = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
    node = np.array([m["node"] for m in members], np.int64)
    left, out = np.arange(len(fp)), []
    while len(left):
        part, new, left = [left[:1]], left[:1], left[1:]
        while len(new) and len(left):
            rows = max(1, BLOCK // len(left))
            near = np.zeros(len(left), bool)
            for i in range(0, len(new), rows):
                near |= (np.bitwise_count(fp[new[i : i + rows], None] ^ fp[None, left]) <= radius).any(axis=0)
            new, left = left[near], left[~near]
            part.append(new)
        ids = node[np.concatenate(part)]
        least = ids.min()
        out += [(int(x), int(least)) for x in ids if x != least]
    return out


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src and dst: a spanning forest of each bucket's links among nodes (fp, node)."""
    def run(batches):
        for batch in batches:
            found = [e for members in batch.column("members").to_pylist() for e in forest(members, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["src", "dst"])

    rows, edges = nodes.withColumn("mask", F.lit(0).cast("bigint")), None
    for k, step in enumerate(ROUNDS):
        last = k == len(ROUNDS) - 1
        each = F.explode(F.array([F.lit(m).cast("bigint") for m in masks(radius, step)]))
        dealt = rows.withColumn("own", each).withColumn("mask", F.col("mask").bitwiseOR(F.col("own"))).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).drop("own")
        if k:
            dealt = dealt.distinct()  # two pairs of masks may join to the same one
        sizes = dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = dealt.join(sizes, ["mask", "key"])
        small = sized if last else sized.filter(F.col("size") <= BUCKET)
        bucket = small.groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "node")).alias("members"))
        found = bucket.select("members").mapInArrow(run, "src bigint, dst bigint")
        edges = found if edges is None else edges.unionByName(found)
        rows = sized.filter(F.col("size") > BUCKET).select("fp", "node", "mask")
    return edges


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of each row."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    parts = connected_components(links(nodes.filter("node IS NOT NULL"), radius))
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def sketch(text: str | None) -> tuple[int, int, np.ndarray]:
    """128 bits of a text's three-word shingles, as two signed longs, and the sorted 32-bit hashes of its five-word shingles.

    The hash of five words is made from those of the three shingles within them.
    """
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0, 0, np.zeros(0, np.uint32)
    if len(words) < FIVE:
        whole = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words), SEED), "<u8")[:1]
    digest, counts, n, five = xxhash.xxh3_128_digest, np.zeros(128, np.int64), max(1, len(words) - SHINGLE + 1), []
    for start in range(0, n, 1 << 14):  # a long text is counted in parts, which overlap by what five words need
        part = words[start : start + (1 << 14) + FIVE - 1]
        h = np.frombuffer(b"".join(digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(SHINGLE)))) or digest(b" ".join(part), SEED), "<u8").reshape(-1, 2)
        own = h[: min(1 << 14, n - start)]
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        x = h[:, 0]
        five.append(x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[2:] * np.uint64(0x165667B19E3779F9))
    hashes = whole if len(words) < FIVE else np.concatenate(five)
    lo, hi = np.packbits(counts * 2 > n, bitorder="little").view("<i8").tolist()
    return hi, lo, np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hi, lo, shingles (little-endian 32-bit hashes) and their digest, of each row."""
    import hashlib

    def run(batches):
        release()
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                found = [sketch(t) for t in texts]
                sets = [x.astype("<u4").tobytes() for _, _, x in found]
                digests = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array(digests, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "hi", "lo", "digest", "shingles"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, hi bigint, lo bigint, digest bigint, shingles binary")


def part_masks(radius: int = PART_RADIUS) -> list[int]:
    """The covering masks over the 32 positions of a part."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(32)]
    return [sum(((v & x).bit_count() & 1) << i for i, x in enumerate(vectors)) for v in range(1, 2 ** (radius + 1))]


def nearest(key: np.ndarray, node: np.ndarray, hi: np.ndarray, lo: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """src, dst and bits: for each member of a group of equal keys the nearest before it, if within near bits; rows come by key and node."""
    n = len(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    at = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    best, whom = np.full(n, near + 1), np.zeros(n, np.int64)
    hi, lo, step, here = hi.view(np.uint64), lo.view(np.uint64), 1, np.flatnonzero(at >= 1)
    while len(here):
        bits = np.bitwise_count(hi[here] ^ hi[here - step]).astype(np.int64) + np.bitwise_count(lo[here] ^ lo[here - step])
        better = here[bits <= best[here]]
        best[better], whom[better] = bits[bits <= best[here]], better - step
        step += 1
        here = here[at[here] >= step]
    found = np.flatnonzero(best <= near)
    return node[found], node[whom[found]], best[found]


def proposals(nodes: DataFrame, near: int = NEAR, radius: int = PART_RADIUS) -> DataFrame:
    """src, dst and bits: each node's nearest of lower number in every bucket, of nodes (hi, lo, node)."""
    keys, masks_of = [], part_masks(radius)
    for p, word in enumerate(("hi", "hi", "lo", "lo")):
        part = F.shiftrightunsigned(word, 32 * (p % 2)).bitwiseAND(0xFFFFFFFF)
        keys += [part.bitwiseAND(m).bitwiseOR((p * len(masks_of) + k) << 32) for k, m in enumerate(masks_of)]
    dealt = nodes.select("node", "hi", "lo", F.explode(F.array(*keys)).alias("key"))
    hot = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > HOT).select("key", F.ceil(F.col("size") * 2 / HOT).cast("int").alias("parts")), "hot_keys")
    marked = dealt.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # a tile is a pair of parts; a key that is not hot has one part and one tile
    tiled = marked.withColumn("own", own).withColumn("other", other).withColumn("tile", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
    units = tiled.select("key", "tile", "node", "hi", "lo").repartition("key", "tile").sortWithinPartitions("key", "tile", "node")

    def run(batches):
        held = None
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "tile", "node", "hi", "lo")])
            held = own if held is None else np.concatenate([held, own], axis=1)
            last = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1])) if held.shape[1] else []
            if len(last):  # all but the last unit are whole
                yield from found(held[:, : last[-1] + 1])
                held = held[:, last[-1] + 1 :]
        if held is not None:
            yield from found(held)

    def found(rows):
        unit = np.concatenate([[0], ((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])).cumsum()])
        arrays = nearest(unit, rows[2], np.ascontiguousarray(rows[3]), np.ascontiguousarray(rows[4]), near)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["src", "dst", "bits"])

    return units.mapInArrow(run, "src bigint, dst bigint, bits bigint").distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose shingle sets (node, shingles) have at least the Jaccard similarity; two empty sets have 1."""
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["src", "dst"])

    a, b = (sets.select(F.col("node").alias(end), F.col("shingles").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint")


def cells(shingles: np.ndarray) -> bytes | None:
    """How many of a set's shingles lie in each cell, a byte each; none if a byte does not hold that."""
    counts = np.bincount(shingles % CELLS, minlength=CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) without those whose counts by cell rule out that their sets (node, shingles) have the similarity."""
    def counted(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in found], pa.int64()), pa.array([cells(x) for x in found], pa.binary())], ["node", "n", "cells"])

    def run(batches):
        for batch in batches:
            keep = []
            for a, b, n in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("n").to_pylist()):
                most = None if a is None or b is None else int(np.minimum(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).sum(dtype=np.int64))
                keep.append(most is None or most >= similarity * (n - most))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["src", "dst"])

    known = written(sets.select("node", "shingles").mapInArrow(counted, "node bigint, n bigint, cells binary").distinct(), "cells")
    a, b = (known.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("cells").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", (F.col("n_src") + F.col("n_dst")).alias("n"), "a", "b").mapInArrow(run, "src bigint, dst bigint").distinct()


def prefixes(sets: DataFrame, similarity: float, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, shingle, place (how many come before it) and n (the set's size) of the shingles of each set (node, shingles) that a similar set must share one of.

    The order is that of the hashes, those in last (sorted, and how often each was seen)
    after all others, the more often seen the later.
    """
    shared = sets.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        late, often = shared.value
        for batch in batches:
            found, sizes = [], []
            for buffer in batch.column("shingles"):
                x = np.frombuffer(buffer.as_buffer(), "<u4")
                if len(late):
                    there = np.minimum(np.searchsorted(late, x), len(late) - 1)
                    seen = np.where(late[there] == x, often[there], 0)
                    x = x[np.argsort(seen, kind="stable")]
                found.append(x[: int((1 - similarity) * len(x) + 1e-6) + 1])
                sizes.append(len(x))
            many = [len(x) for x in found]
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), many)
            place = np.concatenate([*map(np.arange, many), np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int64)), pa.array(place), pa.array(np.repeat(np.array(sizes, np.int64), many))], ["node", "shingle", "place", "n"])

    return sets.select("node", "shingles").mapInArrow(run, "node bigint, shingle bigint, place bigint, n bigint")


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come last, sorted, and how often each is in a sample of the sets; they order prefixes and exclude nothing."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), "<u4").astype(np.int64))], ["shingle"])

    some = sets.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("shingles").mapInArrow(run, "shingle bigint")
    rows = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(LAST).collect()
    rows.sort()
    return np.array([r.shingle for r in rows], np.uint32), np.array([r.n for r in rows], np.int64)


def left_over(sets: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """src and dst: every pair of sets (node, shingles) in different parts (node, component) that may have the similarity.

    Two sets have no more in common than follows the first shingle that they share, itself
    included, in either of them; a pair that is similar has room for what it needs there.
    """
    rows = prefixes(sets, similarity, frequent(sets)).join(parts, "node", "left").select("shingle", "node", "n", (F.col("n") - F.col("place")).alias("room"), F.coalesce("component", "node").alias("part"))
    rows = written(rows, "prefixes")
    mixed = rows.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("shingle")
    kept = written(rows.join(mixed, "shingle", "left_semi"), "mixed")
    a, b = (kept.select("shingle", F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", "room", "part"))) for end in ("src", "dst"))
    near = (F.col("src_n") >= similarity * F.col("dst_n") - 1e-6) & (F.col("dst_n") >= similarity * F.col("src_n") - 1e-6)
    roomy = F.least("src_room", "dst_room") >= similarity / (1 + similarity) * (F.col("src_n") + F.col("dst_n")) - 1e-6
    return a.join(b, "shingle").filter((F.col("dst") < F.col("src")) & (F.col("src_part") != F.col("dst_part")) & near & roomy).select("src", "dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over near-duplicates) of each row; ids are whole numbers.

    Rows go to Python in batches of bounded size, since sets of shingles are wide.
    """
    with batched(docs.sparkSession):
        prints = written(sketches(docs, id_col, text_col), "sketches")
        same = ["hi", "lo", "digest"]
        nodes = written(prints.groupBy(same).agg(F.min("doc_id").cast("bigint").alias("node")), "nodes")
        edges = written(proposals(nodes.filter("node IS NOT NULL").select("node", "hi", "lo").distinct()), "proposals")
        every = prints.select(F.col("doc_id").cast("bigint").alias("node"), "shingles").join(nodes.select("node").distinct(), "node", "left_semi")

        def sets_of(pairs: DataFrame) -> DataFrame:
            ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
            return written(every.join(ends, "node", "left_semi").groupBy("node").agg(F.max("shingles").alias("shingles")), "sets")

        sets = sets_of(edges)
        first = edges.groupBy("src").agg(F.min_by("dst", F.struct("bits", "dst")).alias("dst"))
        linked = written(similar(first, sets, similarity), "linked")
        parts = written(connected_components(linked), "parts")
        at = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
        open_ = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left").filter(F.coalesce("src_part", "src") != F.coalesce("dst_part", "dst"))
        more = similar(open_.join(first, ["src", "dst"], "left_anti").select("src", "dst"), sets, similarity)
        linked = written(linked.unionByName(more), "linked")
        rest = left_over(every, written(connected_components(linked), "parts"), similarity)
        rest = written(possible(rest, every, similarity), "left_over")
        whole = connected_components(linked.unionByName(similar(rest, sets_of(rest), similarity)))
        named = nodes.join(whole, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
        return prints.select("doc_id", *same).join(named, same).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component of near-duplicates, the one whose id names it, with its columns as they were.

    Rows with a null id can't be named and stay. Of repeated rows of an id one stays. Only
    rows of repeated ids are shuffled; the others meet the ids that go.
    """
    found = near_duplicates(docs, id_col, text_col, similarity).filter("doc_id IS NOT NULL")
    ids = written(found.groupBy(F.col("doc_id").alias("__tw_id")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("named"), F.count(F.lit(1)).alias("n")).filter("NOT named OR n > 1"), "ids")
    rows = docs.withColumn("__tw_key", F.col(id_col))
    on = F.col("__tw_key") == F.col("__tw_id")
    out = rows.join(ids, on, "left_anti").drop("__tw_key")  # a null id matches none
    repeated = ids.filter("named")
    if repeated.isEmpty():
        return out
    order = Window.partitionBy("__tw_key").orderBy(F.xxhash64(F.col(text_col)))
    again = rows.join(repeated, on, "left_semi").withColumn("__tw_rank", F.row_number().over(order)).filter("__tw_rank = 1")
    return out.unionByName(again.drop("__tw_key", "__tw_rank"))
