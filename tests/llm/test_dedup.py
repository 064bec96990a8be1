import re
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.llm import exact_dedup, simhash
from tarnwick.llm.queries import QUERIES


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """prints: (id, fingerprint); the least id reachable over pairs within three bits."""
    parent = {i: i for i, _ in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def test_simhash_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    wanted = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, (brute_components(prints)[i] for i, _ in prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    assert got == wanted


def test_native_hash_agrees(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("über alles x")).alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("über alles x".encode(), 42)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_every_pair_within_the_radius_meets(a, flips):
    b = a
    for i in flips:
        b ^= 1 << i
    for step in simhash.ROUNDS:
        found = [m % (1 << 64) for m in simhash.masks(3, step)]
        assert len(found) == 15
        assert any(a & m == b & m for m in found)


def test_last_round_bounds_a_bucket():
    import itertools

    sets = [simhash.masks(3, step) for step in simhash.ROUNDS]
    free = [64 - ((x | y | z) % (1 << 64)).bit_count() for x, y, z in itertools.product(*sets)]
    assert max(free) <= 16


def test_dense_buckets_are_split_without_losing_links(spark, monkeypatch):
    """A chain and a ball of fingerprints under a bucket bound of four."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    base = 0x0F0F_3355_1234_ABCD
    prints = [base ^ (1 << i) ^ (1 << (i * 7 + 3) % 64) for i in range(30)] + [((1 << k) - 1) for k in range(0, 60, 3)] + [0xFFFF_0000_FFFF_0000]
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp bigint, node bigint")
    from tarnwick.operators.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(nodes)).collect()}
    wanted = brute_components(list(enumerate(prints)))
    assert {i: got.get(i, i) for i in wanted} == wanted


def test_a_large_bucket_is_compared_in_bounded_memory():
    import tracemalloc

    members = [{"fp": (i ^ i >> 1) | (i % 2 << 40), "node": i + 5} for i in range(4000)] + [{"fp": 0x7F << 50, "node": 1}]
    tracemalloc.start()
    found = simhash.forest(members, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found) == [(i, 5) for i in range(6, 4005)]
    assert peak < 40 << 20


def test_simhash_odd_rows(spark, odd, empty):
    rows = simhash.components(odd).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(r.component_id)
    assert by_id[2] == {1} and by_id[3] == {3} and by_id[4] == {3} and by_id[5] == {3}
    assert by_id[None] == {3, None}
    assert simhash.components(empty).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 not in ids and ids.count(None) == 2
    assert simhash.deduplicate(empty).count() == 0


def brute_near(texts, similarity=0.8):
    """The least id reachable over pairs of five-word shingle sets of that Jaccard similarity, from all pairs."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = set()
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and len(a & b) >= similarity * len(a | b):
                pairs.add((i, j))
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}, pairs


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.randrange(10**6)}"
    return " ".join(out)


def test_near_duplicates_on_planted_copies(spark):
    """Groups of two to two hundred copies with a few words changed, and texts that share half of their passages."""
    import random

    r, texts = random.Random(3), []
    for size in [2] * 30 + [5] * 10 + [200]:
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(120, 300))]
        texts += [edited(r, words, r.randint(0, len(words) // 60)) for _ in range(size)]
    shared = " ".join(f"s{k}" for k in range(80))
    texts += [shared + " " + " ".join(f"w{r.randrange(5000)}" for _ in range(80)) for _ in range(100)]
    texts += ["one two", "one two", "", None, "a b c d e f", "a b c d e f g"]
    r.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    wanted, pairs = brute_near(dict(enumerate(texts)))
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame).collect()}
    assert {i for i in got if got[i] == i} >= {i for i in wanted if wanted[i] == i}  # nothing is merged that is not near
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.97 * len(pairs)


def test_hot_keys_are_compared_in_tiles(spark, monkeypatch):
    """With keys hot from eight members on, every proposal of the untiled form is still made, or a nearer one."""
    import random

    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(2)]
    rows = [(i, *((b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))) for b in base)) for i in range(60)]
    nodes = spark.createDataFrame([(i, *(x - (1 << 64) if x >> 63 else x for x in own)) for i, *own in rows], "node bigint, hi bigint, lo bigint")
    whole = {(x.src, x.dst) for x in simhash.proposals(nodes).collect()}
    monkeypatch.setattr(simhash, "HOT", 8)
    tiled = {(x.src, x.dst) for x in simhash.proposals(nodes).collect()}
    assert whole <= tiled and len({s for s, _ in whole}) == 59


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.lists(st.integers(0, 31), max_size=3))
def test_parts_within_the_radius_meet(a, flips):
    b = a
    for i in flips:
        b ^= 1 << i
    assert len(simhash.part_masks()) == 15 and any(a & m == b & m for m in simhash.part_masks())


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint_property(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_exact_odd_rows(spark, odd, empty):
    rows = exact_dedup.decide(odd).collect()
    assert len(rows) == odd.count()
    groups = {(r.doc_id, r.group_size, r.keep_id) for r in rows}
    assert (1, 3, 2) in groups and (3, 3, 4) in groups and (None, 3, 4) in groups and (None, 1, None) in groups
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert exact_dedup.decide(empty).count() == 0
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.text_sha256 for r in rows})
    assert exact_dedup.deduplicate(empty).count() == 0


def test_chunks_rebuild_the_text(spark, odd):
    whole = odd.select(F.array_join(exact_dedup.chunks(F.col("text")), "").alias("a"), F.coalesce("text", F.lit("")).alias("b"), F.array_max(F.transform(exact_dedup.chunks(F.col("text")), F.length)).alias("n"))
    for r in whole.collect():
        assert r.a == r.b and (r.n or 0) <= exact_dedup.MAX_CHUNK + 1


def test_exact_on_planted_copies(spark):
    text = "x" * 9000 + ". tail"
    rows = [(i, text) for i in range(5)] + [(9, text + " ")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**{i: (4, 5, i == 4) for i in range(5)}, 9: (9, 1, True)}


def test_near_duplicates_lose_no_pair_that_fingerprints_miss(spark, monkeypatch):
    """Short texts with one word changed, whose fingerprints are far apart, with a line that many others share."""
    import random

    r, rows = random.Random(8), []
    for i in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(44)]
        middle = words[:22] + ["changed"] + words[23:]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(middle))]
    rows += [(1000 + i, "the same words stand in all of these lines " + " ".join(f"x{r.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {d: d if d >= 1000 else d - d % 2 for d, _ in rows}
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(frame, similarity=0.75).collect()} == wanted
    monkeypatch.setattr(simhash, "SAMPLE", 1)  # the shared line is known as frequent: the same result
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(frame, similarity=0.75).collect()} == wanted


def test_counts_by_cell_keep_every_pair_of_the_similarity(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 32, 400, dtype=np.uint32)
    sets = {0: base, 1: np.r_[base[:380], rng.integers(0, 1 << 32, 20, dtype=np.uint32)], 2: rng.integers(0, 1 << 32, 400, dtype=np.uint32), 3: base[:0], 4: base[:0], 5: np.arange(300, dtype=np.uint32) * simhash.CELLS}
    sets[6] = sets[5][:250]  # more in one cell than a byte holds
    sets[7] = np.r_[base[:1], sets[2][:399]]
    sets = {k: np.unique(v) for k, v in sets.items()}
    rows = spark.createDataFrame([(k, bytearray(v.astype("<u4").tobytes())) for k, v in sets.items()], "node bigint, shingles binary")
    pairs = [(a, b) for a in sets for b in sets if b < a]
    jaccard = {(a, b): len(np.intersect1d(sets[a], sets[b])) / max(1, len(np.union1d(sets[a], sets[b]))) if len(sets[a]) + len(sets[b]) else 1.0 for a, b in pairs}
    kept = {tuple(r) for r in simhash.possible(spark.createDataFrame(pairs, "src bigint, dst bigint"), rows, 0.8).collect()}
    alike = {p for p in pairs if jaccard[p] >= 0.8}
    assert alike == {(1, 0), (4, 3), (6, 5), (7, 2)} and alike <= kept
    assert not kept & {(2, 0), (2, 1), (7, 0)}  # these share a shingle at most, and never reach the sets


def test_candidates_left_over_have_room_for_the_similarity_and_no_similar_pair_is_lost(spark, monkeypatch):
    """Shingles that many sets share come last, and a pair whose first common one comes too late is no candidate: 193 of these were before."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rng, sets = np.random.default_rng(7), []
    for _ in range(6):
        common = rng.integers(0, 1 << 32, 40, dtype=np.uint64)
        for _ in range(12):
            x, k = common.copy(), int(rng.integers(0, 14))
            x[rng.choice(40, k, replace=False)] = rng.integers(0, 1 << 32, k, dtype=np.uint64)
            sets.append(np.unique(x).astype("<u4"))
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node bigint, shingles binary")
    parts = spark.createDataFrame([(2, 1)], "node bigint, component bigint")
    got = {tuple(r) for r in simhash.left_over(rows, parts, 0.8).collect()}
    alike = {(b, a) for b in range(len(sets)) for a in range(b) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))} - {(2, 1)}
    assert len(alike) == 46 and alike <= got and len(got) < 2 * len(alike)
