import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.llm import context_tree, mixing, toxicity
from tarnwick.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def brute_targets(sizes):
    """Raise the common level little by little; a full source stops."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) < 1.5 * sum(sizes) else (lo, mid)
    return [min(2 * s, hi * w) for s, w in zip(sizes, weights)]


def test_mixing_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [sum(size[d] for d in size if source[d] == s) for s in names]
    target = dict(zip(names, brute_targets(sizes)))
    rows = QUERIES["op8_mix"](spark, sf_dir).collect()
    taken = defaultdict(int)
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == sizes[names.index(source[r.doc_id])]
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(30, 0.01 * target[s])
    again = {(r.doc_id, r.taken) for r in QUERIES["op8_mix"](spark, sf_dir).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixture_holds_the_draws(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = Counter({r.doc_id: r.copies for r in mixing.draws(docs).collect() if r.copies})
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == drawn


def test_mixing_many_sources(spark):
    """Four thousand sources over two chunks of the tree, with a source column that is no text."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), i % 5000 if i % 11 else None) for i in range(30_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source int")
    found = mixing.draws(frame).collect()
    assert len(found) == len(rows)
    size, source = {i: len(t.split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    own = Counter()
    for i, s in source.items():
        own[s] += size[i]
    target = dict(zip(names, brute_targets([own[n] for n in names])))
    taken, shards = Counter(), Counter()
    for r in found:
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-9) and 0 <= r.copies <= 2 and len(r.shards or []) >= r.copies
        taken[source[r.doc_id]] += r.copies * size[r.doc_id]
        shards.update((r.shards or [])[: r.copies])
    assert all(abs(taken[n] - target[n]) <= 40 for n in names)
    assert len(shards) == mixing.SHARDS and max(shards.values()) < 3 * min(shards.values())


def test_taken_follows_the_leaves(spark):
    """Every copy of a row has a shard, and each shard drew some."""
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}") for i in range(2000)], "doc_id bigint, text string, source string")
    whole = mixing.draws(docs, shards=4).collect()
    by_shard = Counter(x for r in whole for x in (r.shards or [])[: r.copies])
    assert set(by_shard) == {0, 1, 2, 3}
    assert sum(r.copies for r in whole) == sum(by_shard.values())


def test_repeated_rows_are_taken_alike(spark):
    rows = [(i % 90, f"text {i % 90} " + "w " * (i % 90), "s") for i in range(270)] + [(1000 + i, "x y", "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    copies = defaultdict(set)
    for r in mixing.draws(docs).collect():
        copies[r.doc_id].add(r.copies)
    assert all(len(c) == 1 for c in copies.values())
    drawn = Counter({i: next(iter(c)) * (3 if i < 90 else 1) for i, c in copies.items() if c != {0}})
    assert Counter(r.doc_id for r in mixing.mix(docs).collect()) == drawn


def test_nearest_subset_of_huge_sizes():
    sizes = [10**12 + 7, 3 * 10**11, 5 * 10**10, 11]
    found = mixing._nearest(sizes, 1.3e12)
    assert sorted(found)[:2] == [0, 1]


def test_split_keeps_quotas():
    quotas = np.array([100, 7, 0, 33])
    for shards in (1, 2, 7, 64):
        parts = mixing.split(quotas, shards, np.random.default_rng(3))
        assert len(parts) == shards and (sum(parts) == quotas).all() and min(p.min() for p in parts) >= 0
        totals = [p.sum() for p in parts]
        assert max(totals) - min(totals) <= 2 + shards.bit_length()


def test_mixing_draws_of_any_total(monkeypatch):
    """The own sampler against exact chances on small numbers, and against mean and spread on totals far above numpy's limit."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(mixing, "LIMIT", 2)
    for good, bad, n in [(7, 9, 6), (3, 40, 20), (30, 4, 33), (5, 5, 0), (5, 5, 10), (0, 6, 3)]:
        got, times = Counter(mixing.draw(good, bad, n, rng) for _ in range(20_000)), 20_000
        chances = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(good, n) + 1)}
        assert set(got) <= set(chances)
        chi = sum((got[k] - times * c) ** 2 / (times * c) for k, c in chances.items() if times * c >= 5)
        assert chi < 15 + 4 * len(chances), (good, bad, n, chi)
    monkeypatch.undo()
    for good, bad, n in [(10**9, 10**9, 10**9), (3 * 10**11, 7 * 10**11, 4 * 10**11), (8192, 10**12, 5 * 10**11), (20, 10**12, 10**6)]:
        total = good + bad
        mean, sd = n * good / total, (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5
        found = np.array([mixing.draw(good, bad, n, rng) for _ in range(60)])
        assert abs(found.mean() - mean) <= 5 * sd / 60**0.5 + 1e-3 and found.min() >= 0 and found.max() <= min(good, n)
        assert sd < 1 or 0.6 < found.std() / sd < 1.5


def test_mixing_splits_more_blocks_than_numpy_draws():
    quotas = np.array([8192, 0, 1, 10**12, 5 * 10**9, *[8192] * 200], np.int64)
    for shards in (2, 5):
        parts = mixing.split(quotas, shards, np.random.default_rng(3))
        assert (sum(parts) == quotas).all() and min(p.min() for p in parts) >= 0
        assert [int(p.sum()) for p in parts] == mixing.even(int(quotas.sum()), shards)
        again = mixing.split(quotas, shards, np.random.default_rng(3))
        assert all((a == b).all() for a, b in zip(parts, again))


def test_mixing_odd_rows(spark, odd, empty):
    rows = mixing.draws(odd).collect()
    assert len(rows) == odd.count() and all(r.copies <= 2 for r in rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.draws(empty).count() == 0 and mixing.mix(empty).count() == 0


def brute_base(texts, train):
    low = {i: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    counts = Counter(w for i in low if train[i] for w in [*low[i], "<end>"])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(w) + 1, sum(counts[x] > 0 for x in [*w, "<end>"]), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, "<end>"])) for i, w in low.items()}


def test_language_model_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i in texts}
    wanted = brute_base(texts, train)
    rows = QUERIES["op9_lm"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, base = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[r.doc_id], n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)


def test_held_out_text_is_coded_shorter_than_by_words(spark):
    """Byte contexts need more than a few hundred documents to beat known words, so this takes the 0.1 table."""
    out = QUERIES["op9_lm"](spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def plain_context_tree(corpus, texts, depth):
    """Exact context-tree weighting with dictionaries, without slots or rounding."""
    counts = defaultdict(lambda: [0, 0])
    for text in corpus:
        data = b"\xff" * depth + text + b"\xff"
        for i in range(depth, len(data)):
            for k in range(depth + 1):
                for j in range(8):
                    counts[(data[i - k : i], (data[i] >> (8 - j)) | 1 << j)][(data[i] >> (7 - j)) & 1] += 1

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below, own_share, log_p = defaultdict(float), {}, {}
    for k in range(depth, -1, -1):
        for (context, prefix), (a, b) in counts.items():
            if len(context) == k:
                own = kt(a, b)
                under = below[(context, prefix)]
                own_share[(context, prefix)] = 1.0 if k == depth else 1 / (1 + math.exp(min(700, under - own)))
                log_p[(context, prefix)] = own if k == depth else np.logaddexp(own, under) - math.log(2)
                if k:
                    below[(context[1:], prefix)] += log_p[(context, prefix)]
    out = []
    for text in texts:
        data, total = b"\xff" * depth + text + b"\xff", 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                p, seen = 0.5, False
                for k in range(depth, -1, -1):
                    key = (data[i - k : i], (data[i] >> (8 - j)) | 1 << j)
                    if key in counts:
                        a, b = counts[key]
                        share = own_share[key] if seen else 1.0
                        p = share * (b + 0.5) / (a + b + 1) + (1 - share) * p
                        seen = True
                total += math.log10(p if (data[i] >> (7 - j)) & 1 else 1 - p)
        out.append(total)
    return out


def test_context_tree_against_plain_form(spark):
    corpus = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "über café"] * 3
    texts = [*corpus[:5], "the bat sat", "zzz", "a dog on the mat 🙂"]
    rows = [(i, t, True) for i, t in enumerate(corpus)] + [(100 + i, t, False) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, learn boolean")
    got = {r.doc_id: r.score for r in context_tree.score(frame, F.col("learn")).collect()}
    wanted = plain_context_tree([t.encode() for t in corpus], [t.encode() for t in texts], context_tree.DEPTH)
    for i, w in enumerate(wanted):  # slots hold 16 bits of an estimate and 8 of a weight
        assert got[100 + i] == pytest.approx(w, rel=0.02, abs=0.05)


@pytest.mark.parametrize("hot", [0, context_tree.HOT if hasattr(context_tree, "HOT") else 22])
def test_context_tree_scores_are_exact(spark, monkeypatch, hot):
    """Every context has its own counts, and unseen ones none, whether keys are looked up or joined."""
    import random

    monkeypatch.setattr(context_tree, "HOT", hot, raising=False)
    r = random.Random(7)
    corpus = ["".join(r.choice("abcdefghij klmnopqrst") for _ in range(300)) for _ in range(40)] + ["the cat sat on the mat"] * 20
    texts = ["the cat sat on the mat", "the bat sat", "zzz", "", "über 🙂", corpus[0][:50] + "QQ"]
    rows = [(i, t, True) for i, t in enumerate(corpus)] + [(100 + i, t, False) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, learn boolean")
    got = {x.doc_id: x.score for x in context_tree.score(frame, F.col("learn")).collect()}
    wanted = plain_context_tree([t.encode() for t in corpus], [t.lower().encode() for t in texts], context_tree.DEPTH)
    for i, w in enumerate(wanted):
        assert got[100 + i] == pytest.approx(w, rel=1e-8)


def test_context_tree_is_a_distribution(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["abracadabra", "banana", "alakazam"])], "doc_id bigint, text string")
    tables = context_tree.fold(context_tree.trees(context_tree.count(frame).filter("kind = 0").select("key", "n")))
    for context in (b"\xff\xff\xff\xff\xff", b"\xff\xff\xffab", b"qqqqq"):
        key = np.array([b | sum(c << 8 * (k + 1) for k, c in enumerate(reversed(context))) for b in range(256)], np.uint64)
        assert (10 ** context_tree.log10_bytes(key, tables)).sum() == pytest.approx(1)


def test_language_model_odd_rows(spark, odd, empty):
    train = ~context_tree.held_out(F.col("doc_id"))
    rows = context_tree.score(odd, train).collect()
    assert len(rows) == odd.count()
    assert len({round(r.score, 9) for r in rows if r.doc_id == 2}) == 1
    assert context_tree.score(empty, train).count() == 0
    assert context_tree.score(odd, F.lit(False)).count() == odd.count()


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op10_toxicity"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(rows) == docs.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    clean = [r.predicted for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert sum(clean) <= 0.02 * len(clean)
    toxic = [r.predicted for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    assert sum(toxic) >= 0.7 * len(toxic)


def test_toxicity_features_of_long_words_and_texts(monkeypatch):
    """Batches change nothing, whatever their size, and what is held besides a long text or word is small."""
    import random
    import tracemalloc

    rng = random.Random(4)
    texts = ["", "a", "a b", "Straße ÄÖ x" * 9, " ".join("".join(rng.choices("abcdeéж", k=rng.randrange(1, 30))) for _ in range(400)), "w" * 300 + " y z " + "q" * 700 + " a b"]
    plain = [toxicity.features(t).tolist() for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(toxicity, "BATCH", size)
        assert [toxicity.features(t).tolist() for t in texts] == plain
    monkeypatch.undo()
    text = "x" * 20_000_000 + " " + "tail word " * 1_000_000
    tracemalloc.start()
    found = toxicity.features(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text) and len(toxicity._powers[0]) < 40 * toxicity.BATCH
    one = toxicity.features("tail word tail word tail word")
    assert set(one) <= set(found) and len(found) <= len(one) + 1 + len(toxicity.PREFIXES) + 3


def test_toxicity_in_every_language(spark):
    """Held-out rows of the 0.1 table: each language by its own words, of which most are met once."""
    sf_dir = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, sf_dir).filter("held_out").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    found, false = defaultdict(list), []
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        if r.doc_id in rows:
            (found[lang[r.doc_id]] if r.toxic else false).append(rows[r.doc_id].predicted)
    assert sum(map(sum, found.values())) >= 0.8 * sum(map(len, found.values())) and all(sum(x) >= 0.5 * len(x) for x in found.values())
    assert sum(false) <= 0.01 * len(false)


def plain_features(text):
    """Slots by plain integers."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    mask = (1 << 64) - 1
    crc = lambda b: sum(x * pow(0x5851F42D4C957F2D, i, 1 << 64) for i, x in enumerate(b)) & mask
    words = [w.encode() for w in words]
    codes = [crc(w) for w in words] + [crc(w[:k]) ^ 0x51ED270B for w in words for k in (4, 5, 6, 7) if len(w) > k]
    codes += [((crc(a) * 0xC2B2AE3D27D4EB4F + gap) ^ (crc(b) * 0x165667B19E3779F9)) & mask for gap in (1, 2, 3) for a, b in zip(words, words[gap:])]
    mixed = [(c ^ c >> 29) * 0xBF58476D1CE4E5B9 & mask for c in codes]
    return sorted({0} | {(m >> 40) % ((1 << 18) - 1) + 1 for m in mixed})


def test_toxicity_against_plain_ftrl(spark):
    """Scores of every row against FTRL-proximal with dictionaries, in the order that the operator learns in."""
    rows, labels = planted(200)
    docs, marked = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    texts, label = dict(rows), dict(labels)
    order = [r.doc_id for r in docs.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").collect()]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= 15 else -(z[i] - math.copysign(15, z[i])) / (1 + math.sqrt(n[i]))

    for epoch in range(5):
        for k in np.random.default_rng(epoch).permutation(len(order)):
            own, y = plain_features(texts[order[k]]), label[order[k]]
            w = [weight(i) for i in own]
            g = (1 / (1 + math.exp(-sum(w))) - y) * (5 if y else 1)
            for i, v in zip(own, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) * v
                n[i] += g * g
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, marked, F.lit(True))).collect()}
    for i, text in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(weight(k) for k in plain_features(text)))), abs=1e-5)
    few = toxicity.train(docs, marked, F.lit(True), train_rows=20)
    assert few != toxicity.train(docs, marked, F.lit(True)) and set(few) <= set(range(toxicity.DIMENSIONS))


def planted(n=600):
    import random

    r, rows, labels = random.Random(2), [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 30)) for _ in range(r.randint(20, 200))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_planted_words(spark):
    rows, labels = planted()
    docs, marked = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    weights = toxicity.train(docs, marked, ~toxicity.held_out(F.col("doc_id")))
    found = {r.doc_id: r.predicted for r in toxicity.score(docs, weights).collect()}
    tested = [(found[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p for p, y in tested if y) >= 0.9 * sum(y for _, y in tested)
    assert sum(p for p, y in tested if not y) <= 0.02 * len(tested)
    kept = toxicity.reject(docs, weights)
    assert {r.doc_id for r in kept.collect()} == {i for i, p in found.items() if not p}


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (9, 0)], "doc_id bigint, toxic int")
    weights = toxicity.train(odd, labels, F.lit(True))
    assert toxicity.score(odd, weights).count() == odd.count()
    kept = toxicity.reject(odd, weights)
    assert kept.columns == odd.columns
    assert toxicity.score(empty, {}).count() == 0
    assert {r.score for r in toxicity.score(odd, {}).collect()} == {0.5}
    assert toxicity.train(empty, labels, F.lit(True)) == {}


def test_toxicity_slots_are_kept_in_about_a_byte_each():
    rng = np.random.default_rng(5)
    for slots in ([], [0], [0, 254], [0, 255], [0, 510, 511], [0, toxicity.DIMENSIONS - 1], np.unique(rng.integers(0, toxicity.DIMENSIONS, 3000))):
        slots = np.array(slots, np.int64)
        packed = toxicity.pack(slots)
        assert toxicity.unpack(packed).tolist() == slots.tolist() and len(packed) <= len(slots) + toxicity.DIMENSIONS // 255
    found = toxicity.features(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(600)))
    assert len(toxicity.pack(found)) < 1.5 * len(found)
