"""Operators 11 to 13 against brute force, on the tables and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwick.llm import collocations, line_dedup, whitening
from tarnwick.llm.queries import QUERIES

UPPER = re.compile("[A-Z]")


def low(text):
    return UPPER.sub(lambda m: m[0].lower(), text or "")


def brute_phrases(rows, least=30, top=2000):
    """rows: (lang, text); the contract in plain Python integers."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + m] for p, a in own.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[p[i : i + m]]}
        found = []
        for p, a in own.items():
            if p not in inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, totals[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(docs, **options):
    return sorted(tuple(r) for r in collocations.mine(docs, **options).collect())


def test_phrases_of_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = brute_phrases([(r.lang, r.text) for r in docs.collect()])
    assert wanted and sorted(tuple(r) for r in QUERIES["op11_collocations"](spark, sf_dir).collect()) == wanted


def test_small_shards_full_sketches_and_ties(spark):
    rows = [("en", "New York, new york! the new york times; A b a b a b a b\tc. x y"), (None, "un deux trois quatre cinq"), ("und", "un deux\x0bun deux trois"), ("", "a b . a\nb"), ("en", None), ("de", "Ä ä Ä b \x1cc ä Ä b")] * 3
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(3)
    for options in ({}, {"shard_size": 4}, {"bits": 6}, {"bits": 6, "shard_size": 7}):
        assert mined(docs, least=2, top=5, **options) == brute_phrases(rows, 2, 5)


def test_phrases_of_odd_and_empty_tables(spark, odd, empty):
    assert mined(odd, least=2) == brute_phrases([(r.lang, r.text) for r in odd.collect()], 2)
    assert mined(empty) == [] and collocations.mine(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \t\n.Ä", max_size=120), st.integers(1, 12))
def test_segments_lose_and_repeat_no_phrase(text, size):
    old, collocations.SEGMENT = collocations.SEGMENT, size
    try:
        cut = list(collocations.segments(text))
    finally:
        collocations.SEGMENT = old
    got, scanned = Counter(), Counter()
    for context, fresh in cut:
        data = context + b" " + fresh if context else fresh
        words = collocations.Words(data, [(0, len(context))] if context else [])
        for n in range(1, 5):
            for i in words.phrases(n).tolist():
                got[tuple(data[words.starts[i + j] : words.ends[i + j]].decode() for j in range(n))] += 1
        scanned[collocations._guarded(data).replace("\n", " ").strip() == ""] += 1
    wanted = Counter()
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
        words = re.findall(r"[^\x20\x09]+", piece)
        for n in range(1, 5):
            wanted.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    assert got == wanted


def test_long_text_without_a_piece_end_and_a_long_word(spark):
    text = "one two three four five " * 120_000 + "w" * 3_000_000 + " one two"
    assert mined(spark.createDataFrame([("en", text)], "lang string, text string")) == brute_phrases([("en", text)])


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    data = (b"ab" * 5000 + b" cd " + b"x" * 20_000 + b" ab\n") * 3
    whole = collocations.Words(data, []).hashes
    monkeypatch.setattr(collocations, "CHUNK", 4 * 777)
    assert (collocations.Words(data, []).hashes == whole).all() and len(set(whole.tolist())) == 4


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a b", big), ("en", "a", big), ("en", "b", 7), ("en", "a b c", big - 1), ("en", "b c", big), ("en", "c", big)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, n bigint")
    found = {r.phrase: r for r in collocations.scores(counts.filter("phrase IN ('a b', 'a', 'b')")).collect()}
    assert found["a b"].score == 2_000_000 * big // (big + 7)
    phrases = spark.createDataFrame([("en", "a b", big), ("en", "b c", big), ("en", "x y", 5), ("en", "x y z", 4), ("en", "a b c", big * 8 // 10 - 1)], "lang string, phrase string, a bigint")
    assert {r.phrase for r in collocations.free(phrases).collect()} == {"a b", "b c", "a b c", "x y z"}


def brute_whitening(rows):
    """rows: (id, vector); n, S, x and, by dense algebra, eigenvalues and projections."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in good], dtype=object)
    n, s = len(good), x.sum(axis=0)
    deviation = [sum(int(n * e - t) ** 2 for e, t in zip(row, s)) for row in x]
    centred = np.array([[float(n * e - t) / n for e, t in zip(row, s)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return [i for i, _ in good], deviation, centred, values[order], vectors[:, order].T


def check_whitening(got, rows, count=8):
    ids, deviation, centred, values, vectors = brute_whitening(rows)
    assert len(got) == len(ids) * min(count, len(values))
    table = {(r.vec_id, r.component): r for r in got}
    for k in range(min(count, len(values))):
        own = [table[i, k + 1] for i in ids]
        assert [int(r.deviation) for r in own] == deviation and {r.n for r in own} == {len(ids)}
        assert np.allclose([r.explained for r in own], values[k] / values.sum(), rtol=1e-9)
        wanted, seen = centred @ vectors[k] / np.sqrt(values[k]), np.array([r.whitened for r in own])
        assert min(np.abs(seen - wanted).max(), np.abs(seen + wanted).max()) < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_embeddings_against_dense_algebra(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op12_whitening"](spark, sf_dir).collect(), rows)


def test_whitening_of_odd_vectors(spark, monkeypatch):
    rng, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, [1.0, nan, 2.0]), (43, [inf, 0.0, 0.0]), (44, [-0.00001, 100.0, -100.0]), (None, [0.5, 0.25, 0.125])]
    bad = [(45, [1.0]), (46, [1.0, 2.0, 3.0, 4.0]), (47, [])]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows + bad], "vec_id bigint, embedding array<double>, whitened double, x int")
    check_whitening(whitening.components(docs).collect(), rows)
    monkeypatch.setattr(whitening, "PAIRS", 2)
    check_whitening(whitening.components(docs, count=2).collect(), rows, 2)


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.components(spark.createDataFrame([], schema)).collect() == []
    assert whitening.components(spark.createDataFrame([(1, None)], schema)).collect() == []
    one = whitening.components(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    flat = whitening.components(spark.createDataFrame([(i, [float(i), 3.0]) for i in range(4)], schema)).collect()
    assert {r.whitened for r in flat if r.component == 2} == {0.0} and max(r.identity_error for r in flat) < 1e-9


def brute_lines(rows, length=40, least=5):
    """rows: (id, text); per row its lines in all, those that go, and the text that stays."""
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= length:
                holders[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least or max(holders[key(x)]) == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_of_documents_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_line_dedup"](spark, sf_dir).collect()), key=str)
    assert got == brute_lines(rows) and any(r[2] for r in got)


def test_line_dedup_of_odd_rows(spark, odd, empty):
    long, other = "This line is long enough to be counted at all.", "Ünïcödé line of just forty code points.."
    assert len(other) == 40
    rows = [(i, f"{long}\nown {i}\n\t {long.upper()} \r\n{long}") for i in range(4)]
    rows += [(None, f"x\n{long}\n{other}"), (None, long), (2, "another text of document two\n" + long), (3, rows[3][1])]
    rows += [(i, f"{other}\n\n{other[:-1]}") for i in range(10, 16)] + [(30, None), (31, ""), (32, "\n\n"), (33, f"a\n{other}\nb\n{other}\n")]
    docs = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "doc_id bigint, text string, row int, pos int, bitmap string").repartition(4)
    assert sorted((tuple(r) for r in line_dedup.digest(docs).collect()), key=str) == brute_lines(rows)
    cut = line_dedup.deduplicate(docs)
    assert cut.columns == docs.columns and cut.filter("doc_id = 30").first().text is None
    assert sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut.collect()), key=str) == sorted(((i, h) for i, _, _, h in brute_lines(rows)), key=str)
    assert sorted((tuple(r) for r in line_dedup.digest(odd).collect()), key=str) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert line_dedup.digest(empty).collect() == [] and line_dedup.deduplicate(empty).columns == empty.columns


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_stream_decides_alike_whatever_its_blocks(monkeypatch, size):
    """Runs cut by blocks and ranges: decided rows and open rows with their summaries give the plain result."""
    monkeypatch.setattr(line_dedup, "BLOCK", size)
    rng = np.random.default_rng(size)
    rows = sorted({(int(h), 0, int(d), 0, int(p)) for h, d, p in zip(rng.choice([1, 2, 3, 4, 5], 400, p=[0.6, 0.1, 0.1, 0.1, 0.1]), rng.integers(0, 60, 400), rng.integers(0, 3, 400))}, key=lambda r: (r[0], r[1], -r[2], r[3], r[4]))
    cuts = [i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]][::29]
    got, opened, tops = set(), [], defaultdict(lambda: [0, -1])
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 5])], ["h1", "h2", "doc", "row", "pos"]) for k in range(a, b, 5)]
        batches[-1] = batches[-1].slice(0, (b - a) - 5 * (len(batches) - 1))
        for part in line_dedup._blocks(batches):
            for batch in line_dedup._decided(part, 5):
                for r in batch.to_pylist():
                    if r["kind"] == line_dedup.DROP:
                        got.add((r["h1"], r["doc"], r["pos"]))
                    elif r["kind"] == line_dedup.OPEN:
                        opened.append((r["h1"], r["doc"], r["pos"]))
                    else:
                        own = tops[r["h1"]]
                        own[0], own[1] = own[0] + r["pos"], max(own[1], r["doc"])
    got |= {(h, d, p) for h, d, p in opened if tops[h][0] >= 5 and d != tops[h][1]}
    docs = defaultdict(set)
    for h, _, d, _, _ in rows:
        docs[h].add(d)
    assert got == {(h, d, p) for h, _, d, _, p in rows if len(docs[h]) >= 5 and d != max(docs[h])}


def test_bitmaps_are_runs_in_order(spark):
    line = "a line that is certainly longer than forty code points"
    rows = [(i, "\n".join(["head", line, line, "middle", line])) for i in range(5)]
    found = {r.doc: [tuple(x) for x in r.bitmap] for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found == {i: [(1, 2), (4, 1)] for i in range(4)}
    assert line_dedup.keep_bitmaps(spark.createDataFrame(rows[:4], "doc_id int, text string")).count() == 0


def test_new_phrases_are_told_without_sorting_the_known_again(monkeypatch):
    rng = np.random.default_rng(3)
    own, sorts = np.zeros(0, np.uint64), []
    unique = np.unique
    monkeypatch.setattr(collocations.np, "unique", lambda x, *a, **k: (sorts.append(len(x)), unique(x, *a, **k))[1])
    for n in (0, 5, 400, 400, 3):
        named = rng.integers(0, 600, n, dtype=np.uint64)
        fresh, grown = collocations._added(own, named)
        assert fresh.tolist() == (~np.isin(named, own)).tolist() and grown.tolist() == unique(np.r_[own, named]).tolist() and grown.dtype == np.uint64
        assert sorts[-1] == fresh.sum()
        own = grown
