import datetime
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick import runtime
from tarnwick.functions import identity, similarity
from tarnwick.operators import catalog, components, evaluation, graph, label_search, matching, precedents, retrieval
from tarnwick.operators.components import connected_components

NAMED = "vendor string, product_id string, name string, node_iri string, decision string, decided_by string, confidence double, provisional boolean, decided_at_ms bigint, seq bigint"


def log(spark, *steps):
    """steps: (node, decision) or (node, decision, provisional) in time order, for one product."""
    rows = [("v", "p", "Spot Rates", s[0], s[1], "u", 0.9, len(s) > 2 and s[2], 1000 + i, i) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, NAMED)


def held(spark, *steps):
    return [r.node_iri for r in precedents.current_positive(log(spark, *steps)).collect()]


def barred(spark, *steps):
    return sorted(r.node_iri for r in precedents.current_negatives(log(spark, *steps)).collect())


def test_decision_sequences(spark):
    assert held(spark, ("a", "approve"), ("b", "override")) == ["b"]
    assert held(spark, ("a", "approve"), ("a", "reject")) == [] and barred(spark, ("a", "approve"), ("a", "reject")) == ["a"]
    assert held(spark, ("a", "approve"), ("b", "reject")) == ["a"] and barred(spark, ("a", "approve"), ("b", "reject")) == ["b"]
    assert held(spark, ("a", "reject"), ("a", "approve")) == ["a"] and barred(spark, ("a", "reject"), ("a", "approve")) == []
    assert held(spark, ("a", "approve"), ("b", "approve", True)) == ["a"]


steps = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["approve", "override", "reject"])), max_size=12)


def test_replay_equals_fold(spark):
    import random

    r = random.Random(4)
    cases = [[(r.choice("abc"), r.choice(["approve", "override", "reject"])) for _ in range(r.randint(0, 10))] for _ in range(60)]
    rows = [("v", str(k), "N", node, d, "u", 1.0, False, 10 + i, i) for k, case in enumerate(cases) for i, (node, d) in enumerate(case)]
    events = spark.createDataFrame(rows, NAMED)
    got = {r.product_id: r.node_iri for r in precedents.current_positive(precedents.replay(events.union(events))).collect()}
    bars = {(r.product_id, r.node_iri) for r in precedents.current_negatives(events).collect()}
    for k, case in enumerate(cases):
        positive, negative = None, set()
        for node, d in case:
            if d == "reject":
                positive = None if positive == node else positive
                negative.add(node)
            else:
                positive = node
                negative.discard(node)
        assert got.get(str(k)) == positive
        assert {n for p, n in bars if p == str(k)} == negative


def test_bundle_round_trip(spark):
    events = log(spark, ("a", "approve"), ("b", "override"))
    nodes, vendors = spark.createDataFrame([("b",)], "node_iri string"), spark.createDataFrame([("v",)], "vendor string")
    bundle = precedents.export_bundle(events)
    pattern = json.loads(bundle.first().pattern)
    assert pattern["mapped_node_iri"] == "b" and pattern["rank"] == 1 and pattern["provenance"]["decided_at"] == "1970-01-01T00:00:01.001Z"
    fresh, counts = precedents.import_bundle(bundle, "1.2", nodes, vendors, events.limit(0))
    assert fresh.count() == 1 and [tuple(r) for r in counts.collect()] == [("applied", 1)]
    again, _ = precedents.import_bundle(bundle, "1.2", nodes, vendors, fresh.withColumn("seq", F.lit(0)))
    assert again.count() == 0
    assert [r.outcome for r in precedents.import_bundle(bundle, "1.0", nodes.limit(0), vendors.limit(0), events)[1].collect()] == ["skipped_unknown_node"]
    with pytest.raises(ValueError):
        precedents.import_bundle(bundle, "2.0", nodes, vendors, events)


def test_hydration(spark, tmp_path):
    assert precedents.hydrate(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception):
        precedents.hydrate(spark, f"file://{tmp_path}/none", strict=True)
    precedents.export_bundle(log(spark, ("a", "approve"))).select("pattern").write.text(f"file://{tmp_path}/b")
    assert [r.mapped_node_iri for r in precedents.hydrate(spark, f"file://{tmp_path}/b").collect()] == ["a"]


RULES = "policy_key string, kind string, target string, assignee string, action string, has_constraint boolean, ord int"


def test_scope(spark):
    schema = "vendor string, product_id string, iri string, target_iri string"
    products = spark.createDataFrame([("acme", str(i), f"mds:{i}", None) for i in range(7)] + [("other", "9", "mds:9", None)], schema)
    rules = spark.createDataFrame([
        ("mds:1", "permission", None, None, "use", False, 1), ("mds:2", "permission", None, None, "use", True, 1), ("mds:3", "permission", None, "someone", "use", False, 1),
        ("mds:4", "prohibition", None, None, "all", False, 0), ("mds:4", "permission", None, None, "use", False, 1), ("mds:5", "permission", "mds:else", None, "use", False, 1), ("mds:6", "permission", None, None, "sell", False, 1),
    ], RULES)
    vendors = spark.createDataFrame([("acme",)], "vendor string")
    got = {r.product_id: (r.allowed, r.reason) for r in matching.scope(products, rules, vendors).collect()}
    assert got == {
        "0": (True, "no policy, vendor in scope"), "1": (True, "permission granted"), "2": (False, "unmatched constraint"), "3": (False, "assignee mismatch"),
        "4": (False, "prohibited"), "5": (False, "no matching permission"), "6": (False, "no matching permission"), "9": (False, "vendor out of scope"),
    }
    assert sorted(r.product_id for r in matching.list_frames(products, "acme", rules, vendors).collect()) == ["0", "1"]


def test_publish_gate(spark):
    schema = "k string, route string, verifier int, confidence double, self_flag boolean, target_iri string, product_iri string, minted_iri string, candidate_iris array<string>, triples array<struct<subject:string,graph:string>>"
    ok = dict(route="new", verifier=18, confidence=0.9, self_flag=False, target_iri="t", product_iri="mds.v:1", minted_iri="mds.v:1", candidate_iris=["t"], triples=[("mds.v:1", "g")])
    cases = {"published": {}, "hitl": {"verifier": 3}, "retry": {"verifier": 13}, "research_queued": {"route": "research"}, "rejected": {"target_iri": "off"}, "rejected ": {"minted_iri": "mds.v:2"}, "rejected  ": {"triples": []}, "hitl ": {"self_flag": True}}
    rows = [(k, *(ok | v).values()) for k, v in cases.items()]
    assert all(r.outcome == r.k.strip() for r in matching.publish(spark.createDataFrame(rows, schema)).collect())


def test_snapshot_changes(spark):
    t = datetime.datetime
    rows = [("a", t(2024, 1, 2), t(2024, 1, 5)), ("b", t(2024, 1, 1), t(2024, 1, 3)), ("c", t(2024, 1, 1), t(2024, 1, 1)), ("d", t(2024, 1, 2), None)]
    snap = spark.createDataFrame(rows, "vendor_product_ref string, created_at timestamp, modified_at timestamp")
    gone = spark.createDataFrame([("z", t(2024, 1, 9))], "vendor_product_ref string, removed_at timestamp")
    since = F.lit("2024-01-01").cast("timestamp")
    got = {(r.change_type, r.vendor_product_ref) for r in catalog.delta(snap, gone, since).collect()}
    assert got == {("ADDED", "a"), ("ADDED", "d"), ("UPDATED", "b"), ("REMOVED", "z")}
    assert catalog.next_watermark(snap, gone, since).first()[0] == t(2024, 1, 9)
    assert catalog.next_watermark(snap.limit(0), gone.limit(0), since).first()[0] == t(2024, 1, 1)
    with pytest.raises(ValueError):
        catalog.delta(snap.drop("modified_at"), gone, since)


def test_pages_and_cursors(spark):
    snap = spark.createDataFrame([(f"r{i}", i) for i in range(5)], "vendor_product_ref string, version int")
    rows, cursor = catalog.list_products(snap, "v", limit=3)
    assert [r.vendor_product_ref for r in rows] == ["r0", "r1", "r2"]
    rows, last = catalog.list_products(snap, "v", cursor, 3)
    assert [r.vendor_product_ref for r in rows] == ["r3", "r4"] and last is None
    for bad in (lambda: catalog.list_products(snap, "w", cursor, 3), lambda: catalog.list_products(snap, "v", limit=0), lambda: catalog.decode_cursor("?", "v", None)):
        with pytest.raises(ValueError):
            bad()
    assert [r.vendor_product_ref for r in catalog.keyset_page(snap, "r2").collect()] == ["r3", "r4"]
    assert catalog.get_schema(snap) == [{"name": "vendor_product_ref", "type": "string", "required": True}, {"name": "version", "type": "integer", "required": False}]


def plain_bm25(query, docs):
    import math

    terms = [retrieval._tokens(d) for d in docs]
    n, mean = len(docs), sum(map(len, terms)) / len(docs)
    out = [0.0] * n
    for t in retrieval._tokens(query):
        df = sum(t in x for x in terms)
        for i, x in enumerate(terms):
            f = x.count(t)
            out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(x) / mean))
    return out


def test_bm25_relational_and_in_task(spark):
    docs, query = ["equity prices daily", "fx spot rates", "equity index", "bond prices prices"], "equity prices prices"
    wanted = plain_bm25(query, docs)
    frame = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    asked = spark.createDataFrame([(1, query)], "q int, text string")
    got = {r.doc: r.score for r in retrieval.bm25(asked, frame, "q", F.col("text"), "id", F.col("text")).collect()}
    assert {i for i, w in enumerate(wanted) if w} == set(got)
    assert all(got[i] == pytest.approx(wanted[i]) for i in got)
    lexicon = retrieval._Lexicon([(str(i), d, d) for i, d in enumerate(docs)])
    assert list(lexicon.bm25(query, list(range(4))).values()) == pytest.approx(wanted)


def test_bm25_joins_terms_beyond_the_broadcast_size(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "fx spot rates"), (2, None), (3, ""), (4, "spot spot")], "id int, text string")
    asked = spark.createDataFrame([(1, "spot fx"), (2, None)], "q int, text string")
    run = lambda: sorted((r.query, r.doc, round(r.score, 9)) for r in retrieval.bm25(asked, docs, "q", F.col("text"), "id", F.col("text")).collect())
    small = run()
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", -1)
    assert run() == small and [r[:2] for r in small] == [(1, 1), (1, 4)]


@given(st.lists(st.text("abAB é漢", max_size=8), max_size=12), st.text("abAB é漢", max_size=8), st.integers(1, 4), st.sampled_from([0.0, 0.5]))
@settings(max_examples=300, deadline=None)
def test_nearest_equals_comparing_all(labels, query, k, least):
    scored = [(round(similarity.jaro_winkler_of(query, label), 4), f"n{i:02}") for i, label in enumerate(labels)]
    wanted = sorted(((s, iri) for s, iri in scored if s >= least), key=lambda x: (-x[0], x[1]))[:k]
    found = label_search.Labels([(f"n{i:02}", label) for i, label in enumerate(labels)]).best(query, k, least)
    assert [(s, iri) for iri, s in found] == wanted


@given(st.lists(st.text("abAB é漢", max_size=8), min_size=1, max_size=12), st.text("abAB é漢", max_size=8))
@settings(max_examples=300, deadline=None)
def test_summaries_bound_every_label(labels, query):
    summary = label_search.Summaries([label_search.Summaries.of(label_search.Labels([(None, x) for x in labels[i : i + 5]]), 7) for i in range(0, len(labels), 5)])
    best = max(similarity.jaro_winkler_of(query, x) for x in labels)
    assert summary.blocks.tolist() == [7] and summary.bounds(query.lower().strip())[0] >= best - 1e-9


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_nearest_on_odd_rows(spark, held):
    nodes = spark.createDataFrame([("b", "Spot"), ("a", "spot"), ("c", None), ("d", ""), (None, "spat"), ("e", "x" * 100_000)], "iri string, label string")
    products = spark.createDataFrame([(1, "spot", "x"), (1, "spot", "y"), (2, None, None), (None, "x" * 100_000, None)], "product int, query string, iri string")
    run = lambda a, b: retrieval.nearest(a, b, 3, held_bytes=held, block=2)
    rows = sorted(((r.product or 0, r["rank"], r.iri, r.similarity) for r in run(products, nodes).collect()), key=str)
    spot = [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (1, 3, None, 0.8667)]
    assert [r for r in rows if r[0] == 1] == sorted(spot * 2, key=str)
    assert [r[1:] for r in rows if r[0] == 2][:2] == [(1, "c", 1.0), (2, "d", 1.0)]
    assert [r[1:] for r in rows if r[0] == 0][0] == (1, "e", 1.0)
    assert run(products, nodes.limit(0)).count() == 0 and run(products.limit(0), nodes).count() == 0
    assert run(products, nodes.filter("iri IS NULL")).count() == 4


def test_nearest_by_blocks_equals_comparing_all(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 14)))
    labels = [word() for _ in range(400)]
    nodes = [(f"n{i:03}", x) for i, x in enumerate(labels + labels[:50] + ["same"] * 60)]
    asked = [(i, word() if i % 3 else "hot text") for i in range(90)] + [(90, "same")]
    monkeypatch.setattr(label_search, "VISITS", 8)
    found = retrieval.nearest(spark.createDataFrame(asked, "product int, query string"), spark.createDataFrame(nodes, "iri string, label string"), 4, 0.3, held_bytes=0, block=16).collect()
    wanted = []
    for product, query in asked:
        scored = [(-round(similarity.jaro_winkler_of(query, label), 4), iri) for iri, label in nodes]
        wanted += [(product, rank, iri, -s) for rank, (s, iri) in enumerate(sorted(x for x in scored if -x[0] >= 0.3)[:4], 1)]
    assert sorted((r.product, r["rank"], r.iri, r.similarity) for r in found) == sorted(wanted)


def test_default_path(spark):
    nodes = spark.createDataFrame([("n1", "equity prices", "equity prices", 1), ("n2", "equity index", "equity index", 2), ("n3", "zz", "zz", 3)], "iri string, label string, lexical string, ord int")
    schema = "product string, query string, negatives array<string>, boosts map<string,bigint>"
    ask = lambda *row: {r.iri: r for r in retrieval.rank_all(spark.createDataFrame([row], schema), nodes, 5, min_similarity=0.3).collect()}
    plain, boosted, without = ask("p", "equity price", None, None), ask("p", "equity price", [], {"n2": 9}), ask("p", "equity price", ["n1"], {})
    assert list(plain) == ["n1", "n2"] and list(without) == ["n2"]
    assert boosted["n2"].similarity == plain["n2"].similarity and boosted["n2"].fused > plain["n2"].fused
    with pytest.raises(ValueError):
        retrieval.MOST_NODES = 2
        try:
            ask("p", "q", None, None)
        finally:
            retrieval.MOST_NODES = 50_000


def test_fusion_gives_ties_different_ranks(spark):
    rows = [(r, "q", d, o, s) for r, s in (("a", 0.0), ("b", 1.0)) for d, o in (("x", 1), ("y", 2))]
    got = {r.doc: r.fused for r in retrieval.fuse(spark.createDataFrame(rows, "ranker string, query string, doc string, ord int, score double")).collect()}
    assert got == {"x": pytest.approx(2 / 61), "y": pytest.approx(2 / 62)}


def test_degraded_scores_and_shadow(spark):
    pairs = spark.createDataFrame([("p", "q", "l", "n1"), ("p", "q", "m", "n2")], "product string, query string, label string, iri string")
    assert {r.similarity for r in retrieval.rescore(pairs, "query", "label", "product", "iri", F.lit(0.0), scorer=None).collect()} == {0.5}
    a, b = spark.createDataFrame([("q", 1), ("q", 2)], "query string, doc int"), spark.createDataFrame([("q", 2), ("q", 3)], "query string, doc int")
    assert sorted((r.doc, r.side) for r in retrieval.shadow_diff(a, b).collect()) == [(1, "live"), (3, "shadow")]


LADDER = "product string, allowed boolean, precedent_iri string, precedent_decision string, candidates array<struct<iri:string,similarity:double>>, node_iri string, node_in_store boolean, name string, description string, raw map<string,string>, node_class string, temporal_coverage string, node_coverage string, pick_iri string, pick_score double, specialist_required boolean"


def ladder(spark, options=matching.Options(), **values):
    base = dict(product="p", allowed=True, precedent_iri=None, precedent_decision=None, candidates=[("n1", 0.9), ("n2", 0.5)], node_iri="n1", node_in_store=True, name="Spot Rates", description="d", raw={}, node_class=None, temporal_coverage=None, node_coverage=None, pick_iri=None, pick_score=None, specialist_required=False)
    return matching.decide(spark.createDataFrame([tuple((base | values).values())], LADDER), options).first()


def test_ladder(spark):
    run = lambda **v: ladder(spark, **v)
    near = [("n1", 0.76), ("n2", 0.5)]
    cases = [
        (run(), ("auto_mapped", "pass", 0.9, "n1")), (run(allowed=False), ("out_of_scope", "n/a", 0.0, None)),
        (run(precedent_iri="z", precedent_decision="override"), ("overridden", "n/a", 1.0, "z")), (run(node_in_store=False), ("needs_review", "fail", 0.9, "n1")),
        (run(candidates=[]), ("needs_review", "fail", 0.0, None)), (run(candidates=near), ("auto_mapped", "borderline", 0.76, "n1")),
        (run(candidates=near, specialist_required=True), ("needs_review", "borderline", 0.76, "n1")), (run(candidates=near, pick_iri="off"), ("needs_review", "borderline", pytest.approx(0.69), "n1")),
        (run(candidates=near, pick_iri="n1", pick_score=0.95), ("auto_mapped", "borderline", 0.76, "n1")), (run(candidates=near, pick_iri="n1", pick_score=0.6), ("needs_review", "borderline", 0.6, "n1")),
        (run(candidates=near, pick_iri="n2", pick_score=0.9), ("needs_review", "borderline", pytest.approx(0.69), "n1")), (run(candidates=[("n1", 0.6)]), ("needs_review", "fail", 0.6, "n1")),
    ]
    for got, wanted in cases:
        assert (got.status, got.band, got.confidence, got.mapped_node_iri) == wanted
    close = [("n1", 0.9), ("n2", 0.89)]
    assert run(candidates=close).status == "auto_mapped"
    assert ladder(spark, matching.Options(margin_gate=True), candidates=close).status == "needs_review"


def names_of(row):
    return {v.name: v.status for v in row.validations}


def test_scorer_never_fails(spark):
    def broken(a, b):
        if (a == "x").any():
            raise RuntimeError("no answer")
        return a.str.len() * 0.4

    pairs = spark.createDataFrame([("p", "n1", "x", "l"), ("q", "n2", "a", "l"), ("q", "n3", "abcd", "l")], "product string, iri string, query string, label string")
    got = retrieval.rescore(pairs, "query", "label", "product", "iri", F.lit(0.0), scorer=retrieval.guarded(broken)).collect()
    assert {r.iri: r.similarity for r in got} == {"n1": 0.5, "n2": 0.4, "n3": 1.0}


def test_functions_from_sql(spark):
    from tarnwick.functions import similarity

    similarity.register(spark)
    row = spark.sql("SELECT uuid5('a::b') AS u, parse_temporal('2020-02') AS m, parse_temporal('2021') AS y, parse_temporal('2021-13') AS bad, parse_temporal(' 2021-03-04 ') AS d, bm25_tokens('A.b c') AS t, jaro_winkler('abc', 'abd') AS j").first()
    assert row.u == str(__import__("uuid").uuid5(identity.NAMESPACE, "a::b"))
    assert [str(x) for x in (*row.m, *row.y, *row.d)] == ["2020-02-01", "2020-02-29", "2021-01-01", "2021-12-31", "2021-03-04", "2021-03-04"] and row.bad is None
    assert row.t == ["a.b", "c"] and 0.8 < row.j < 1


def test_validation_switches(spark):
    full = matching.Options(input_completeness=True, temporal=True, asset_class=True)
    off = ladder(spark, matching.Options(), raw={"asset_class": "FX"}, node_class="Bond")
    assert names_of(off)["data_class_match"] == "pass"  # classes are compared only where the switch is set
    names = lambda r: {v.name: v.status for v in r.validations}
    assert list(names(ladder(spark))) == ["scope_compatible", "identifier_resolves", "data_class_match", "name_length", "description_length"]
    got = ladder(spark, full, name="EQ-01", raw={"coverage_start": "2021", "asset_class": "FX"}, node_class="Bond", node_coverage="2019-2020")
    assert names(got) == {"scope_compatible": "pass", "identifier_resolves": "pass", "data_class_match": "fail", "name_length": "pass", "description_length": "pass", "input_completeness": "fail", "temporal_compatible": "fail"}
    assert names(ladder(spark, full, raw={"as_of": "2025"}, node_coverage="2019"))["temporal_compatible"] == "pass"
    assert names(ladder(spark, name="x" * 201))["name_length"] == "warn"


def test_thresholds():
    assert matching.thresholds() == (0.80, 0.70) and matching.thresholds(0.8, 0.05) == (0.85, 0.75)
    for bad in ((0.8, None), (0.99, 0.05), (True, 0.1), (0.8, 0.0)):
        with pytest.raises(ValueError):
            matching.thresholds(*bad)


def tree(spark, *pairs):
    return spark.createDataFrame(list(pairs), "child string, parent string")


def test_closure_and_cycles(spark):
    edges = tree(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("s", "s"), ("c", "r"))
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(edges).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 1, ("c", "r"): 1, ("b", "r"): 2, ("a", "r"): 2, ("x", "y"): 1, ("y", "x"): 1}
    assert graph.closure(edges, 1).count() == 6
    assert sorted((r.node, r.component) for r in graph.cyclic_components(edges).collect()) == [("s", "s"), ("x", "x"), ("y", "x")]


def test_paths_and_common_ancestors(spark):
    edges = tree(spark, ("a", "p"), ("b", "p"), ("p", "r"), ("b", "q"), ("q", "r"), ("z", "y"))
    pairs = spark.createDataFrame([("a", "b"), ("a", "q"), ("a", "z")], "source string, target string")
    got = {(r.source, r.target): r.path for r in graph.shortest_paths(edges, pairs).collect()}
    assert got == {("a", "b"): ["a", "p", "b"], ("a", "q"): ["a", "p", "b", "q"]}
    assert graph.shortest_paths(edges, pairs, 2).count() == 1
    lca = graph.lowest_common_ancestors(edges, spark.createDataFrame([("a", "b"), ("a", "q"), ("p", "b")], "a string, b string"))
    assert {(r.a, r.b): (r.lca, r.distance_a, r.distance_b) for r in lca.collect()} == {("a", "b"): ("p", 1, 1), ("a", "q"): ("r", 2, 1), ("p", "b"): ("p", 0, 1)}


def test_components_of_chain_star_and_loop(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (None, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src int, dst int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 500: 500}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_temporal_check_reads_each_declaration_once(spark):
    assert str(matching.validations(matching.Options(temporal=True))).count("node_coverage") == 1
    given = [("2020", "2010 to 2012"), ("2020", "2019/"), ("2020", None), (None, "2020"), ("x", "2020"), ("2020", "x"), ("2019-05/", "2019-01 to 2019-05")]
    rows = spark.createDataFrame(given, "a string, b string")
    from tarnwick.functions import temporal

    assert [r.ok for r in rows.select(temporal.compatible(F.col("a"), F.col("b")).alias("ok")).collect()] == [False, True, True, True, True, True, True]


def test_pagerank_rounds_leave_out_nodes_of_one_edge(spark, monkeypatch):
    pairs = [(f"l{i}", f"h{i % 5}") for i in range(200)] + [(f"h{i}", "top") for i in range(5)] + [("x", "y"), ("s", "h0"), ("top", "h0")]
    seeds = ["s", "h1"]
    sizes, real = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: sizes.setdefault(name, []).append(real(df, name)) or sizes[name][-1])
    ranks, converged = graph.pagerank(tree(spark, *pairs), spark.createDataFrame([(s,) for s in seeds], "n string"), tolerance=1e-4)
    nodes = sorted({n for p in pairs for n in p})
    place = {n: i for i, n in enumerate(nodes)}
    links = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs:
        links[place[a], place[b]] = links[place[b], place[a]] = 1
    restart = np.array([(n in seeds) / len(seeds) for n in nodes])
    wanted = np.linalg.solve(np.eye(len(nodes)) - 0.85 * (links / links.sum(axis=0)), 0.15 * restart)
    found = {r.node: r.rank for r in ranks.collect()}
    assert converged and sorted(found) == nodes and np.allclose([found[n] for n in nodes], wanted / wanted.sum(), atol=1e-4)
    assert sizes["ranks"][-1].count() == 7 and sizes["inner"][-1].count() == 12  # five hubs, their top and the seed s


def test_components_deal_a_round_out_by_its_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 10_000 + i % 40) for i in range(4_000)] + [(7, 7), (None, 3)], "src bigint, dst bigint")
    used, real = [], components.written
    monkeypatch.setattr(runtime, "TASK_ROWS", 200)
    monkeypatch.setattr(components, "written", lambda df, name: used.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or real(df, name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = components.connected_components(rows).collect()
    assert max(used) >= 2 * 4_000 // 200 and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert {r.node: r.component for r in found} == {n: n % 40 for n in range(4_000)} | {10_000 + n: n for n in range(40)}


def test_pagerank_against_algebra(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")]
    ranks, converged = graph.pagerank(tree(spark, *pairs), spark.createDataFrame([("a",), ("lone",)], "n string"), tolerance=1e-9)
    names = ["a", "b", "c", "d", "lone"]
    m, seed = np.zeros((5, 5)), np.array([0.5, 0, 0, 0, 0.5])
    for x, y in pairs:
        for u, v in ((x, y), (y, x)):
            m[names.index(v), names.index(u)] = 1
    m = m / np.maximum(m.sum(axis=0), 1)
    m[:, 4] = seed
    wanted = np.linalg.solve(np.eye(5) - 0.85 * m, 0.15 * seed)
    got = {r.node: r["rank"] for r in ranks.collect()}
    assert converged and [got[n] for n in names] == pytest.approx(wanted.tolist(), abs=1e-7)
    assert sum(got.values()) == pytest.approx(1)
    assert not graph.pagerank(tree(spark, *pairs), spark.createDataFrame([("a",)], "n string"), max_iterations=2)[1]


SKOS = graph.SKOS
TYPE = graph.RDF + "type"


def test_nodes_and_diagnostics(spark):
    quads = [("c:a", TYPE, SKOS + "Concept"), ("c:a", graph.RDFS + "label", "late"), ("c:a", SKOS + "prefLabel", "A"), ("c:a", SKOS + "broader", "c:r"), ("c:a", SKOS + "broader", "c:b"), ("c:a", SKOS + "altLabel", "x"), ("c:a", graph.DCAT + "keyword", "k"), ("c:a", graph.DCAT + "theme", "c:t"), ("c:a", SKOS + "definition", "D"), ("c:r", TYPE, graph.OWL + "Class"), ("c:q", "p", "o")]
    nodes = {r.iri: r for r in graph.nodes_from_quads(spark.createDataFrame(quads, "subject string, predicate string, object string")).collect()}
    a = nodes["c:a"]
    assert set(nodes) == {"c:a", "c:r"} and (a.label, a.parent_iri, a.alt_labels, a.superclass_iris, a.definition, a.node_kind) == ("A", "c:b", ["k", "x"], ["c:t"], "D", "concept")
    assert (nodes["c:r"].label, nodes["c:r"].node_kind) == ("r", "class")
    schema = "iri string, label string, parent_iri string, children_iris array<string>, node_kind string, superclass_iris array<string>, superproperty_iris array<string>"
    frame = spark.createDataFrame([("a", "A", "gone", [], "class", [], []), ("b", "B", "p", [], "class", [], []), ("p", "P", None, ["a"], "property", [], [])], schema)
    assert [tuple(r) for r in graph.diagnostics(frame).collect()] == [("missing_reference", "a", "gone"), ("cross_hierarchy", "b", "p"), ("cross_hierarchy", "p", "a"), ("asymmetric_child", "p", "a")]
    wired = {r.iri: r.children_iris for r in graph.wire_children(frame).collect()}
    assert wired == {"a": [], "b": [], "p": ["a", "b"]}
    with pytest.raises(ValueError):
        graph.check_bounds(frame, graph.edges_of(frame), max_nodes=2)


def test_quads_and_payload(spark):
    row = spark.createDataFrame([("mds.v:1", "Name", "because", "n1", None, "u", None, "pass")], "product_iri string, product_name string, rationale string, mapped_node_iri string, version string, decided_by string, see_also string, band string")
    quads = graph.mapping_quads(row, "g")
    assert quads.count() == 4 and graph.shape_errors(quads).count() == 0
    assert graph.shape_errors(quads.withColumn("graph", F.lit(" "))).count() == 4
    nodes, edges = graph.match_payload(spark.createDataFrame([("n1", "N", None)], "iri string, label string, parent_iri string"), row)
    assert {(r.id, r.colour) for r in nodes.collect()} == {("n1", "grey"), ("mds.v:1", "green")} and edges.count() == 1


def test_evaluation_numbers(spark):
    cases = spark.createDataFrame([("1", "V ", "g", "t", False), ("2", "v", "g", "t", False), ("3", "w", "h", None, True)], "case_id string, vendor string, taxonomy_group string, expected_target_iri string, expected_abstain boolean")
    raw = spark.createDataFrame([("1", "t", 0.9, "auto_mapped", None, False), ("2", "u", 0.4, "", "low", False), ("3", None, 0.0, "needs_review", None, True)], "case_id string, mapped_node_iri string, confidence double, status string, band string, requires_human_review boolean").withColumn("proposed_target_iri", F.lit(None).cast("string"))
    found = evaluation.predictions(raw)
    m = evaluation.metrics(evaluation.judged(cases, found)).first()
    assert (m.coverage, m.exact_match_rate, m.abstention_recall, m.auto_publish_precision) == (pytest.approx(1 / 3), 0.5, 1.0, 1.0)
    assert (m.calibration_mae, m.brier_score) == (pytest.approx(0.25), pytest.approx(0.085))
    groups = evaluation.by_group(evaluation.judged(cases, found)).collect()
    assert {(r.vendor, r.taxonomy_group): r.total_cases for r in groups} == {(None, None): 3, ("v", None): 2, ("w", None): 1, (None, "g"): 2, (None, "h"): 1}
    with pytest.raises(ValueError):
        evaluation.judged(cases, found.limit(1))
    with pytest.raises(Exception, match="auto_pass below the cut"):
        evaluation.predictions(raw.withColumn("confidence", F.lit(0.1))).collect()


@pytest.mark.parametrize("n,enough", [(19, False), (20, True), (21, True)])
def test_monitoring_minimum(spark, n, enough):
    rows = [(i, True, "t", "t" if i else "other", []) for i in range(n)]
    r = evaluation.monitoring(spark.createDataFrame(rows, "source_event_id int, auto_pass boolean, predicted_iri string, actual_iri string, violations array<string>")).first()
    assert (r.sufficient_samples, r.breached, r.breach_reasons) == (enough, enough, ["auto_publish_precision", "false_auto_pass_rate"] if enough else [])


def test_split_holds_out_the_tail(spark):
    frame = spark.range(11).withColumn("at", -F.col("id"))
    got = {r.id for r in evaluation.held_out_split(frame, [F.asc("at")]).filter("held_out").collect()}
    assert got == {0, 1, 2}
    assert evaluation.held_out_split(frame.limit(0), [F.asc("at")]).count() == 0
    assert evaluation.leakage(frame, frame.limit(1), "id").count() == 1


def test_batch_ledger(spark):
    units = spark.createDataFrame([(i,) for i in range(6)], "k int")
    ledger, passes = matching.run_batch(units, lambda p, n: p.withColumn("outcome", F.when(F.col("k") < 2 * n, "published").otherwise("retry")), "k", 2, units.filter("k = 0"))
    assert {r.k: (r.outcome, r.pass_no) for r in ledger.collect()} == {1: ("published", 1), 2: ("published", 2), 3: ("published", 2), 4: ("quarantined", 2), 5: ("quarantined", 2)}
    assert [tuple(r) for r in passes.orderBy("pass_no").collect()] == [(1, 5, 1, 4), (2, 4, 2, 2)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=8), min_size=1, max_size=6), st.text(alphabet="ab c", max_size=8))
def test_bm25_is_not_negative(docs, query):
    lexicon = retrieval._Lexicon([(str(i), d, d) for i, d in enumerate(docs)])
    if any(lexicon.sizes):
        assert min(lexicon.bm25(query, list(range(len(docs)))).values()) >= 0


def _nodes_of(spark, rows):
    return spark.createDataFrame([(i, label, [], "", []) for i, label in rows], "iri string, label string, alt_labels array<string>, definition string, signals array<string>")


def test_texts_of_the_same_known_terms_are_nominated_for_once(spark, monkeypatch):
    """Products whose texts differ in terms that no node has, or not at all, are one query of BM25."""
    from tarnwick.operators.matching import Options

    asked, bm25 = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda queries, *rest: asked.append(queries.count()) or bm25(queries, *rest))
    products = spark.createDataFrame([(i, "red ring", f"lot{i % 7}") for i in range(40)] + [(40, "Blue", None), (41, "nothing", None)], "product bigint, name string, description string")
    nodes = _nodes_of(spark, [("a", "red ring"), ("b", "blue bolt"), ("c", "ring")])
    none = spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([], "product bigint, iri string"), spark.createDataFrame([], "product bigint, iri string, n bigint")
    found = retrieval.retrieve(products, nodes, *none, Options(multi_path=True), 3).collect()
    assert asked == [3]  # red ring, blue, and no known term
    assert sorted((r.product, r.iri) for r in found) == [(p, i) for p in range(42) for i in "abc"]
    assert {r.similarity for r in found if r.product == 40 and r.iri == "b"} == {round(retrieval.jaro_winkler_of("blue", "blue bolt"), 4)}


def test_products_with_precedents_are_ranked_apart_from_their_text(spark):
    from tarnwick.operators.matching import Options

    products = spark.createDataFrame([(i, "red ring", None) for i in range(3)], "product bigint, name string, description string")
    nodes = _nodes_of(spark, [("a", "red ring"), ("b", "red rung"), ("c", "ring")])
    negatives, boosts = spark.createDataFrame([(1, "a")], "product bigint, iri string"), spark.createDataFrame([(2, "b", 9)], "product bigint, iri string, n bigint")
    found = retrieval.multi_path(products, nodes, spark.createDataFrame([], "child string, parent string"), negatives, boosts, Options(multi_path=True), 1).collect()
    assert {r.product: r.iri for r in found} == {0: "a", 1: "b", 2: "b"}
    assert {r["rank"] for r in found} == {1}


def test_expand_deals_with_each_set_of_nominated_nodes_once(spark, monkeypatch):
    sizes, written = {}, retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: sizes.setdefault(name, written(df, name)))
    nominated = spark.createDataFrame([(p, n) for p in range(50) for n in ("a", "b")] + [(50, "c"), (50, "c"), (51, "x"), (52, None)], "query int, doc string")
    edges = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p"), ("p", "top"), ("c", "c")], "child string, parent string")
    got = sorted((r.query, r.doc or "") for r in retrieval.expand(nominated, edges).collect())
    assert got == sorted([(p, n) for p in range(50) for n in "abp"] + [(50, "c"), (50, "p"), (51, "x"), (52, "")])
    assert sizes["expanded_sets"].count() == 3 + 2 + 1 + 1


def test_expand_makes_rows_that_files_hold_in_a_fraction_of_a_byte(spark, tmp_path):
    """A set of many products and nodes: every pair once, in an order that repeats; a null product has its rows too."""
    nominated = spark.range(2016).select(F.concat(F.lit("d"), "id").alias("query"), F.lit("top").alias("doc"))
    edges = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("child"), F.lit("top").alias("parent"))
    retrieval.expand(nominated, edges).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    each = got.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("docs")).collect()
    assert len(each) == 2016 and {(r.n, r.docs) for r in each} == {(3001, 3001)}
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < got.count() // 4
    few = spark.createDataFrame([(None, "c1"), ("x", "c1")], "query string, doc string")
    assert sorted((r.query or "", r.doc) for r in retrieval.expand(few, edges).collect()) == [("", "c1"), ("", "top"), ("x", "c1"), ("x", "top")]


def test_best_bm25_keeps_the_best_of_each_task_and_nothing_else(spark, monkeypatch):
    """The k best of each query are those of bm25(); no more rows leave a task than k a query, in blocks of any size."""
    words = "red blue green bolt ring gear".split()
    docs = spark.createDataFrame([(f"d{i:03}", " ".join(words[(i * j) % 6] for j in range(1, 2 + i % 7))) for i in range(300)] + [("empty", None)], "id string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "red bolt red"), (2, "ring"), (3, "absent"), (4, None)], "q int, text string")
    args = asked, docs, "q", F.col("text"), "id", F.col("text")
    rows = lambda scored: sorted((r.query, r.doc, r.score, r["rank"]) for r in retrieval.nominate(scored, 5).collect())
    wanted = rows(retrieval.bm25(*args))
    assert len(wanted) == 10
    for block in (1, 1 << 20):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        found = retrieval.best_bm25(*args, 5)
        assert found.count() <= 3 * 2 * 5
        assert rows(found) == wanted
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    assert rows(retrieval.best_bm25(*args, 5)) == wanted


def test_offers_are_scored_where_the_texts_are(spark, monkeypatch):
    """Pairs are not shuffled, and offers too large for a broadcast give the same rows."""
    texts = spark.createDataFrame([(f"text {i}", f"b{i % 3}") for i in range(60)], "text string, bag string")
    offered = spark.createDataFrame([(f"b{b}", f"n{j}", f"text {j}") for b in range(2) for j in range(5)], "bag string, iri string, label string")
    found = retrieval.similar_offers(texts, offered)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    rows = sorted(found.collect())
    assert len(rows) == 40 * 5 and max(r.similarity for r in rows) == 1.0
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    assert sorted(retrieval.similar_offers(texts, offered).collect()) == rows
    assert {r.similarity for r in retrieval.similar_offers(texts, offered, None).collect()} == {0.5}
