"""Strong components by contraction against a plain depth-first search."""

import random

import pytest

from tarnwick.operators import cycles, graph


def tarjan(edges):
    """Least node by node, of strong components of several nodes and of self loops."""
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, path, on, found = {}, {}, [], set(), {}
    for root in out:
        work = [(root, None)] if root not in index else []
        while work:
            v, rest = work.pop()
            if rest is None:
                index[v] = low[v] = len(index)
                path.append(v)
                on.add(v)
                rest = iter(out[v])
            for w in rest:
                if w not in index:
                    work += [(v, rest), (w, None)]
                    break
                if w in on:
                    low[v] = min(low[v], low[w])
            else:
                if low[v] == index[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(path.pop())
                    on -= set(own)
                    if len(own) > 1 or v in out[v]:
                        found |= dict.fromkeys(own, min(own))
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
    return found


def sample():
    """Disjoint parts: sparse and dense random graphs, a chain of cycles with shuffled names, a long path, loops, and two cycles that share a node."""
    rng, edges = random.Random(7), []
    edges += [(rng.randrange(200), rng.randrange(200)) for _ in range(260)]
    edges += [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(1600)]
    names = rng.sample(range(2000, 2090), 90)
    for i in range(0, 90, 3):
        a, b, c = names[i : i + 3]
        edges += [(a, b), (b, c), (c, a)] + ([(c, names[i + 3])] if i + 3 < 90 else [])
    edges += [(5000 + i, 5001 + i) for i in range(120)] + [(6000, 6000), (6000, 6001), (6001, 6002)]
    edges += [(7000, 7001), (7001, 7000), (7001, 7002), (7002, 7001)]
    return edges


def test_components_of_a_mixed_graph(spark):
    edges = sample()
    rows = spark.createDataFrame(edges + edges[:50] + [(None, 1), (1, None)], "child bigint, parent bigint").repartition(4)
    assert {r.node: r.component for r in cycles.cyclic_components(rows).collect()} == tarjan(edges)


def test_colours_join_only_what_is_strong(spark, monkeypatch):
    """Every second round by colours, cut short after one step."""
    monkeypatch.setattr(cycles, "SHRINK", 2.0)
    monkeypatch.setattr(cycles, "SPREAD", 1)
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)]
    rows = spark.createDataFrame(edges, "child string, parent string")
    assert {r.node: r.component for r in graph.cyclic_components(rows).collect()} == tarjan(edges)


def test_no_edges(spark):
    assert graph.cyclic_components(spark.createDataFrame([], "child bigint, parent bigint")).collect() == []
    assert graph.cyclic_components(spark.createDataFrame([(1, 2), (2, 3)], "child bigint, parent bigint")).collect() == []


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_blocks_of_neighbouring_ids_and_what_crosses_them(spark, monkeypatch, block):
    monkeypatch.setattr(cycles, "BLOCK", block)
    chance = random.Random(block)
    edges = [(3 * i + j, 3 * i + (j + 1) % 3) for i in range(30) for j in range(3)] + [(3 * i + 2, 3 * i + 3) for i in range(29)]
    edges += [(500, 501 + i) for i in range(20)] + [(520, 500)] + [(600 + chance.randrange(30), 600 + chance.randrange(30)) for _ in range(35)]
    chance.shuffle(edges)
    rows = spark.createDataFrame(edges, "child bigint, parent bigint")
    assert {r.node: r.component for r in cycles.cyclic_components(rows).collect()} == tarjan(edges)


def test_a_long_chain_of_cycles_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(cycles, "_walks", lambda *_: pytest.fail("a chain of near ids needs no walk"))
    edges = [(3 * i + j, 3 * i + (j + 1) % 3) for i in range(20_000) for j in range(3)] + [(3 * i + 2, 3 * i + 3) for i in range(19_999)]
    found = cycles.cyclic_components(spark.createDataFrame(edges, "child bigint, parent bigint"))
    assert found.count() == 60_000 and found.filter("component <> node - node % 3").isEmpty()
