"""Every registered query of the catalogue against its SQL in DuckDB."""

import datetime
import decimal

import duckdb
import pytest

from tarnwick.plans import rule_queries, source_queries, stream_queries  # noqa: F401  they add to QUERIES
from tarnwick.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{round(float(x), 6) + 0.0:.6f}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x).removesuffix(" 00:00:00")
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_line_item_components_take_all_line_items(spark, duck, sf_dir):
    edges = duck.execute("SELECT DISTINCT l_orderkey, -1 - l_suppkey FROM lineitem").fetchall()
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {r.node: r.component for r in QUERIES["line_item_components"](spark, sf_dir).collect()} == {x: root(x) for x in parent}


def test_user_cycles_take_all_users(spark, duck, sf_dir):
    users = [u for (u,) in duck.execute("SELECT DISTINCT user_id FROM events").fetchall()]
    n, wanted = max(users) + 1, {}
    to = {u: (u * 7 + 2) % n for u in users}
    for u in users:
        way = [u]
        while (v := to.get(way[-1])) is not None and v not in way:
            way.append(v)
        if to.get(way[-1]) == u:
            wanted[u] = min(way)
    assert any(u % 2 for u in wanted)
    assert {r.node: r.component for r in QUERIES["user_cycles"](spark, sf_dir).collect()} == wanted


def test_entry_works_without_the_training_data_operators():
    import builtins
    import importlib.util
    from pathlib import Path

    real = builtins.__import__

    def blocked(name, *a, **k):
        if name.startswith(("tarnwick.llm", "corpus_pipeline")) or (name == "tarnwick" and "llm" in (a[2] or () if len(a) > 2 else ())):
            raise ImportError(name)
        return real(name, *a, **k)

    spec = importlib.util.spec_from_file_location("entry_alone", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    builtins.__import__ = blocked
    try:
        spec.loader.exec_module(module)
    finally:
        builtins.__import__ = real
    assert set(module.queries()) == set(QUERIES) and set(module.oracle_sql()) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", ["bundle_import", "decision_validation"])
def test_decisions_on_nodes_beyond_the_first_ten(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_seconds(range) AS ts, range % 37 AS user_id, ['purchase', 'signup', 'error', 'view'][1 + range % 4] AS event_type, (range * 50) % 1000 + 0.5 AS value, '{{}}' AS props FROM range(400)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(found.fetchall())
