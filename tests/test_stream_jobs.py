import json
import shutil

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import precedents
from tarnwick.streaming import etl, folds, streams

DECISION = "vendor string, product_id string, node_iri string, decision string, provisional boolean, decided_at_ms bigint, seq bigint"


def test_stage_events_equal_batch_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = [json.dumps({"id": i, "name": "n" if i % 3 else " "}) for i in range(30)]
    (folder / "a.txt").write_bytes("\n".join([*good, "{oops", '{"id": "x"}', "", "[1]", "7"]).encode() + b'\n{"id": 99, "name": "\xff"}\n')
    load = lambda: etl.staged_load(spark.readStream.text(f"file://{folder}"), "id bigint, name string", ["id", "name"], f"file://{tmp_path}/sink", f"file://{tmp_path}/check")
    events = load()
    assert [(stage, rows, bad) for _, _, stage, rows, bad in events] == [("received", 36, 0), ("decode", 35, 1), ("parse", 31, 5), ("validate", 21, 10), ("sink", 21, 0)]
    batch = etl.staged(spark.read.text(f"file://{folder}"), "id bigint, name string", ["id", "name"])
    stored = spark.read.parquet(f"file://{tmp_path}/sink")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stored.collect())) and stored.count() == 21
    (folder / "b.txt").write_text(good[1] + "\n")
    again = load()  # a restart counts only what is new
    assert [e[1:] for e in again] == [(1, stage, 1, 0) for stage in etl.STAGES] and again[0][0] == events[0][0]
    assert load() == []


def test_sweep_folder_by_name_size_and_success(spark, tmp_path):
    folder, sink, ledger = tmp_path / "in", f"file://{tmp_path}/sink", f"file://{tmp_path}/ledger"
    (folder / "one").mkdir(parents=True)
    put = lambda name, *rows: (folder / name).write_text("".join(r + "\n" for r in rows))
    run = lambda dataset="d", **more: sorted((r.name, r.status, r.rows) for r in etl.sweep_folder(spark, dataset, f"file://{folder}", "id bigint", sink, ledger, **more).collect())
    ids = lambda: sorted(r.id for r in etl.landed(spark, sink, ledger, "id bigint").collect())
    put("a.json", '{"id": 1}', '{"id": 2}'), put("b.json", '{"id": 3}', "{broken"), put("c.json")
    assert run() == [("a.json", "success", 2), ("b.json", "failed", 0)] and ids() == [1, 2]
    shutil.copy(folder / "a.json", folder / "one" / "a.json")  # delivered again elsewhere
    assert run() == [("b.json", "failed", 0)] and ids() == [1, 2]
    put("b.json", '{"id": 3}'), put("a.json", '{"id": 10}')  # mended, and the same name with another size
    assert run(most=1) and run() and run() == [] and ids() == [1, 2, 3, 10]
    assert ("a.json", "success", 2) in run("other")


def test_a_crash_before_the_ledger_loads_nothing_twice(spark, tmp_path, monkeypatch):
    folder, sink, ledger = tmp_path / "in", f"file://{tmp_path}/sink", f"file://{tmp_path}/ledger"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1}\n')
    run = lambda: etl.sweep_folder(spark, "d", f"file://{folder}", "id bigint", sink, ledger)
    real = etl.F.current_timestamp
    monkeypatch.setattr(etl.F, "current_timestamp", lambda: 1 / 0)  # rows are written, the entry is not
    with pytest.raises(ZeroDivisionError):
        run()
    monkeypatch.setattr(etl.F, "current_timestamp", real)
    assert run().count() == 1 and len(list((tmp_path / "sink").glob("sweep=*"))) == 2
    assert [r.id for r in etl.landed(spark, sink, ledger, "id bigint").collect()] == [1]


def test_fold_equals_the_whole_journal_after_each_batch(spark, tmp_path):
    folder, sink, check = tmp_path / "in", f"file://{tmp_path}/sink", f"file://{tmp_path}/check"
    folder.mkdir()
    kinds = ["approve", "reject", "override", "reject", "odd", None]
    events = [{"vendor": f"v{i % 2}", "product_id": f"p{i % 5}" if i % 17 else None, "node_iri": f"n{i * 7 % 3}", "decision": kinds[i * 5 % 6 if i % 4 else i % 3], "provisional": True if i % 11 == 0 else None, "decided_at_ms": i * 37 % 50, "seq": i} for i in range(120)]
    plain = lambda df, *c: sorted(map(str, df.select("vendor", "product_id", "node_iri", *c).collect()))
    for part in range(3):  # each start is a restart from the checkpoint
        lines = events[part * 40 : part * 40 + 40] + events[:3]  # some come again
        (folder / f"{part}.json").write_text("".join(json.dumps(e) + "\n" for e in lines))
        folds.fold(streams.landing(spark, f"file://{folder}", DECISION), sink, check, partitions=2).awaitTermination()
        journal = spark.read.schema(DECISION).json(f"file://{folder}").dropna(subset=["vendor", "product_id"])
        positive, negative = folds.current(spark, sink)
        whole = precedents.current_positive(journal)
        assert plain(positive, "decision", "decided_at_ms", "seq") == plain(whole, "decision", "decided_at_ms", "seq") != []
        assert plain(negative, "decided_at_ms") == plain(precedents.current_negatives(journal), "decided_at_ms") != []
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert positive.select(F.count_distinct("vendor", "product_id")).first()[0] == positive.count()


def test_fold_combines_events_before_the_state(spark, tmp_path):
    """Only the last events of a product and a node reach the state, as rows of a JVM aggregation."""
    folder, sink = tmp_path / "in", f"file://{tmp_path}/sink"
    folder.mkdir()
    kinds, base = ["approve", "reject", "override"], {"vendor": "v", "product_id": "p", "provisional": False}
    events = [base | {"node_iri": f"n{i % 4}", "decision": kinds[i % 3], "decided_at_ms": None if i < 8 else i, "seq": i} for i in range(6_000)]
    (folder / "a.json").write_text("".join(json.dumps(e) + "\n" for e in events))
    query = folds.fold(streams.landing(spark, f"file://{folder}", DECISION), sink, f"file://{tmp_path}/check", partitions=2)
    query.awaitTermination()
    kept = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert {s["operatorName"] for s in kept} == {"stateStoreSave"} and max(s["numRowsTotal"] for s in kept) == 4
    journal = spark.read.schema(DECISION).json(f"file://{folder}")
    positive, negative = folds.current(spark, sink)
    assert sorted(map(str, positive.collect())) == sorted(map(str, precedents.current_positive(journal).select(positive.columns).collect())) != []
    assert sorted(map(str, negative.collect())) == sorted(map(str, precedents.current_negatives(journal).select(negative.columns).collect())) != []
