import json

from pyspark.sql import functions as F

from tarnwick.streaming import streams

EVENT = "event_id string, detail_type string, created_at timestamp"
DECISION = "vendor string, product_id string, name string, node_iri string, decision string, provisional boolean, decided_at_ms bigint, seq bigint"


def lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_outbox_delivers_each_key_once(spark, tmp_path):
    folder, sink, check = tmp_path / "in", f"file://{tmp_path}/sink", f"file://{tmp_path}/check"
    lines(folder, "a.json", [{"event_id": "1", "detail_type": "published"}, {"event_id": "2", "detail_type": "draft"}])
    run = lambda: streams.outbox(streams.landing(spark, f"file://{folder}", EVENT), sink, check).awaitTermination()
    run()
    lines(folder, "b.json", [{"event_id": "1", "detail_type": "published"}, {"event_id": "3", "detail_type": "published"}])
    run()
    run()
    assert sorted(r.event_id for r in streams.delivered(spark, sink).collect()) == ["1", "3"]


def test_outbox_delivers_in_order_and_in_bounded_files(spark, tmp_path):
    folder, sink = tmp_path / "in", f"file://{tmp_path}/sink"
    lines(folder, "a.json", [{"event_id": str(i), "detail_type": "published", "created_at": f"2024-01-01T00:00:{i * 7 % 60:02}Z"} for i in range(50)])
    streams.outbox(streams.landing(spark, f"file://{folder}", EVENT), sink, f"file://{tmp_path}/check", most=8).awaitTermination()
    files = sorted((tmp_path / "sink" / "batch=0").glob("*.parquet"))
    times = [[r.created_at for r in spark.read.parquet(f"file://{f}").collect()] for f in files]
    assert max(map(len, times)) <= 8 and sum(map(len, times)) == 50
    assert sum(times, []) == sorted(sum(times, []))


def test_watermark_is_exclusive(spark, tmp_path):
    folder = tmp_path / "in"
    lines(folder, "a.json", [{"event_id": "1", "created_at": "2024-01-01T00:00:00Z"}, {"event_id": "2", "created_at": "2024-01-01T00:00:01Z"}])
    rows = streams.after_watermark(streams.landing(spark, f"file://{folder}", EVENT), "2024-01-01 00:00:00")
    rows.writeStream.format("memory").queryName("late").trigger(availableNow=True).start().awaitTermination()
    assert [r.event_id for r in spark.table("late").collect()] == ["2"]


def test_windows(spark, tmp_path):
    folder = tmp_path / "in"
    lines(folder, "a.json", [{"event_id": "1", "detail_type": "x", "created_at": f"2024-01-01T00:0{i}:00Z"} for i in range(9)])
    counts = streams.windowed_counts(streams.landing(spark, f"file://{folder}", EVENT), "created_at", "detail_type")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [4, 5]


def test_journal_folds(spark, tmp_path):
    folder = tmp_path / "in"
    base = {"vendor": "v", "product_id": "p", "name": "n", "provisional": False}
    lines(folder, "a.json", [base | {"node_iri": "a", "decision": "approve", "decided_at_ms": 1, "seq": 1}, base | {"node_iri": "a", "decision": "reject", "decided_at_ms": 2, "seq": 2}])
    table = f"file://{tmp_path}/journal"
    streams.journal(streams.landing(spark, f"file://{folder}", DECISION), table, f"file://{tmp_path}/check").awaitTermination()
    positive, negative = streams.state(spark, table)
    assert positive.count() == 0 and [r.node_iri for r in negative.select(F.col("node_iri")).collect()] == ["a"]


def test_sweep_isolates_rows_and_delivers_once_to_readers(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, i, "published" if i % 2 else "draft", str(i)) for i in range(12)], "event_id bigint, created_at int, detail_type string, payload string")
    sink, ledger = f"{tmp_path}/sink", f"{tmp_path}/ledger"

    def project(payload):
        return f"doc {1 // (int(payload) - 5) * 0 + int(payload)}"

    first = streams.sweep(rows, sink, ledger, project, most=4)
    assert [(r.event_id, r.error[:17]) for r in first.collect()] == [(5, "ZeroDivisionError")]
    assert sorted(r.event_id for r in streams.delivered(spark, sink).collect()) == [1, 3, 7]
    spark.read.parquet(ledger).filter("event_id <> 7").write.parquet(f"{ledger}-lost")  # a crash before 7 was acknowledged
    assert streams.sweep(rows, sink, f"{ledger}-lost", project).count() == 1
    assert sorted((r.event_id, r.body) for r in streams.delivered(spark, sink).collect()) == [(i, f"doc {i}") for i in (1, 3, 7, 9, 11)]
    assert [r.event_id for r in streams.sweep(rows, sink, f"{ledger}-lost", project).collect()] == [5]
