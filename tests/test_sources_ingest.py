import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import ingest, metadata
from tarnwick.sources import paged, rdf, readers, xlsx

COLUMNS = {"id": "integer", "name": "string", "amount": "decimal"}
ROWS = [(i, f"n{i}", i + 0.5) for i in range(1, 6)]


def workbook(path, rows, names=("id", "name", "amount")):
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>" for v in row) + "</row>" for row in [names, *rows])
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')


def write(folder, kind, name="a", rows=ROWS, names=("id", "name", "amount")):
    path = folder / f"{name}.{kind}"
    if kind in ("csv", "txt"):
        sep = "," if kind == "csv" else "|"
        path.write_text("\n".join(sep.join(map(str, r)) for r in [names, *rows]) + "\n")
    elif kind == "json":
        path.write_text(json.dumps([dict(zip(names, r)) for r in rows]))
    elif kind == "xml":
        path.write_text("<rows>" + "".join("<record>" + "".join(f"<{n}>{v}</{n}>" for n, v in zip(names, r)) + "</record>" for r in rows) + "</rows>")
    elif kind == "xlsx":
        workbook(path, rows, names)
    else:
        import pandas as pd

        pd.DataFrame(rows, columns=list(names)).to_parquet(path)
    return path


def dataset(tmp_path, kind, **more):
    (tmp_path / "in").mkdir(exist_ok=True)
    return ingest.Dataset("d1", "p1", kind, f"file://{tmp_path}/in", f"*.{kind}", f"file://{tmp_path}/target", COLUMNS, options={"delimiter": "|"} if kind == "txt" else {}, **more)


@pytest.mark.parametrize("kind", ["csv", "txt", "json", "xlsx", "xml", "parquet"])
def test_each_format_loads_once(spark, tmp_path, kind):
    d, log = dataset(tmp_path, kind), f"file://{tmp_path}/log"
    write(tmp_path / "in", kind)
    (r,) = ingest.ingest(spark, d, log)
    assert (r["run_status"], r["column_status"], r["records_found"], r["records_loaded"], r["records_skipped"]) == ("success", "match", 5, 5, 0), r
    got = spark.read.parquet(d.target)
    assert sorted((x.id, x.name, x.amount) for x in got.collect()) == ROWS
    assert set(ingest.AUDIT) <= set(got.columns)
    write(tmp_path / "in", kind)
    (again,) = ingest.ingest(spark, d, log)
    assert again["run_status"] == ("skipped" if kind in ("csv", "txt", "json", "xml") else again["run_status"])


def test_column_cases(spark, tmp_path):
    d, log = dataset(tmp_path, "csv"), f"file://{tmp_path}/log"
    assert ingest.ingest(spark, d, log)[0]["run_status"] == "skipped"
    write(tmp_path / "in", "csv", "extra", [(1, "a", 1.0, 9)], ("ID", "name", "amount", "more"))
    write(tmp_path / "in", "csv", "missing", [(2, "b")], ("id", "name"))
    write(tmp_path / "in", "csv", "both", [(3, "c", 1)], ("id", "name", "more"))
    write(tmp_path / "in", "csv", "none", [(3,)], ("zzz",))
    write(tmp_path / "in", "csv", "bad", [(4, "d", "x"), (5, "e", "2.5")])
    found = {r["file_name"]: r for r in ingest.ingest(spark, d, log)}
    assert {k: (r["run_status"], r["column_status"]) for k, r in found.items()} == {
        "extra.csv": ("success", "extra_cols_in_file"), "missing.csv": ("success", "missing_cols_in_file"), "both.csv": ("success", "col_mismatch"),
        "none.csv": ("failed", None), "bad.csv": ("partial", "match"),
    }
    assert (found["bad.csv"]["records_loaded"], found["bad.csv"]["records_skipped"]) == (1, 1)
    last = ingest.run_log(spark, log)
    assert {r.run_status: r.n for r in ingest.run_summary(last).collect()} == {"skipped": 1, "success": 3, "failed": 1, "partial": 1}


def test_transforms_refuse_wrong_types(spark):
    with pytest.raises(TypeError):
        ingest.transform(spark.range(1), [ingest.Rule("ID", trim="trim")])
    with pytest.raises(ValueError):
        readers.read(spark, "toml", "x")


def test_uploads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"products": [{"sku": "s1", "title": "T"}, {"sku": " ", "title": "U"}]}))
    good, bad = readers.products(readers.read_upload(spark, f"file://{tmp_path}/a.json"), "acme")
    assert [(r.product_id, r.name, r.raw) for r in good.collect()] == [("s1", "T", {"sku": "s1", "title": "T"})] and bad.count() == 1
    (tmp_path / "b.tsv").write_text("Code \tName\n1\tx\n")
    assert [r.product_id for r in readers.products(readers.read_upload(spark, f"file://{tmp_path}/b.tsv"), "v")[0].collect()] == ["1"]
    (tmp_path / "c.csv").write_text("id\n" + "1\n" * 6)
    with pytest.raises(ValueError):
        readers.read_upload(spark, f"file://{tmp_path}/c.csv", limit=5)


def test_notifications(spark):
    native = {"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "a%20b"}}}]}
    event = {"detail": {"bucket": {"name": "c"}, "object": {"key": "k"}}}
    queue = {"Records": [{"body": json.dumps(native)}, {"body": json.dumps(event)}]}
    rows = spark.createDataFrame([(json.dumps(x),) for x in (native, event, queue)], "body string")
    assert sorted((r.bucket, r.key) for r in readers.object_refs(rows).collect()) == [("b", "a b"), ("b", "a b"), ("c", "k"), ("c", "k")]


def test_frames_and_lines(spark, tmp_path):
    files = spark.createDataFrame([("p/1.json", '{"product_id": "x", "source_content_hash": "forged"}')], "path string, value string")
    row = readers.object_frames(files, "product_id string").first()
    assert row.product_id == "x" and len(row.source_content_hash) == 64
    (tmp_path / "g.jsonl").write_text('# note\n\n{"case_id": "1"}\n{broken\n')
    rows = readers.json_lines(spark, f"file://{tmp_path}/g.jsonl", "case_id string").collect()
    assert [(r.case_id, r._corrupt) for r in rows] == [("1", None), (None, "{broken")]
    (tmp_path / "t.json").write_text(json.dumps({"@graph": [{"@id": "catalog:a", "inDomain": "catalog:r"}, {"iri": "catalog:r", "label": "Root"}]}))
    assert sorted((r.iri, r.label, r.parent_iri) for r in readers.taxonomy_json(spark, f"file://{tmp_path}/t.json").collect()) == [("catalog:a", "a", "catalog:r"), ("catalog:r", "Root", None)]


TURTLE = '''@prefix ex: <http://e/> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .
# note
ex:a a skos:Concept ; skos:prefLabel "A \\"x\\""@en , 'B' ; skos:broader ex:b .
ex:b skos:notation 12 ; ex:long """two
lines""" ; ex:flag true ; ex:when "2020"^^<http://d> .
'''


def test_turtle(spark, tmp_path):
    got = list(rdf.parse(TURTLE))
    assert ("http://e/a", rdf.TYPE, "http://www.w3.org/2004/02/skos/core#Concept", True) in got and len(got) == 8
    assert ("http://e/a", "http://www.w3.org/2004/02/skos/core#prefLabel", 'A "x"', False) in got
    (tmp_path / "x.ttl").write_text(TURTLE)
    (tmp_path / "x.nt").write_text('<http://e/a> <http://e/p> "v" .\n<http://e/a> <http://e/p> <http://e/b> .\n')
    assert readers.triples(spark, f"file://{tmp_path}/x.ttl").count() == 8
    assert readers.triples(spark, f"file://{tmp_path}/x.nt").count() == 2
    with pytest.raises(ValueError):
        list(rdf.parse("ex:a ex:b ex:c ."))


def test_snapshot_files(spark, tmp_path):
    spark.createDataFrame([("r1", "t", 1)], "vendor_product_ref string, title string, extra int").coalesce(1).write.parquet(f"file://{tmp_path}/w1")
    for i, p in enumerate((tmp_path / "w1").glob("part-*")):
        p.rename(tmp_path / f"acme_{i}.parquet")
    assert readers.snapshot_union(spark, f"file://{tmp_path}", "acme").count() == 1
    assert readers.tombstones(spark, f"file://{tmp_path}", "acme").count() == 0


def test_workbook_sheet(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [(1, "x", 2.5)])
    with pytest.raises(Exception, match="no sheet named 'Nope'"):
        xlsx.read(spark, f"file://{tmp_path}/a.xlsx", "Nope").collect()


def test_workbooks_of_different_columns(spark, tmp_path):
    """Columns go by name: other orders, missing ones, and repeated and empty names."""
    workbook(tmp_path / "a.xlsx", [(1, "x", 2.5)])
    workbook(tmp_path / "b.xlsx", [("y", 2), ("z", 3)], names=("name", "id"))
    workbook(tmp_path / "_c.xlsx", [(9, "hidden", 9)])
    got = xlsx.read(spark, f"file://{tmp_path}")
    assert got.columns == ["id", "name", "amount"] and [f.dataType.simpleString() for f in got.schema] == ["bigint", "string", "double"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", 2.5), (2, "y", None), (3, "z", None)]
    wanted = xlsx.read(spark, f"{tmp_path}/*.xlsx", schema="amount double, id int, extra string")
    assert sorted(tuple(r) for r in wanted.collect() if r.id > 1) == [(None, 2, None), (None, 3, None)]
    assert xlsx.header(["a", None, "a", "a", ""]) == ["a", "Unnamed: 1", "a.1", "a.2", "Unnamed: 4"]
    (tmp_path / "empty").mkdir()
    assert xlsx.read(spark, f"file://{tmp_path}/empty").columns == []


def test_workbooks_written_and_read(spark, tmp_path, monkeypatch):
    """Every value comes back, also those that XML cannot hold; overwriting leaves only the new workbooks."""
    texts = [" a  b ", "x\x01y\r\n", "_x0041_", "<&>\"'", "", "\U0001F600", None]
    rows = [(i, t, i / 3, i % 2 == 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "id bigint, `the text` string, v double, b boolean")
    xlsx.register(spark)
    for mode in ("append", "overwrite", "append"):
        frame.repartition(3).write.format("xlsx").option("sheet", "D & E").mode(mode).save(f"file://{tmp_path}/out")
    got = xlsx.read(spark, f"file://{tmp_path}/out", "D & E")
    assert got.schema.simpleString() == frame.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(rows * 2)
    assert not list((tmp_path / "out").glob("_*"))
    first = spark.read.format("xlsx").load(f"file://{tmp_path}/out")
    assert first.columns == frame.columns and {f.dataType.simpleString() for f in first.schema} == {"string"}


def test_a_failed_write_of_workbooks_leaves_nothing(spark, tmp_path):
    xlsx.register(spark)
    bad = spark.range(10).selectExpr("CASE WHEN id = 7 THEN cast(raise_error('stop') AS BIGINT) ELSE id END AS id")
    with pytest.raises(Exception, match="stop"):
        bad.write.format("xlsx").mode("append").save(f"file://{tmp_path}/out")
    assert not list(tmp_path.glob("out/**/*.xlsx"))


def test_versions(spark):
    entities = spark.createDataFrame([("k", "a", 1, "n"), ("k", "b", 2, "y"), ("m", "c", 1, "y")], "id string, v string, version int, current_flag string")
    changes = spark.createDataFrame([("k", "z", False), ("m", "c", False), ("q", "new", False)], "id string, v string, deleted boolean")
    got = sorted(tuple(r) for r in metadata.scd2_apply(entities, changes, "id").collect())
    assert got == [("k", "a", 1, "n"), ("k", "b", 2, "n"), ("k", "z", 3, "y"), ("m", "c", 1, "y"), ("q", "new", 1, "y")]
    with pytest.raises(ValueError):
        metadata.require_unique(entities, "id")


def test_evolution_and_upsert(spark):
    registry = spark.createDataFrame([("id", "integer", 1), ("v", "string", 2)], "col_name string, col_type string, col_position int")
    got = [tuple(r) for r in ingest.evolve(registry, {"V": "decimal", "w": "date"}).orderBy("col_position").collect()]
    assert got == [("id", "integer", 1), ("v", "decimal", 2), ("w", "date", 3)]
    current = spark.createDataFrame([("a", 1, "old"), ("b", 5, "keep")], "k string, t int, v string")
    changes = spark.createDataFrame([("a", 1, "new"), ("b", 4, "late"), ("c", 1, "add")], "k string, t int, v string")
    assert sorted(tuple(r) for r in ingest.upsert(current, changes, ["k"], "t").collect()) == [("a", 1, "new"), ("b", 5, "keep"), ("c", 1, "add")]


def test_publish_is_idempotent(spark):
    quads = spark.createDataFrame([("s", "p", "o", "g1"), ("s", "p", "o2", "g1"), ("x", "p", "o", "g2")], "subject string, predicate string, object string, graph string")
    done = ingest.graph_digests(quads)
    assert ingest.to_publish(quads.orderBy(F.desc("object")), done).count() == 0
    assert ingest.to_publish(quads.union(quads.filter("graph = 'g2'").withColumn("object", F.lit("n"))), done).count() == 2


def test_csvw_aliases():
    from tarnwick.sources import csvw

    columns = [{"name": "Ticker_Code", "titles": ["RIC"]}, {"name": "x1", "canonical": "name"}, {"name": "Instrument_Code"}, {"titles": {"en": ["Summary"]}}, {"name": "x2", "propertyUrl": "http://purl.org/dc/terms/identifier"}]
    found = csvw.aliases({"tableSchema": {"columns": columns}})
    assert {"ticker_code", "ric", "x2"} <= set(found["product_id"]) and "x1" in found["name"] and "summary" in found["description"]
    assert all("instrument_code" not in v for v in found.values())  # no hint for it
    assert csvw.aliases({}) == csvw.ALIASES and csvw.aliases({"tableSchema": {"columns": {"name": "id"}}})["product_id"][0] == "product_id"


def test_golden_set_names_file_and_line(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('# cases\n{"case_id": 1}\n\n{"case_id": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"case_id": 1}\n# x\n{broken\n')
    assert sorted(r.case_id for r in readers.golden_set(spark, str(tmp_path / "good.jsonl"), "case_id int").collect()) == [1, 2]
    with pytest.raises(Exception, match=r"bad\.jsonl:3: no case"):
        readers.golden_set(spark, str(tmp_path / "bad.jsonl"), "case_id int").collect()


def test_paged_pull(spark, tmp_path):
    """Pages end at a null next or at max_pages; a next that is no text asks the endpoint again."""
    for name, body in {"a1": {"items": [{"k": 1}], "next": "a2"}, "a2": {"items": [{"k": 2}, {"k": 3}], "next": f"file://{tmp_path}/a3"}, "a3": {"items": [], "next": None}, "b": {"items": [{"k": 9}], "next": True}}.items():
        (tmp_path / name).write_text(json.dumps(body))
    at = f"file://{tmp_path}"
    vendors = spark.createDataFrame([("a", f"{at}/a1", True, None), ("b", f"{at}/b", True, 3), ("off", f"{at}/none", False, None), ("null", f"{at}/none", None, None), ("zero", f"{at}/a1", True, 0)], paged.VENDORS)
    pages = paged.pull(spark, vendors)
    assert sorted((r.vendor, r.page, r.truncated) for r in pages.collect()) == [("a", 1, False), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, False), ("b", 3, True)]
    assert sorted((r.vendor, r.page, r.k) for r in paged.items(pages, "k int").collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 9), ("b", 2, 9), ("b", 3, 9)]
    assert sorted(map(tuple, paged.summary(vendors, pages).collect())) == [("a", 3, False, False), ("b", 3, False, True), ("null", 0, True, False), ("off", 0, True, False), ("zero", 0, False, True)]
    cut = vendors.filter("vendor = 'a'").withColumn("max_pages", F.lit(2))
    first = paged.pull(spark, cut)
    assert [(r.page, r.address, r.truncated) for r in paged.resume(spark, cut, first).collect()] == [(1, f"{at}/a3", False)]
    assert paged.pull(spark, vendors.filter("NOT enabled")).collect() == []
    missing = vendors.filter("vendor = 'off'").withColumn("enabled", F.lit(True))
    with pytest.raises(Exception, match="none"):
        paged.pull(spark, missing).collect()


def test_paged_pull_of_files_with_a_page_a_line(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}"
    (tmp_path / "f0").write_text('{"items": [{"k": 1}], "next": "f0#line=1"}\n{"items": [{"k": 2}], "next": "f1#line=0"}\n')
    (tmp_path / "f1").write_text('{"items": [{"k": 3}], "next": "f0#line=9"}\n')
    vendors = spark.createDataFrame([("a", f"{at}/f0#line=0", True, 3)], paged.VENDORS)
    pages = paged.pull(spark, vendors)
    assert sorted((r.page, r.k) for r in paged.items(pages, "k int").collect()) == [(1, 1), (2, 2), (3, 3)]
    with pytest.raises(Exception, match="has no line 9"):
        paged.resume(spark, vendors, pages).collect()
    opens, real = [], paged.opened
    monkeypatch.setattr(paged, "opened", lambda path: opens.append(path) or real(path))
    assert len(list(paged._Reader([]).read(paged.Vendor("a", f"{at}/f0#line=0", f"{at}/f0#line=0", 3)))) == 3
    assert len(opens) == 2  # each file once


def test_landed_pages_share_files(spark, sf_dir, tmp_path):
    from tarnwick.plans import source_queries

    spark.range(300).selectExpr("id AS c_custkey", "'c' AS c_name", "0 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    folder = source_queries._landed_pages(spark, str(tmp_path)).first().endpoint.split("/nation=")[0].removeprefix("file://")
    assert len([f for _, _, names in os.walk(folder) for f in names if f.startswith("part-")]) == 1  # 15 pages
