"""Queries that write the driver's tables in each source format and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph
from ..operators.ingest import compare_columns, loaded_before
from ..runtime import scratch_path, table
from ..sources import csvw, paged, readers, xlsx
from .queries import query


def single_file(df: DataFrame, data_format: str, path: str, **options) -> str:
    """Write df as one file of that name; for small tables only."""
    spark = df.sparkSession
    df.coalesce(1).write.options(**options).format(data_format).save(f"{path}.parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    fs = folder.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.mkdirs(target.getParent())
    fs.rename(part, target)
    fs.delete(folder, True)
    return path


def _copy(spark: SparkSession, df: DataFrame, data_format: str, **options) -> str:
    path = scratch_path(spark, data_format)
    df.write.options(**options).format(data_format).save(path)
    return path


PART_SQL = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


SCHEMA = "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double"


@query(PART_SQL)
def csv_scan(spark, sf_dir):
    return readers.read(spark, "CSV", _copy(spark, _part(spark, sf_dir), "csv", header=True), schema=SCHEMA)


@query(PART_SQL)
def txt_scan(spark, sf_dir):
    return readers.read(spark, "txt", _copy(spark, _part(spark, sf_dir), "csv", header=True, sep="|"), delimiter="|", schema=SCHEMA)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_scan(spark, sf_dir):
    """A file that is one array of objects."""
    rows = table(spark, sf_dir, "nation")
    path = single_file(rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")), "text", f"{scratch_path(spark, 'json')}/n.json")
    return readers.read(spark, "json", path, schema="n_nationkey int, n_name string, n_regionkey int")


@query(PART_SQL)
def xml_scan(spark, sf_dir):
    return readers.read(spark, "xml", _copy(spark, _part(spark, sf_dir), "xml", rowTag="part", rootTag="parts"), row_tag="part", schema=SCHEMA)


@query(PART_SQL)
def xlsx_scan(spark, sf_dir):
    """Workbooks that tasks write, read back by name."""
    xlsx.register(spark)
    path = scratch_path(spark, "xlsx")
    _part(spark, sf_dir).repartition(4, "p_partkey").write.format("xlsx").mode("append").save(path)
    return readers.read(spark, "xlsx", path).withColumn("p_size", F.col("p_size").cast("int"))


@query(PART_SQL)
def parquet_scan(spark, sf_dir):
    return readers.read(spark, "parquet", _copy(spark, _part(spark, sf_dir), "parquet"))


@query("SELECT n_nationkey AS product_id, n_name AS name, CASE WHEN n_regionkey = 0 THEN NULL ELSE 'region ' || n_regionkey END AS description FROM nation")
def upload_products(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").alias(" SKU "), F.col("n_name").alias("Title"), F.when(F.col("n_regionkey") != 0, F.concat(F.lit("region "), "n_regionkey")).alias("notes")).alias("p"))
    path = single_file(n.agg(F.collect_list("p").alias("products")), "json", f"{scratch_path(spark, 'up')}/in.json", ignoreNullFields=False)
    good, _ = readers.products(readers.read_upload(spark, path), "v")
    return good.select(F.col("product_id").cast("int").alias("product_id"), "name", "description")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS name, s_suppkey % 4 = 0 AS rejected FROM supplier")
def null_key_rejection(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("Code"), F.lit("").alias("id"), F.col("s_suppkey").alias("Label"))
    good, bad = readers.products(s, "v")
    return good.select("name", F.lit(False).alias("rejected")).unionByName(bad.select("name", F.lit(True).alias("rejected")))


SNAPSHOT_FILES = "SELECT o_orderkey AS vendor_product_ref, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS extra, o_orderdate AS created_at FROM orders"


@query(SNAPSHOT_FILES)
def snapshot_files(spark, sf_dir):
    """Two files of different columns in one snapshot, beside another vendor's file and a tombstone file."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vendor_product_ref"), "o_orderstatus", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("created_at"))
    folder, even = scratch_path(spark, "snapshots"), F.col("vendor_product_ref") % 2 == 0
    single_file(o.filter(even).select("vendor_product_ref", F.col("o_orderstatus").alias("status"), "created_at"), "parquet", f"{folder}/v_1.parquet")
    single_file(o.filter(~even).select("created_at", "vendor_product_ref", F.col("o_custkey").alias("extra")), "parquet", f"{folder}/v_2.parquet")
    single_file(o.limit(5), "parquet", f"{folder}/w_1.parquet")
    single_file(o.limit(5).select("vendor_product_ref"), "parquet", f"{folder}/v_tombstones.parquet")
    return readers.snapshot_union(spark, folder, "v").select("vendor_product_ref", "status", "extra", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("SELECT o_orderkey AS vendor_product_ref, o_orderdate AS removed_at FROM orders WHERE o_orderstatus = 'F'")
def tombstone_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("vendor_product_ref"), F.col("o_orderdate").alias("removed_at"))
    folder = scratch_path(spark, "stones")
    single_file(o, "parquet", f"{folder}/v_tombstones.parquet")
    none = readers.tombstones(spark, folder, "other").select("vendor_product_ref", "removed_at")
    both = readers.tombstones(spark, folder, "v").unionByName(none.withColumn("vendor_product_ref", F.col("vendor_product_ref").cast("bigint")))
    return both.select("vendor_product_ref", F.col("removed_at").cast("timestamp_ntz").alias("removed_at"))


@query("SELECT 'in_' || r_regionkey || '.csv' AS name FROM region")
def landing_files(spark, sf_dir):
    """One file for each region, beside files that the pattern or the folder of processed files leaves out."""
    folder = scratch_path(spark, "landing")
    regions = table(spark, sf_dir, "region")
    for key in [r["r_regionkey"] for r in regions.select("r_regionkey").collect()]:  # five regions
        single_file(regions.filter(F.col("r_regionkey") == key), "csv", f"{folder}/in_{key}.csv")
    single_file(regions, "csv", f"{folder}/other.txt")
    single_file(regions, "csv", f"{folder}/processed/in_9.csv")
    return readers.discover(spark, folder, "in_*.csv").select("name")


@query("SELECT json_extract_string(props, '$.k') AS k, sha256(props) AS source_content_hash, sha256('s3://b/' || event_id) AS source_file_audit_id FROM events")
def object_frames(spark, sf_dir):
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("s3://b/"), "event_id").alias("path"), F.col("props").alias("value"))
    return readers.object_frames(files, "k string, source_content_hash string")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
def golden_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("  # "), "event_id")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    path = _copy(spark, e.select(line.alias("value")).union(e.limit(3).select(F.lit("   "))), "text")
    return readers.json_lines(spark, path, "event_id bigint, event_type string").filter("_corrupt IS NULL").drop("_corrupt")


@query("SELECT 'catalog:n' || n_nationkey AS iri, n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'catalog:r' || n_regionkey END AS parent_iri, CASE WHEN n_nationkey % 3 = 0 THEN 'about ' || n_name ELSE '' END AS definition FROM nation")
def taxonomy_document(spark, sf_dir):
    n, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    node = F.struct(F.concat(F.lit("catalog:n"), key).alias("@id"), F.col("n_name").alias("prefLabel"), F.when(key % 2 == 0, F.concat(F.lit("catalog:r"), "n_regionkey")).alias("inDomain"), F.when(key % 3 == 0, F.concat(F.lit("about "), "n_name")).alias("comment"), F.array("n_name").alias("altLabel"))
    path = single_file(n.agg(F.collect_list(node).alias("@graph")), "json", f"{scratch_path(spark, 'jsonld')}/c.json")
    return readers.taxonomy_json(spark, path).select("iri", "label", "parent_iri", "definition")


@query("SELECT 'b' || user_id AS bucket, 'a b/' || event_id AS key FROM events")
def notification_refs(spark, sf_dir):
    """Direct events, storage records, and records wrapped once and twice in queue messages."""
    e = table(spark, sf_dir, "events")
    bucket, key = F.concat(F.lit("b"), "user_id"), F.concat(F.lit("a+b%2F"), "event_id")
    direct = F.to_json(F.struct(F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object")).alias("detail")))
    record = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(bucket.alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object")).alias("s3"))).alias("Records")))
    wrap = lambda body: F.to_json(F.struct(F.array(F.struct(body.alias("body"))).alias("Records")))
    kind = F.col("event_id") % 4
    body = F.when(kind == 0, direct).when(kind == 1, record).when(kind == 2, wrap(record)).otherwise(wrap(wrap(direct)))
    return readers.object_refs(e.select(body.alias("body")))


RDF_SQL = """SELECT 'urn:n' || n_nationkey AS subject, 'http://www.w3.org/2004/02/skos/core#prefLabel' AS predicate, n_name AS object, false AS object_is_iri, 'g' AS graph FROM nation
    UNION ALL SELECT 'urn:n' || n_nationkey, 'http://www.w3.org/2004/02/skos/core#broader', 'urn:r' || n_regionkey, true, 'g' FROM nation"""


@query(RDF_SQL)
def rdf_triples(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    subject = F.concat(F.lit("<urn:n"), "n_nationkey", F.lit("> "))
    label = F.concat(subject, F.lit(f"<{graph.SKOS}prefLabel> \""), "n_name", F.lit('" .'))
    broader = F.concat(subject, F.lit(f"<{graph.SKOS}broader> <urn:r"), "n_regionkey", F.lit("> ."))
    path = single_file(n.select(F.explode(F.array(label, broader)).alias("value")), "text", f"{scratch_path(spark, 'rdf')}/n.nt")
    return readers.triples(spark, path, "g")


@query("SELECT * FROM (VALUES ('col_mismatch', 'p_name', 'absent'), ('extra_cols_in_file', 'p_name', ''), ('missing_cols_in_file', '', 'absent'), ('match', '', '')) v(status, extra, missing)")
def column_algebra(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name").columns
    cases = [compare_columns(names, ["P_PARTKEY", "absent"]), compare_columns(names, ["p_partkey"]), compare_columns(names[:1], ["P_partkey", "absent"]), compare_columns(names, ["p_NAME", "p_partkey"])]
    return spark.createDataFrame([(s, ",".join(e), ",".join(m)) for s, e, m in cases], "status string, extra string, missing string")


@query("""SELECT * FROM (VALUES ('name', 'product_name'), ('product_id', 'instrument_code'), ('product_id', 'ric id'), ('description', 'executive summary'), ('name', 'x1'), ('description', 'abstract column')) v(key, label)""")
def csvw_labels(spark, sf_dir):
    """Labels of a table description by the canonical column that they point to."""
    columns = [
        {"name": "Product_Name"}, {"name": "Instrument_Code", "canonical": "product_id"}, {"titles": {"en": ["RIC id"]}}, {"titles": "Executive Summary"},
        {"name": "x1", "propertyUrl": "http://purl.org/dc/terms/title"}, {"csvw:name": "Abstract column", "csvw:propertyUrl": "dcterms:abstract"}, {"name": "zzz"},
    ]
    found = csvw.aliases({"tableSchema": {"columns": columns}}, {k: () for k in csvw.HINTS})
    return spark.createDataFrame([(k, label) for k, own in found.items() for label in own], "key string, label string")


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS known FROM orders WHERE o_orderkey < 3")
def file_ledger(spark, sf_dir):
    """Whether a file was loaded before, by name, size and outcome, for three files against a log of all orders."""
    o = table(spark, sf_dir, "orders")
    log = o.select(F.lit("d").alias("dataset_id"), F.concat(F.lit("f"), "o_orderkey").alias("file_name"), (F.col("o_orderkey") % 2 + 10).alias("file_size_bytes"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("run_status"))
    return spark.createDataFrame([(k, loaded_before(log, "d", f"f{k}", 10)) for k in range(3)], "o_orderkey bigint, known boolean")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_brand END AS picked FROM part")
def alias_pick(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    rows = p.select("p_partkey", F.when(k == 0, F.col("p_type")).when(k == 1, "").alias(" Name "), F.when(k != 2, F.col("p_brand")).alias("LABEL"))
    return rows.select("p_partkey", readers.pick(rows.columns, "name").alias("picked"))


@query("SELECT event_id, k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def required_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", tx.required(F.get_json_object("props", "$.k"), "k").alias("k"))


PAGED_SQL = """WITH own AS (SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 + 1 AS page FROM customer),
    most AS (SELECT n_nationkey, n_name, n_nationkey % 5 <> 4 AS enabled, CASE WHEN n_nationkey % 5 = 3 THEN 2 ELSE 10000 END AS max_pages FROM nation)"""


#: Pages that land in one file, a page a line: a file for each would be as many files as pages.
PAGES_A_FILE = 256


def _landed_pages(spark, sf_dir):
    """A vendor for each nation: its customers in pages of 20, each of which names the next; a fifth of vendors is off, another may pull two pages."""
    own = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.struct("c_custkey", "c_name").alias("item"))
    numbered = own.withColumn("page", F.expr("cast((row_number() OVER (PARTITION BY nation ORDER BY item.c_custkey) - 1) div 20 + 1 AS int)"))
    counts = own.groupBy("nation").agg(F.ceil(F.count(F.lit(1)) / 20).alias("last"))
    pages = numbered.groupBy("nation", "page").agg(F.collect_list("item").alias("items")).join(counts, "nation")  # 20 at most
    # page is one more than the place of a page, so it is the place of the one after it
    following = F.when(F.col("page") < F.col("last"), F.concat(F.lit("file="), F.expr(f"page div {PAGES_A_FILE}"), F.lit("#line="), F.expr(f"page % {PAGES_A_FILE}")))
    folder, file = scratch_path(spark, "pages"), F.expr(f"(page - 1) div {PAGES_A_FILE}").alias("file")
    landed = pages.select("nation", file, "page", F.to_json(F.struct("items", following.alias("next"))).alias("value"))
    landed.repartition("nation", "file").sortWithinPartitions("nation", "file", "page").drop("page").write.partitionBy("nation", "file").text(folder)
    key = F.col("n_nationkey") % 5
    return table(spark, sf_dir, "nation").join(counts.select(F.col("nation").alias("n_nationkey")), "n_nationkey").select(
        F.col("n_name").alias("vendor"), F.concat(F.lit(f"{folder}/nation="), "n_nationkey", F.lit("/file=0#line=0")).alias("endpoint"), (key != 4).alias("enabled"), F.when(key == 3, 2).alias("max_pages")
    )


@query(f"{PAGED_SQL} SELECT n_name AS vendor, page, c_custkey FROM own JOIN most ON c_nationkey = n_nationkey WHERE enabled AND page <= max_pages")
def paged_pull(spark, sf_dir):
    return paged.items(paged.pull(spark, _landed_pages(spark, sf_dir)), "c_custkey bigint").select("vendor", "page", "c_custkey")


@query(f"{PAGED_SQL} SELECT n_name AS vendor, CASE WHEN enabled THEN least(max(page), max_pages) ELSE 0 END AS pages, NOT enabled AS skipped, enabled AND max(page) > max_pages AS truncated FROM own JOIN most ON c_nationkey = n_nationkey GROUP BY n_name, enabled, max_pages")
def pull_summary(spark, sf_dir):
    vendors = _landed_pages(spark, sf_dir)
    return paged.summary(vendors, paged.pull(spark, vendors))


@query(f"{PAGED_SQL} SELECT n_name AS vendor, page - max_pages AS page, c_custkey FROM own JOIN most ON c_nationkey = n_nationkey WHERE enabled AND page > max_pages AND page <= 2 * max_pages")
def resumed_pull(spark, sf_dir):
    """The pages after those that max_pages let an earlier pull have."""
    vendors = _landed_pages(spark, sf_dir)
    more = paged.resume(spark, vendors, paged.pull(spark, vendors))
    return paged.items(more, "c_custkey bigint").select("vendor", "page", "c_custkey")
