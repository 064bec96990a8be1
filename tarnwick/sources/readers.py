"""File formats by name. A reader is a function of (spark, path, options) that gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_truthy
from ..runtime import written
from . import rdf, xlsx

#: Largest upload that read_upload() takes as a whole.
UPLOAD_ROWS = 10_000
#: Header names under which a canonical column may come, in order.
ALIASES = {
    "product_id": ("product_id", "id", "code", "ticker", "symbol", "sku"),
    "name": ("name", "product", "product_name", "title", "label", "description_short"),
    "description": ("description", "desc", "details", "long_description", "notes"),
}

Reader = Callable[[SparkSession, str, Mapping], DataFrame]


def _csv(spark: SparkSession, path: str, options: Mapping) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", options.get("delimiter") or ",").option("escape", '"')
    return reader.schema(options["schema"]).csv(path) if "schema" in options else reader.option("inferSchema", True).csv(path)


def _json(spark: SparkSession, path: str, options: Mapping) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(options["schema"]) if "schema" in options else reader).json(path)


def _xml(spark: SparkSession, path: str, options: Mapping) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", options.get("row_tag") or "record")
    return (reader.schema(options["schema"]) if "schema" in options else reader).load(path)


def _parquet(spark: SparkSession, path: str, options: Mapping) -> DataFrame:
    return spark.read.parquet(path)


def _xlsx(spark: SparkSession, path: str, options: Mapping) -> DataFrame:
    return xlsx.read(spark, path, options.get("sheet_name"), options.get("schema"))


READERS: dict[str, Reader] = {"csv": lambda s, p, o: _csv(s, p, {**o, "delimiter": ","}), "txt": _csv, "json": _json, "xlsx": _xlsx, "xml": _xml, "parquet": _parquet}


def read(spark: SparkSession, data_format: str, path: str, **options) -> DataFrame:
    """Read a file of a registered format; an unknown one raises ValueError."""
    try:
        reader = READERS[data_format.lower()]
    except KeyError:
        raise ValueError(f"no reader for format {data_format!r}; known: {', '.join(sorted(READERS))}") from None
    return reader(spark, path, options)


def discover(spark: SparkSession, folder: str, pattern: str, skip: str = "processed") -> DataFrame:
    """Files of a landing folder that match the pattern, the oldest first: path, name, length, modified."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    except AnalysisException:
        return spark.createDataFrame([], "path string, name string, length bigint, modified timestamp")
    found = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    return found.filter(~F.contains("path", F.lit(f"/{skip}/"))).orderBy("modified", "path")


def snapshot_union(spark: SparkSession, folder: str, vendor: str, instants: tuple[str, ...] = ("ingested_at", "created_at", "modified_at", "removed_at")) -> DataFrame:
    """All Parquet files of a vendor by column name, without tombstones; instants become UTC timestamps."""
    files = spark.read.option("mergeSchema", True).option("pathGlobFilter", f"{vendor}_*.parquet").parquet(folder)
    kept = files.filter(~F.contains(F.input_file_name(), F.lit("_tombstones")))
    return kept.withColumns({c: F.col(c).cast("timestamp") for c in instants if c in files.columns})


def tombstones(spark: SparkSession, folder: str, vendor: str) -> DataFrame:
    """The vendor's removed products, an empty table where there is no such file."""
    try:
        return spark.read.parquet(f"{folder}/{vendor}_tombstones.parquet").withColumn("removed_at", F.col("removed_at").cast("timestamp"))
    except AnalysisException:
        return spark.createDataFrame([], "vendor_product_ref string, title string, removed_at timestamp")


def pick(columns: list[str], key: str, aliases: Mapping[str, tuple[str, ...]] = ALIASES) -> Column:
    """The first alias of key with a value; header names are compared trimmed and in lower case, the last of equal ones holds."""
    by_name = {c.strip().lower(): c for c in columns}
    return first_truthy(*(F.col(f"`{by_name[a]}`").cast("string") for a in aliases[key] if a in by_name))


def products(rows: DataFrame, vendor: str, aliases: Mapping[str, tuple[str, ...]] = ALIASES) -> tuple[DataFrame, DataFrame]:
    """Products to match, and the rows rejected because they have no product id."""
    raw = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in rows.columns)), F.array(*(F.col(f"`{c}`").cast("string") for c in rows.columns))), lambda k, v: v.isNotNull())
    named = rows.select(F.lit(vendor).alias("vendor"), *(pick(rows.columns, k, aliases).alias(k) for k in ("product_id", "name", "description")), raw.alias("raw"))
    return named.filter("product_id IS NOT NULL"), named.filter("product_id IS NULL")


def read_upload(spark: SparkSession, path: str, limit: int = UPLOAD_ROWS) -> DataFrame:
    """Rows of a JSON list, {"products": [...]}, a single object, a CSV or a TSV file; more than limit rows are an error of the whole file."""
    low = path.lower()
    if low.endswith(".json"):
        whole = spark.read.option("multiLine", True).json(path)
        rows = whole.select(F.explode("products").alias("p")).select("p.*") if whole.columns == ["products"] else whole
    else:
        rows = _csv(spark, path, {"delimiter": "\t" if low.endswith((".tsv", ".tab")) else ","})
    if len(rows.limit(limit + 1).select(F.lit(1)).collect()) > limit:
        raise ValueError(f"{path} has more than {limit} rows")
    return rows


def object_frames(files: DataFrame, schema: str) -> DataFrame:
    """One product per text file (path, value): the digest and the audit id come from the reader, never from the payload.

    A payload of another shape raises an error.
    """
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    fields = [f.name for f in T._parse_datatype_string(schema).fields if f.name not in ("source_content_hash", "source_file_audit_id")]
    made = files.withColumn("p", parsed)
    return made.select(*(F.col(f"p.{f}").alias(f) for f in fields), F.sha2("value", 256).alias("source_content_hash"), F.sha2("path", 256).alias("source_file_audit_id"))


def json_lines(spark: SparkSession, path: str, schema: str, comments: bool = True) -> DataFrame:
    """JSON lines; blank and, if comments is set, # lines are skipped, others that don't parse are kept in _corrupt."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value")
    kept = lines.filter(F.trim("value") != "")
    kept = kept.filter(~F.startswith(F.trim("value"), F.lit("#"))) if comments else kept
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return kept.select(parsed.alias("p")).select("p.*")


def golden_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a golden set; blank lines and # lines are skipped, one that doesn't parse is an error that names its file and line.

    Each file is read whole, for its line numbers; such files are small.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    kept = files.filter((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit("#")))
    parsed = kept.withColumn("p", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(":"), (F.col("at") + 1).cast("string"), F.lit(": no case of the golden set")))
    checked = parsed.withColumn("p", F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), wrong).otherwise(F.col("p")))
    return checked.select("p.*").drop("_corrupt")


def taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a JSON-LD catalogue under @graph or nodes: iri, label, parent_iri, definition, alt_labels."""
    whole = spark.read.option("multiLine", True).json(path)
    key = next(k for k in ("@graph", "nodes") if k in whole.columns)
    nodes = whole.select(F.explode(f"`{key}`").alias("n")).select("n.*")

    def one(*names: str) -> Column:
        return first_truthy(*(F.col(f"`{n}`").cast("string") for n in names if n in nodes.columns))

    iri = one("iri", "@id", "id")
    tail = F.element_at(F.split(iri, "[:/#]"), -1)
    alternatives = [F.col(f"`{n}`") for n in ("alt_labels", "altLabel", "synonyms") if n in nodes.columns]
    return nodes.select(
        iri.alias("iri"),
        F.coalesce(one("label", "prefLabel", "rdfs:label", "name"), tail).alias("label"),
        one("parent_iri", "inSubdomain", "inDomain").alias("parent_iri"),
        F.coalesce(one("definition", "description", "comment"), F.lit("")).alias("definition"),
        (alternatives[0] if alternatives else F.array().cast("array<string>")).alias("alt_labels"),
    )


_REF = "struct<detail:struct<bucket:struct<name:string>,object:struct<key:string>>,Records:array<struct<body:string,s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>>"


def object_refs(events: DataFrame, body: str = "body") -> DataFrame:
    """bucket and key of every object that notifications name, directly or wrapped in queue messages, however often.

    Each level of wrapping is one round, written; the last one holds no wrapped record.
    """
    found, level = [], events.select(F.col(body).alias("b"))
    while True:
        parsed = level.select(F.from_json("b", _REF).alias("e"))
        found.append(parsed.select(F.col("e.detail.bucket.name").alias("bucket"), F.col("e.detail.object.key").alias("key")))
        records = parsed.filter("e.detail.bucket.name IS NULL").select(F.explode("e.Records").alias("r"))
        found.append(records.filter("r.body IS NULL").select(F.col("r.s3.bucket.name").alias("bucket"), F.col("r.s3.object.key").alias("key")))
        level = written(records.filter("r.body IS NOT NULL").select(F.col("r.body").alias("b")), "wrapped")
        if level.isEmpty():
            break
    refs = reduce(DataFrame.unionByName, found).filter("bucket IS NOT NULL AND key IS NOT NULL")
    return refs.select("bucket", F.url_decode("key").alias("key"))


def triples(spark: SparkSession, path: str, graph: str = "default") -> DataFrame:
    return rdf.read(spark, path, graph)
