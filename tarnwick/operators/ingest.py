"""Loading files into registered tables: transforms, reconciliation, row rejects, run log, sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import job_id, unordered_digest
from ..functions.text import recase, reformat_date, trim
from ..sources import readers

#: Logical type names and their SQL types; all others are text.
TYPES = {"integer": "bigint", "decimal": "double", "boolean": "boolean", "datetime": "timestamp_ntz", "date": "date"}
AUDIT = ("load_id", "provider_id", "dataset_id", "load_date", "load_process")
OBJECT_BYTES = 512 << 20


@dataclass(frozen=True)
class Rule:
    """A column's transforms, applied in the order trim, null replacement, case, date format."""

    column: str
    trim: str | None = None
    null_replace: str | None = None
    case: str | None = None
    date_from: str | None = None
    date_to: str | None = None

    def empty(self) -> bool:
        return not any((self.trim, self.null_replace, self.case, self.date_from and self.date_to))


def transform(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """One projection with every column's rules; names match without case, unknown ones are ignored.

    Text rules on a column of another type raise TypeError, as they are mistakes of the
    registry that would otherwise change values silently.
    """
    by_name = {r.column.lower(): r for r in rules}
    out = []
    for f in df.schema.fields:
        c, rule = F.col(f"`{f.name}`"), by_name.get(f.name.lower())
        if rule and not rule.empty():
            if (rule.trim or rule.case) and not isinstance(f.dataType, T.StringType):
                raise TypeError(f"text rule on column {f.name} of type {f.dataType.simpleString()}")
            c = trim(c, rule.trim) if rule.trim else c
            c = F.coalesce(c, F.lit(rule.null_replace).cast(f.dataType)) if rule.null_replace else c
            c = recase(c, rule.case) if rule.case else c
            c = reformat_date(c, rule.date_from, rule.date_to) if rule.date_from and rule.date_to else c
        out.append(c.alias(f.name))
    return df.select(out)


def compare_columns(found: Iterable[str], registered: Iterable[str]) -> tuple[str, list[str], list[str]]:
    """Status, columns only in the file, registered columns that it lacks; names are compared without case."""
    have, want = {c.lower() for c in found}, {c.lower() for c in registered}
    extra, missing = sorted(have - want), sorted(want - have)
    status = "col_mismatch" if extra and missing else "extra_cols_in_file" if extra else "missing_cols_in_file" if missing else "match"
    return status, extra, missing


def split_rows(df: DataFrame, registered: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose registered columns all cast, typed, and the others as they are.

    A row is bad if a value is there and its cast is null. Registered columns that the file
    lacks are null.
    """
    cells, bad = _casts(df, registered)
    return df.filter(~bad).select(cells), df.filter(bad)


def _casts(df: DataFrame, registered: Mapping[str, str]) -> tuple[list[Column], Column]:
    """Typed cells, and whether a row is bad."""
    by_name = {c.lower(): c for c in df.columns}
    cells, bad = [], F.lit(False)
    for name, kind in registered.items():
        sql_type = TYPES.get(kind, "string")
        if name.lower() in by_name:
            c = F.col(f"`{by_name[name.lower()]}`")
            cast = c.try_cast(sql_type)
            bad = bad | (c.isNotNull() & cast.isNull())
            cells.append(cast.alias(name))
        else:
            cells.append(F.lit(None).cast(sql_type).alias(name))
    return cells, bad


def audited(df: DataFrame, run_id: str, provider_id: str, dataset_id: str, process: str = "file") -> DataFrame:
    values = (F.lit(run_id), F.lit(provider_id), F.lit(dataset_id), F.current_timestamp(), F.lit(process))
    return df.withColumns(dict(zip(AUDIT, values)))


@dataclass
class Dataset:
    dataset_id: str
    provider_id: str
    data_format: str
    folder: str
    pattern: str
    target: str
    columns: Mapping[str, str]
    rules: list[Rule] = field(default_factory=list)
    options: dict = field(default_factory=dict)


RUN_LOG = "run_id string, seq int, provider_id string, dataset_id string, run_date timestamp, run_status string, column_status string, status_notes string, file_path string, file_name string, file_size_bytes bigint, records_found bigint, records_loaded bigint, records_skipped bigint, target_table string, error_detail string"


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The last event of each run."""
    events = spark.read.schema(RUN_LOG).parquet(path)
    names = [n for n in events.columns if n not in ("run_id", "seq")]
    return events.groupBy("run_id").agg(F.max_by(F.struct(*names), "seq").alias("e")).select("run_id", "e.*")


def loaded_before(log: DataFrame, dataset_id: str, name: str, size: int) -> bool:
    """Whether a run of the dataset loaded a file of this name and size with full success."""
    return not log.filter((F.col("dataset_id") == dataset_id) & (F.col("file_name") == name) & (F.col("file_size_bytes") == size) & (F.col("run_status") == "success")).isEmpty()


def ingest(spark: SparkSession, dataset: Dataset, log_path: str, archive: bool = True) -> list[dict]:
    """Load every new file of a dataset, one job each, and log each file's outcome; errors end in the log, not the run.

    A file is skipped if one of its name and size was loaded with success. Good rows are
    appended, others are counted as skipped and make the run partial. No overlap of
    columns fails the file. Loaded files are moved away; if that fails the run is partial.
    """
    outcomes = []
    files = readers.discover(spark, dataset.folder, dataset.pattern).collect()
    if not files:
        outcomes.append(_log(spark, log_path, dataset, None, run_status="skipped", status_notes="no files"))
    for f in files:
        known = _exists(spark, log_path)
        if known and loaded_before(run_log(spark, log_path), dataset.dataset_id, f["name"], f["length"]):
            outcomes.append(_log(spark, log_path, dataset, f, run_status="skipped", status_notes="loaded before"))
            continue
        run = _log(spark, log_path, dataset, f, run_status="in_progress")
        try:
            raw = transform(readers.read(spark, dataset.data_format, f["path"], **dataset.options), dataset.rules)
            status, extra, missing = compare_columns(raw.columns, dataset.columns)
            if len(missing) == len(dataset.columns):
                raise ValueError("no registered column is in the file")
            cells, bad = _casts(raw, dataset.columns)
            counts = Observation("rows")  # the counts come with the write, so the file is read once
            seen = raw.observe(counts, F.count(F.lit(1)).alias("found"), F.count_if(bad).alias("skipped"))
            audited(seen.filter(~bad).select(cells), run["run_id"], dataset.provider_id, dataset.dataset_id).write.mode("append").parquet(dataset.target)
            found, skipped = counts.get["found"], counts.get["skipped"]
            result = {"run_status": "partial" if skipped else "success", "column_status": status, "records_found": found, "records_loaded": found - skipped, "records_skipped": skipped, "status_notes": "; ".join([*(f"extra {c}" for c in extra), *(f"missing {c}" for c in missing)])}
            if archive and not move(spark, f["path"], dataset.folder):
                result |= {"run_status": "partial", "status_notes": "file was not moved"}
        except Exception as error:  # an outcome of the file, by contract
            result = {"run_status": "failed", "error_detail": f"{type(error).__name__}: {error}"[:2000]}
        outcomes.append(_log(spark, log_path, dataset, f, run, **result))
    return outcomes


def _log(spark: SparkSession, path: str, dataset: Dataset, file, run: dict | None = None, **values) -> dict:
    import uuid

    now = datetime.now(timezone.utc)
    row = dict.fromkeys(T._parse_datatype_string(RUN_LOG).fieldNames()) | {"run_id": uuid.uuid4().hex, "seq": 0, "provider_id": dataset.provider_id, "dataset_id": dataset.dataset_id, "run_date": now, "target_table": dataset.target}
    if file is not None:
        row |= {"file_path": file["path"], "file_name": file["name"], "file_size_bytes": file["length"]}
    row |= (run or {}) | values
    row["seq"] = run["seq"] + 1 if run else 0
    spark.createDataFrame([tuple(row.values())], RUN_LOG).coalesce(1).write.mode("append").parquet(path)
    return row


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def move(spark: SparkSession, path: str, folder: str) -> bool:
    """Move a file below processed/<time>/ of its folder; whether it worked."""
    fs, source = _fs(spark, path)
    to = f"{folder}/processed/{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    try:
        fs.mkdirs(_fs(spark, to)[1])
        return fs.rename(source, _fs(spark, f"{to}/{source.getName()}")[1])
    except Exception:
        return False


def run_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("run_status").agg(F.count(F.lit(1)).alias("n"))


def quarantine(files: DataFrame, bucket: str = "bucket", key: str = "key", body: str = "body", length: str = "length") -> DataFrame:
    """Files with reason (null: good) and job_id: empty, over the size limit, or no JSON."""
    reason = F.when(F.col(length) == 0, "empty").when(F.col(length) > OBJECT_BYTES, "too large").when(F.try_parse_json(body).isNull(), "not JSON")
    return files.withColumn("reason", reason).withColumn("job_id", job_id(F.col(bucket), F.col(key)))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row by key of both tables; on equal order a change wins."""
    names = [c for c in current.columns if c not in keys]
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.select(current.columns).withColumn("__new", F.lit(1)))
    latest = both.groupBy(keys).agg(F.max_by(F.struct(*names), F.struct(F.col(order), F.col("__new"))).alias("r"))
    return latest.select(*keys, *(F.col(f"r.{n}").alias(n) for n in names)).select(current.columns)


def replace_partition(df: DataFrame, path: str, column: str = "dataset_id") -> None:
    """Replace all rows of the datasets in df and leave the others'."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def graph_digests(quads: DataFrame) -> DataFrame:
    """Per graph a digest of its triples that doesn't depend on their order."""
    line = F.to_json(F.struct("subject", "predicate", "object"))
    return quads.select("graph", line.alias("line")).distinct().groupBy("graph").agg(unordered_digest(F.col("line")).alias("digest"))


def to_publish(quads: DataFrame, published: DataFrame) -> DataFrame:
    """Quads of graphs that are new or changed against the published (graph, digest)."""
    fresh = graph_digests(quads).join(published.select("graph", "digest"), ["graph", "digest"], "left_anti").select("graph")
    return quads.join(fresh, "graph", "left_semi")


def search_documents(events: DataFrame, fields: list[str], id_col: str = "event_id") -> DataFrame:
    return events.select(F.sha2(F.col(id_col).cast("string"), 256).alias("doc_id"), *fields)


def schema_of(df: DataFrame) -> dict[str, str]:
    """Logical types of a frame's columns, for registration."""
    def kind(t: T.DataType) -> str:
        if isinstance(t, T.IntegralType):
            return "integer"
        if isinstance(t, T.FractionalType):
            return "decimal"
        return {"boolean": "boolean", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "date"}.get(t.typeName(), "string")

    return {f.name: kind(f.dataType) for f in df.schema.fields}


def evolve(registered: DataFrame, submitted: Mapping[str, str]) -> DataFrame:
    """Add-only evolution of (col_name, col_type, col_position): types may change, new columns come last, none is dropped."""
    rows = {r["col_name"].lower(): r for r in registered.collect()}  # one row per column
    last = max((r["col_position"] for r in rows.values()), default=0)
    out = [(r["col_name"], {k.lower(): v for k, v in submitted.items()}.get(k, r["col_type"]), r["col_position"]) for k, r in rows.items()]
    new = [k for k in submitted if k.lower() not in rows]
    out += [(k, submitted[k], last + 1 + i) for i, k in enumerate(new)]
    return registered.sparkSession.createDataFrame(out, "col_name string, col_type string, col_position int")

