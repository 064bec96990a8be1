"""Session, shared scratch space and table access used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}
#: Rows that a task takes from a shuffle within sized(), on average.
TASK_ROWS = 1 << 19
#: Bytes up to which small partitions become one within sized(), and from which a skewed one is split.
MERGED, SKEWED = "8m", "32m"
#: Bytes of a batch that goes to Python within batched(), or one row.
BATCH_BYTES = "4m"


def session(app: str = "tarnwick", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; conf overrides any setting."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``.

    All executors must see that folder. Where it is unset in local mode, as in tests, a
    temporary folder of this machine takes its place and is set on the context; on a
    cluster that raises an error.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key not in _SCRATCH:
        top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
            top = "file://" + tempfile.mkdtemp(prefix="tarnwick-")
            sc.setCheckpointDir(top)
        _SCRATCH[key] = f"{top.rstrip('/')}/tarnwick-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _SCRATCH[key])
    return _SCRATCH[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM may have gone first
        pass


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop, so that any store Spark reads will do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that outlives any executor, and the columnar files
    let later reads take only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run inside shuffle about this many rows, so that a task's share does not grow with them.

    Adaptive execution otherwise merges partitions until there are as many as cores.
    """
    settings = {
        "spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": MERGED,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": SKEWED,
    }
    with _set(spark, settings):
        yield


@contextmanager
def batched(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside hand rows to Python in batches of about BATCH_BYTES at most, for wide rows."""
    with _set(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}):
        yield
