"""The folder that driver and executors share, and cutting lineage through it."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folders written within each scratch() that this thread has open, innermost last. A new thread begins without any.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratch", default=())
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set, a temporary folder on a local master, as
    in tests; on a cluster that is an error, as executors do not see the driver's folders."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    if named.startswith("file:/") and not named.startswith("file://"):
        named = "file://" + named.removeprefix("file:")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, purpose: str, keep: bool = False) -> str:
    """A path that nothing uses; what is written there goes with the innermost scratch(), or with `keep` with the one around it."""
    path = f"{shared_dir(spark)}/kinloom-{purpose}-{uuid.uuid4().hex}"
    around = _OPEN.get()[: -1 if keep else None]
    if around:
        around[-1].append(path)
    return path


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    """Within, shuffle files go when the query that wrote them ends."""
    old = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if old is None else spark.conf.set(_CLEAN_UP, old)


@contextlib.contextmanager
def sorted_joins(spark: SparkSession):
    """Within, joins are by sort-merge, which spills: by the size of its file a table that grows with the input can
    pass for a small one, and in the driver's memory it is many times that. F.broadcast holds all the same.

    This is for what is run within; a data frame that is handed out says hint("merge").
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session has shuffle partitions, however few files and row groups it is
    read from: one row group is one task, and it takes as long as all its rows do."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Write df as Parquet, in a folder for each value of the columns `by`; its shuffle files go with the query."""
    with _tidy(df.sparkSession):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)


def written(df: DataFrame, purpose: str, keep: bool = False, tidy: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later steps start from files
    that every executor sees, so a lost executor repeats nothing that came before.

    With `tidy` the shuffle files of the query go with its end, for jobs of many steps over large tables.
    """
    spark = df.sparkSession
    path = fresh_path(spark, purpose, keep)
    write(df, path) if tidy else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, keys: list[str], purpose: str):
    """df as a table in the shared folder, in as many buckets by keys as the session has shuffle
    partitions: joins and groups by the keys do not move its rows again. The table's name goes at the end."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, purpose)
    name = "kinloom_" + uuid.uuid4().hex
    with _tidy(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What this thread writes to the shared folder within is deleted at the end, unless it ends by an
    error. Data frames made within must not be read afterwards."""
    paths: list[str] = []
    token = _OPEN.set((*_OPEN.get(), paths))
    try:
        yield
        remove(spark, paths)
    finally:
        _OPEN.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
