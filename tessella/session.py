"""Session settings and the folder in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_PATHS: dict[str, list[str]] = {}


def build_session(cores: int | str = 8, app: str = "tessella", **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only where
    it is unset and the session is local (tests, a single machine) one is made on this
    machine for the session; on a cluster the setting is needed."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + os.path.abspath(_LOCAL[app])


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder. What is computed from it survives the
    loss of any executor without going back to the sources."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Removes a table that `written` or a ledger has left in the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Removes all that this session has left in the shared folder, once no result is needed
    any more that was computed from it. Returns how many tables that were."""
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_written(spark, path)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many tasks as there are cores, for work that costs much more
    than moving the rows. A source of many or large files, as on a cluster, is left as it is;
    only one that a few tasks would read is repartitioned."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    tasks = max(len(df.inputFiles()), size // part)
    return df.repartition(cores) if 0 < tasks < cores else df


#: Steps of a plan that cost no more than reading a table.
_LIGHT = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "Union", "OneRowRelation", "DataSourceV2ScanRelation"}


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` itself if it only reads, filters and projects tables, else as a table in the
    shared folder, so that a plan which needs it more than once doesn't compute it again."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().split()[0] not in _LIGHT and plan.getClass().getSimpleName() not in _LIGHT:
            return written(df, name)
        children = plan.children()
        todo += [children.apply(k) for k in range(children.size())]
    return df


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with `values` for what is run within; the ones before come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
