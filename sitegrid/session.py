"""Session settings and the shared folder in which long plans are cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that any session of the library should have; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
#: Tables of this program that are in the shared folder.
_TABLES: set[str] = set()


def local_session(cores: int | str = "*", memory: str = "6g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("sitegrid").config("spark.driver.memory", memory)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.host": "127.0.0.1"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is missing and the session is local (tests, one machine) a temporary folder takes its place; on
    a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sitegrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a compressed table in the shared folder: cuts lineage, is computed once and survives lost executors.

    The table is removed by :func:`dropped`, by :func:`cleared`, or when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sitegrid_path = path
    if not _TABLES:
        atexit.register(_at_end)
    _TABLES.add(path)
    return out


def kept_path(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, made from a written table, so that :func:`dropped` removes that table."""
    df._sitegrid_path = getattr(table, "_sitegrid_path", None)
    return df


def dropped(*frames: DataFrame) -> None:
    """Remove tables made by :func:`written` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_sitegrid_path", None)
        if path:
            _removed(df.sparkSession, path)


def cleared(spark: SparkSession) -> None:
    """Remove all tables made by :func:`written` that are still there: for a session that runs on after its results are read."""
    for path in list(_TABLES):
        _removed(spark, path)


def _removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _TABLES.discard(path)


def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        cleared(spark)
