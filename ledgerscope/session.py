"""Session defaults and the shared folder used for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 250_000
_LOCAL_FOLDER: dict[str, str] = {}


def build_session(app_name: str = "ledgerscope", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session for scripts, bench and tests. On a cluster the submit settings win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the one named in ``spark.checkpoint.dir``.

    A machine-local temporary folder is only used in local mode, where one
    machine holds the driver and every executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[sc.applicationId] = tempfile.mkdtemp(prefix="ledgerscope-")
    return _LOCAL_FOLDER[sc.applicationId]


def _own_folder(spark: SparkSession) -> str:
    """What this application writes lies below one folder."""
    return f"{shared_folder(spark).rstrip('/')}/ledgerscope-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def remove_intermediates(spark: SparkSession) -> bool:
    """Delete what this application has written to the shared folder; call it once its results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Materialise ``df`` as parquet and scan it back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def side_by_side(spark: SparkSession, work: list[Callable[[], object]]) -> list:
    """Results of pieces of work that do not need each other, in their order.

    Their jobs are submitted together, so cores that wait for one's last tasks or for the driver take up another's.
    """
    with ThreadPoolExecutor(max(1, len(work))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]


def spread_rows(df: DataFrame, rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """About ``rows`` rows dealt evenly, one part per core or more.

    A file's row groups may be few and large, and splits of a row group that hold no start of one stay empty,
    so the number of splits says nothing about the rows of a task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-rows // rows_per_task)))
