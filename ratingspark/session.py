"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ratingspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` overrides any."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, whose
    one machine is the whole cluster, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ratingspark-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard_stored(df: DataFrame) -> None:
    """Delete the files of a table from ``cut_lineage`` that nothing reads any more; other tables stay."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that nobody refers to any more.

    It does so when the driver collects its garbage, which a driver of small tables does not for hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffled(state: DataFrame) -> DataFrame:
    """``state`` for a join that moves it between tasks and never sends it whole to all of them.

    A state table is a universe times the runs. Size estimates do not see the runs, so a table of
    gigabytes may look small enough to be collected by the driver and broadcast.
    """
    return state.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def width_for(spark: SparkSession, n_rows: int, rows_per_task: int = 50_000) -> int:
    """Partitions for ``n_rows`` rows: never more than the session is set to."""
    wanted = max(spark.sparkContext.defaultParallelism, -(-n_rows // rows_per_task))
    return max(1, min(shuffle_width(spark), wanted))
