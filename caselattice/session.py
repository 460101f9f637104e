"""Session factory and the few session-level helpers every operator may use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension may be broadcast after its size was counted.
BROADCAST_ROWS = 200_000


def build_session(app: str = "caselattice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE, Arrow).

    Sizing (executors, memory, shuffle partitions) is left to the cluster's own configuration.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine serves a local master (tests), and one beside the warehouse any other.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = context.getConf().get("spark.checkpoint.dir", None)
    if not wanted:
        if not context.master.startswith("local[") and context.master != "local":
            wanted = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoint"
        else:
            wanted = tempfile.mkdtemp(prefix="caselattice-checkpoint-")
    context.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there (survives executor loss).

    A written table also has a size of its own. A checkpointed frame keeps the size its plan was estimated at, and the estimates of
    iterated joins are multiplied with each other round by round until the driver can no longer handle the numbers.
    """
    spark = df.sparkSession
    path = f"{_table_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables ``cut`` has written in this application; frames made from them can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_table_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when a bounded count proves it has at most ``max_rows`` rows, else ``df`` unchanged.

    The count stops at ``max_rows + 1`` rows, so checking a large table stays cheap.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that it need not be installed on the executors."""
    context = spark.sparkContext
    if getattr(context, "_caselattice_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="caselattice-"), "caselattice.zip")  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(archive)
    context._caselattice_shipped = True
