"""Session settings shared by the bench, the tests and the examples."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "rosterloom", **conf: str) -> SparkSession:
    """A session with AQE on and UTC dates.  On a cluster the submitter's own
    settings win: nothing here sizes executors or shuffle partitions for it, and
    a master is set only if the caller names one or none is configured."""
    if master is None and SparkConf().get("spark.master", None) is None:
        master = "local[*]"
    builder = (
        (SparkSession.builder.master(master) if master else SparkSession.builder)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    keep_methods_small(spark)
    ship_package(spark)
    return spark


def keep_methods_small(spark: SparkSession) -> None:
    """Methods above this size are never compiled by the JVM's JIT; a stage that
    would have one runs as projections of many small methods instead."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context.

    Only the readers and the workbook writer run in workers.  Where the package
    is installed on the executors or was submitted with ``--py-files`` this is
    not needed."""
    context = spark.sparkContext
    if getattr(context, "_rosterloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rosterloom-")) / "rosterloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(str(archive))
    context._rosterloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for ``DataFrame.checkpoint``.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only where
    that is unset and the session is a local one is a temporary folder used.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="rosterloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the checkpoint folder and read it from there, so that
    what is used more than once is worked out once."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
