"""Session settings shared by the tests, the bench and interactive use."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "markfuse", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session. On a cluster, pass your own session to the operators instead."""
    n = cores or os.cpu_count() or 2
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MARKFUSE_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table, by Spark's own reader, so any Hadoop file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over the session's cores by key, for work that is dear by row: a compressed file of few
    row groups is read by as few tasks, whatever the work, and all cores but theirs would be idle."""
    spark = rows.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, key)


BATCH_BYTES, SPARKS_OWN, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "8m"


def small_batches(spark: SparkSession) -> None:
    """Batches of 8 MB, or one longer row, for Python workers of this session, unless it was given a size of
    its own: the JVM and the worker both hold them, and a vectorised function gains nothing from more."""
    now = spark.conf.get(BATCH_BYTES, None)
    if now is not None and now.rstrip("b") == str(SPARKS_OWN):
        spark.conf.set(BATCH_BYTES, SMALL)


def ship(spark: SparkSession) -> None:
    """Give this package's source to the executors' Python workers, once a session: functions that run
    there are pickled by reference, and a cluster's nodes need not have the package installed. The
    archive lies in spark.checkpoint.dir; only where that is unset, as in tests, in a local folder."""
    small_batches(spark)
    sc = spark.sparkContext
    if getattr(sc, "_markfuse_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if not package.is_dir():  # already imported from a shipped archive
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    name = f"markfuse_src_{uuid.uuid4().hex}.zip"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        path = f"{shared.rstrip('/')}/{name}"
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(sc._jsc.hadoopConfiguration())
        out = files.create(target)
        out.write(packed.getvalue())
        out.close()
        files.deleteOnExit(target)
    elif not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {sc.master})")
    else:
        path = f"{tempfile.mkdtemp(prefix='markfuse-src-')}/{name}"
        Path(path).write_bytes(packed.getvalue())
    sc.addPyFile(path)
    sc._markfuse_shipped = True
