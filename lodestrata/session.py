"""Session helpers: the package on the workers, tables in the shared scratch folder, a local session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "lodestrata") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Lets the Python workers import this package, wherever the driver found it. Once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), "lodestrata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    sc._lodestrata_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of
    its own; a cluster's machines share no such folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestrata-scratch-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def is_local(spark: SparkSession) -> bool:
    """Driver and tasks are one process."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. The application's part of that folder goes when the application ends; results
    are lazy and may read it until then. What no result reads any more goes before, by drop_stored."""
    sc = spark.sparkContext
    own = f"{scratch_dir(spark)}/lodestrata-{sc.applicationId}"
    if getattr(sc, "_lodestrata_scratch", None) != own:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._lodestrata_scratch = own
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, and it survives the loss of
    executors. ``df.stored_at`` of the result is the path, for drop_stored."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Bytes of a table for each core below which spread() deals it out.
SPREAD_BYTES = 32_000_000


def spread(df: DataFrame) -> DataFrame:
    """A table for work that is hard on each row. One of a few megabytes for each core is often a single file or row group,
    and so a single task; its rows are dealt out to all cores. Larger tables are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def drop_stored(df: DataFrame) -> None:
    """Deletes a table that stored() has written and that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
