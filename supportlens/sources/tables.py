"""Reading the given Parquet tables and staging intermediate results.

A staged table is written to the folder all executors share (``spark.checkpoint.dir``), so a lost
executor costs a re-read and not the lineage. Only in local mode (tests, a laptop) a folder of this machine is set up
where that setting is missing; on a cluster that is an error. What is staged is deleted by ``unstage`` as
soon as no plan needs it, and the rest when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that no node needs it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_supportlens_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="supportlens-code-")) / "supportlens.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(archive))
    sc._supportlens_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Columns are pruned by the scan, so callers select late or early as they like."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir``; in local mode a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="supportlens-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep_until_exit(spark: SparkSession, *paths: str) -> None:
    """Has folders of the shared folder deleted when the application ends, if nothing deletes them before."""
    sc = spark.sparkContext
    for path in paths:
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def stage(df: DataFrame, label: str, tidy: bool = False, rows_a_file: int = 0) -> DataFrame:
    """Writes df once to the shared folder and returns the written table: the lineage ends here.

    The folder is kept under ``df.staged_at`` for ``unstage``. tidy: what the write shuffled is deleted as it ends, not when the
    driver happens to collect its garbage. rows_a_file: files are cut there, so that readers share them out evenly; 0 is never.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    try:
        if tidy:
            spark.conf.set(name, "true")
        df.write.options(compression="zstd", maxRecordsPerFile=rows_a_file).parquet(path)
    finally:
        if tidy:
            spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    keep_until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder's file system."""
    sc = spark.sparkContext
    for path in paths:
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


def unstage(*frames: DataFrame | None) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            remove(df.sparkSession, path)
