"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="tidemark-package-")) / "tidemark_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a session in one process sets a temporary folder of
    its own; on a cluster each executor would write to its own disk, so that
    raises.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_once(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written files are the recovery point: later stages reread them instead
    of recomputing, and values that depend on where a row was processed
    (partition numbers, local ranks) are fixed from here on.  The files go with
    ``discard`` or, at the latest, when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.option("compression", "zstd").parquet(path)
    jpath, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(jpath)
    back = spark.read.schema(out.schema).parquet(path)
    back.written_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables of ``write_once`` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "written_path", None)
        if path:
            jpath, fs = _hadoop_path(t.sparkSession, path)
            fs.delete(jpath, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
