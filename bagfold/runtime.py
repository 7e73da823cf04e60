"""Session helpers: code shipping and tables in the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and bound the Arrow batches of the session.

    Spark's default of 64 MB a batch is held several times on both sides of the pipe; small batches cost nothing here.
    """
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH_BYTES, None) in (None, "64MB", "67108864b"):
        spark.conf.set(BATCH_BYTES, "4m")
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local session, whose executors are the driver, may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"bagfold-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder, with its file system's scheme."""
    files, place = _files(spark, f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}")
    return files.makeQualified(place).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something was written whole at ``path``, in any store."""
    files, place = _files(spark, path)
    return files.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS"))


def delete_at_end(spark: SparkSession, path: str) -> None:
    """What is at ``path`` (it must be there already) goes when the application ends."""
    files, place = _files(spark, path)
    files.deleteOnExit(place)


#: Tables that ``materialize`` wrote: application, path, and a weak reference to what every plan that reads the table holds.
_TABLES: list[tuple[str, str, object]] = []


def drop_unread(spark: SparkSession) -> None:
    """Delete the scratch tables that no plan reads any more, whoever made them. A table stays while any DataFrame built on it lives."""
    gc.collect()
    spark._jvm.System.gc()
    app, kept = spark.sparkContext.applicationId, []
    for entry in _TABLES:
        if entry[0] == app and entry[2].get() is None:
            files, place = _files(spark, entry[1])
            files.delete(place, True)
        elif entry[0] == app:
            kept.append(entry)
    _TABLES[:] = kept


def materialize(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is cut there, and
    a lost executor costs a file read instead of everything before it. ``folders``: last columns, each value in a folder of its own."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*folders).parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    read = out._jdf.queryExecution().analyzed().relation().location()
    _TABLES.append((spark.sparkContext.applicationId, path, spark._jvm.java.lang.ref.WeakReference(read)))
    return out


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
