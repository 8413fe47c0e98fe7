"""Session defaults and the one place that decides where intermediate tables live."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Defaults for stand-alone use; a cluster's own settings win because get_session only fills gaps.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "stylomill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context: they need not find it by themselves."""
    sc = spark.sparkContext
    if getattr(sc, "_stylomill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="stylomill-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "stylomill_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._stylomill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: the cluster's spark.checkpoint.dir, or (unset, as in tests) a new local one."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    made = getattr(spark.sparkContext, "_stylomill_dir", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="stylomill-")
        spark.sparkContext._stylomill_dir = made
        atexit.register(shutil.rmtree, made, True)
    return "file://" + os.path.abspath(made)


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Removes what lies at a path of the shared folder when the driver's process ends."""
    atexit.register(_remove, spark, path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table in one file would otherwise be one task's work.

    Only for what comes from scans: what was shuffled is left as it is, and isn't run to count its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the cluster cleans its own folder
        local = path.split("://")[-1]
        if path.startswith("file:") and os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
