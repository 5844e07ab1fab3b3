"""Session defaults and the shared work folder.

Intermediate tables (raw-log fixtures, ledgers, stream checkpoints) go under
the folder the cluster names in ``spark.checkpoint.dir``; a local temporary
folder is created only when that setting is absent (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SESSION_DEFAULTS = {
    # Month and hour buckets, formatted times and epoch arithmetic assume UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


LISTING_TASKS_A_CORE = 2


def build_session(master: str = "local[*]", app: str = "meterwise",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in {**_SESSION_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # a listing job has a few tasks a core, not one for every object of a micro-batch
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism",
                   str(LISTING_TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    return spark


def work_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    Only when the cluster names none (tests, local runs) is a local folder
    created and registered as the context's checkpoint directory (the conf
    itself cannot be changed at runtime); later calls then find it there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meterwise-ckpt-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/") + "/meterwise"


def work_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([work_root(spark), *parts])


def fresh_path(spark: SparkSession, *parts: str) -> str:
    """A new, unique folder under the work root (one per run)."""
    return work_path(spark, *parts, uuid.uuid4().hex[:12])


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return bool(fs.exists(p))


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as a local path, if it lies in the local file system; else None."""
    fs, p = _hadoop_path(spark, path)
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def glob_exists(spark: SparkSession, pattern: str) -> bool:
    fs, p = _hadoop_path(spark, pattern)
    st = fs.globStatus(p)
    return st is not None and len(st) > 0


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder (none if it does not exist); one listing call."""
    fs, p = _hadoop_path(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to ``folder`` and read back: computed once, in as many files as its size asks for."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_folders(spark: SparkSession, schema: str, base: str, folders: list[str]) -> DataFrame:
    """Those of the partition folders below ``base`` that exist; no other folder is listed."""
    there = [f for f in folders if path_exists(spark, f)]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*there)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)
