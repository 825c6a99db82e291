"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []


def build_session(app: str = "gleaner", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is made, so
    that the rest of the code has one way to cut lineage; on a cluster a missing name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gleaner-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute, survives the loss of executors and is columnar, so
    later reads still prune columns. The table lives until the driver ends or ``clear`` is called.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear, df.sparkSession)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this driver has written to cut lineage; results that read them end with them."""
    try:
        for path in _written:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.clear()
    except Exception:  # the session has ended before: what is left stays in the folder
        pass


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than there are cores (small inputs in one
    file); larger inputs keep their splits and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
