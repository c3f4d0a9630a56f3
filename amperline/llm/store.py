"""Tables that operators write between two jobs, in the folder that all executors share.

A written table cuts the lineage: if an executor is lost later, only the job at hand is
computed again. The folder is `spark.checkpoint.dir`; where a session has none (tests on one
machine), a temporary folder of this process takes its place.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables and files, as a URI or path."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="amperline-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Afterwards the shuffle files of the job can go. Spark removes them once the driver has collected
    the job's objects, which may take until long after the next job needs the disk: with `tidy` the
    driver collects them here. Steps of a loop over small tables leave that to the next tidy step.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    schema = df.schema
    del df
    for _ in range(2 * tidy):  # the first round lets go of the Python side's handles, the second of what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `save` wrote and no later job reads."""
    for t in tables:
        spark = t.sparkSession
        base = shared_dir(spark)
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if base.removeprefix("file://") in f:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
