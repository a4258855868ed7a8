"""Tables that cut lineage: written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only on one machine that has none set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _FOLDERS.setdefault("", "file://" + tempfile.mkdtemp(prefix="corpus-"))
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own, which survives the loss of any executor; the application's tables go when it ends."""
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/corpus-{spark.sparkContext.applicationId}"
    if home not in _FOLDERS:
        _FOLDERS[home] = home
        atexit.register(_drop, spark, home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(df: DataFrame, mb: float) -> int:
    """Partitions for a shuffle of rows that come from all of ``df``: one for each ``mb`` MB of its files, and no fewer than there are cores. What a task holds then
    doesn't grow with the input, however many partitions the session sets."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(s for s in sizes if s < 1 << 60) / (mb * 1e6)))


def _drop(spark: SparkSession, home: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
