"""Session and column helpers of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: the session's ``spark.checkpoint.dir``. Only where
    that is unset (single-machine tests) a temporary folder is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps start from
    files that outlive any executor. The application's folder is deleted when it ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if root not in _OWN:
        _OWN[root] = root
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def fresh(df: DataFrame | list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    out = []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Largest table of ids (in bytes at 8 per id) that is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (one bigint column, already cut, so counting it
    reads only file footers). The ids are broadcast up to ``BROADCAST_BYTES``; beyond that both
    sides are shuffled on the id. A null id is never dropped."""
    key = fresh(docs, "_drop")[0]
    side = ids.select(F.col(ids.columns[0]).alias(key))
    if ids.count() * 8 <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return docs.join(side, col(id_col) == side[key], "left_anti")
