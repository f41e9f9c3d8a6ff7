"""Tables that outlive an executor: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Shuffle files of a written table are of no more use; without this they stay until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a master ``local[...]``, whose one machine runs everything, gets a temporary folder; any other is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext
    if not app.master.startswith("local") or app.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app.applicationId not in _local:
        _local[app.applicationId] = tempfile.mkdtemp(prefix="lexloom-")
    return _local[app.applicationId]


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again: later plans start there, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` wrote, once nothing is left to read them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._lexloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def side(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, a durable table of a few numbers a row, as the side of a join: broadcast if it has ``most`` rows at most, else left to a join that shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df
