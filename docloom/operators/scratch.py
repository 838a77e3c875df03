"""Tables that operators write on the way, in the folder that all executors share.

Nulls and edge cases: any table may be written, an empty one too; without spark.checkpoint.dir only a local master will do. Tables are deleted by drop(), else when the process
ends, as a query that is still to run may read them until then.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table: lineage ends here, and all that read it see the same rows, also after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-core-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out], _LEFT[path] = path, spark
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing that is still to run reads them."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _discard(path)


def _discard(path: str) -> None:
    spark = _LEFT.pop(path)
    if spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path in list(_LEFT):
        _discard(path)
