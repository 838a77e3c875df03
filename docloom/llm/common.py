"""Helpers shared by the text operators: tables, shared storage, and rows carried beside what is computed."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents, and bytes of text, handled together inside a task; bounds the memory of the numpy steps. One longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local folder on a local master; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCRATCH: list[list[str]] = []


def written(df: DataFrame, name: str = "cut", keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no recomputation.

    The table stays until drop() or the end of the innermost scratch() around this call, which leaves out those to keep.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing that is still to run reads them."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            discard(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables written inside; what is to outlive it must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of ours in the shared folder, through Spark's own file system layer."""
    if "/docloom-" not in path:
        raise ValueError(f"not a table of this library: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def named(column: str) -> F.Column:
    """The column of just that name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """All columns as the struct `row`, with doc_id and text beside it: no added name can clash with a column of df."""
    text = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def map_texts(df: DataFrame, compute: Callable[[list[str]], dict[str, list]], added: T.StructType, keep: tuple[str, ...], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add to the columns `keep` of df what compute makes of its column text (null: empty), in slices of slice_rows rows and SLICE_BYTES at most.

    compute gets a list of whole texts and returns lists of equal length, one for each field of `added`.
    """
    schema = T.StructType([df.schema[c] for c in keep] + list(added.fields))
    source = df.select(*keep, *([] if "text" in keep else ["text"]))
    to_arrow = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(batch.schema.get_field_index("text")), slice_rows, SLICE_BYTES):
                part = batch.slice(at, end - at)
                found = compute([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                arrays += [pa.array(found[f.name], type=f.type) for f in to_arrow]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *to_arrow.names])

    return source.mapInArrow(run, schema)


def slices(text: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of a column of strings, of so many rows and bytes at most; a longer string is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield at, end
        at, before = end, int(ends[end - 1])


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def held_out(doc_id) -> F.Column:
    """True where no label may be learnt from: crc32 of the id as text leaves 1 when divided by 3 (null id: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `rows` labelled documents that may be learnt from, each of at most max_bytes.

    The sample is the rows of least hash of the id, so it is the same at every run; both bounds are the callers' documented parameters.
    Only these rows come to the driver.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(picked), "doc_id")  # at most `rows` rows of two numbers
        .where(F.octet_length("text") <= max_bytes)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
        .select("text", "y").collect()
    )
    return [r.text for r in found], [r.y for r in found]


def env_single_thread() -> None:
    """The tokenizers library must not start threads of its own inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
