"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables below so many bytes a core are dealt out anew.
SMALL_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table out over all cores: it may be one file with a single row group, which one task would read.

    The planner's size estimate decides, so no large table is ever shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_BYTES else df


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="logloom-")
    return _OWN[context.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    Executors may be lost at any later time, since the files belong to none of them. The files go by ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/logloom/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    made = spark.read.schema(schema).parquet(path)
    made._ll_path = path
    return made


def discard(df: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more; what is no such table is left alone."""
    path = getattr(df, "_ll_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before the interpreter
        return


def parts(batch: pa.RecordBatch, most_bytes: int = 4 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch that hold about ``most_bytes`` of text each, but one row at least, to bound memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
