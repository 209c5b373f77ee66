"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, through Spark's own reader, so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of texts.
ARROW_BYTES = 8_000_000


def for_python(docs: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of this session get few bytes, however long the texts are, unless the
    session asks for fewer yet."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")
    return docs


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores if its files give fewer partitions than there are cores."""
    rows, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def release() -> None:
    """Gives a Python worker's freed memory back, for workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names.  Only where nothing is set, as in local tests,
    a temporary folder is made and set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quadframe-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """How many partitions the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def bucket_of(n: int, *cols: Column | str) -> Column:
    """A number from 0 to n-1 that depends on the given columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whichever file system its scheme names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
