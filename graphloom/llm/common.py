"""Scratch tables, row identity and small numeric helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A temporary folder stands in only where driver and executors are one
    process (plain ``local`` masters, as in tests); a cluster without the
    setting is an error, since a machine-local folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="graphloom-")
    return "file://" + _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/graphloom-{uuid.uuid4().hex}/{label}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with data that outlives any executor, and lets Spark drop
    the shuffle files behind it, which nothing reads again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``save`` wrote, once nothing will read them again."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        for f in {x.rpartition("/")[0] for x in t.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(f)
            folder.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_key(text: Column) -> Column:
    """128-bit identity of a text as hex; null counts as the empty text."""
    return F.md5(F.coalesce(text, F.lit("")))


def doc_key(doc_id: Column, text: Column) -> Column:
    """A non-null long: the id itself, or a negative hash of the text without one."""
    return F.coalesce(doc_id.cast("long"), -F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1) - 1)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name_1`` and so on if the table has such a column already (letters' case apart)."""
    taken, out, i = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        i += 1
        out = f"{name}_{i}"
    return out


def chunks(texts, limit_bytes: int = 4_000_000):
    """Index ranges of consecutive texts of about ``limit_bytes`` characters, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and held + n > limit_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def slices(batches, rows: int = 512):
    """Arrow batches as slices of few rows, so that a worker never holds the Python objects of a whole batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        release()


def release() -> None:
    """Give freed memory back to the system: Spark keeps a worker process for later tasks, which may be of another operator."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
