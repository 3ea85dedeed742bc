"""Helpers shared by the training-data operators: shared scratch space, checkpoints and word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every word count and word shingle here.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Up to so many rows of one or two longs are broadcast (8 or 16 MB).
BROADCAST_ROWS = 1_000_000
#: Most bytes of a batch for a Python worker (a single longer row is a batch), unless the session names a bound:
#: Spark's own lets ten thousand whole texts make one of 64 MB, which JVM and worker hold several times.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where a session on one machine names none, as in tests, a temporary
    folder is made and set as the checkpoint folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if root:
            root = root.rsplit("/", 1)[0]
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="skilltide-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh URI under the shared folder."""
    return f"{shared_root(spark)}/skilltide/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bounded(frame: DataFrame) -> DataFrame:
    """``frame``, whose session sends batches of at most ``BATCH_BYTES`` to Python workers from now on."""
    conf = frame.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return frame


def released(run: Run) -> Run:
    """``run``, after which the worker gives freed memory back: workers serve many tasks and would keep the most they held."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return wrapped


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle and checkpoint files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a frame made by :func:`written`, once nothing reads them any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(ids: DataFrame) -> DataFrame:
    """``ids`` (one or two longs a row), marked for broadcast if a count shows that they are few; else they are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def looked_up(rows: DataFrame, found: DataFrame, key: str, salt: list[str], hot: int = 10_000) -> DataFrame:
    """``rows`` left-joined to ``found``: one row a key, its column ``n`` counts the rows that have the key.

    Keys of more than ``hot`` rows are broadcast, at most one for every ``hot`` rows of the table. Rows that found theirs
    there, and rows with a null key, are dealt by a hash of ``salt``: no task gets all rows of a hot key.
    """
    fields = [c for c in found.columns if c not in (key, "n")]
    packed = found.select(F.col(key).alias("_key"), "n", F.struct(*fields).alias("_found"))
    many = packed.where(F.col("n") > hot).select("_key", F.col("_found").alias("_many"))
    rest = packed.where(F.col("n") <= hot).select("_key", F.col("_found").alias("_few"))
    kind = rows.schema[key].dataType
    out = rows.join(F.broadcast(many), F.col(key) == F.col("_key"), "left").drop("_key")
    out = out.withColumn("_done", F.col("_many").isNotNull() | F.col(key).isNull())
    out = out.withColumn("_look", F.when(F.col("_done"), F.xxhash64(*salt).cast("string").cast(kind)).otherwise(F.col(key)))
    out = out.join(rest, (F.col("_look") == F.col("_key")) & ~F.col("_done"), "left")
    return out.select(*rows.columns, *(F.coalesce(f"_many.{c}", f"_few.{c}").alias(c) for c in fields))


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or the same with underscores before it if the input already has such a column."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
