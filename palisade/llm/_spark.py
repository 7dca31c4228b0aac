"""Session helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch sent to Python: whole texts, so few rows; a larger text is a batch of its own.
ARROW_ROWS = 1024
ARROW_BYTES = 16 << 20
#: A task returns unused memory after a batch if it hasn't for so long.
GIVE_BACK_SECONDS = 1.0


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure there is a checkpoint folder.

    The folder is the shared one the cluster names in spark.checkpoint.dir; where
    that is unset a local folder serves a local master, and a cluster is refused.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="palisade-ckpt-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    That cuts lineage, survives lost executors, keeps columns prunable and gives
    later joins true sizes.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing still to run reads."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What this worker remembers, of one kind at a time.
_kept: dict[str, object] = {}


def kept(kind: str, make: Callable[[], object]) -> object:
    """What a worker keeps for the next tasks of its kind: made once, and dropped when a ``lean`` task of another kind begins."""
    if kind not in _kept:
        _kept[kind] = make()
    return _kept[kind]


def forget(kind: str) -> None:
    """Drop what was kept for tasks of other kinds."""
    for other in [k for k in _kept if k != kind]:
        del _kept[other]


def give_back() -> None:
    """Return to the system what Arrow's pool and the C library hold but don't use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable, kind: str = "") -> Callable:
    """A function for mapInArrow that leaves little in its worker.

    Spark uses workers again for the tasks of later stages, so what one operator
    remembers or holds in free lists would count against all that follow.
    """

    def task(batches):
        forget(kind)
        last = time.monotonic()
        try:
            for batch in run(batches):
                yield batch
                if time.monotonic() - last > GIVE_BACK_SECONDS:
                    give_back()
                    last = time.monotonic()
        finally:
            give_back()

    return task


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let a function of documents work under plain column names, whatever theirs are; its rows carry theirs again.

    Columns that the function adds give way to those that the documents have.
    """

    @wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        plain = {c if c in ("doc_id", "text", "n_chars") else f"column_{i}": c for i, c in enumerate(docs.columns)}
        out = stage(docs.toDF(*plain), *args, **options)
        added = dict(zip([c for c in out.columns if c not in plain], fresh(docs, *(c for c in out.columns if c not in plain)), strict=True))
        return out.toDF(*(plain.get(c) or added[c] for c in out.columns))

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_sha() -> str:
    return hashlib.sha256(b"").hexdigest()


def unsigned_crc(x: Column) -> Column:
    return F.crc32(x.cast("binary"))
