"""What the operators of this subpackage share: row-wise maps over Arrow batches, places for intermediate tables, hashing.

Text conventions used by every operator here: a null text counts as the empty text, words are maximal
runs of bytes other than the six ASCII white-space characters, nothing is normalised unless the
operator says so, and columns that the operator does not know are ignored.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows are handed on in batches of about so many bytes of text.
BATCH_BYTES = 2 << 20

MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x + GOLDEN).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so Arrow batches get fewer rows and bytes than Spark's defaults, unless the session says otherwise."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_text(
    df: DataFrame, text_col: str, out: T.StructType, make: Callable[[], Callable[..., tuple]], carry: list[str], more: list[str] = (), whole: bool = False, limit: int = BATCH_BYTES
) -> DataFrame:
    """One row ``(carry struct, out struct)`` for each row of ``df``; ``make()`` runs once in each task and gives the function of a text
    and of the columns ``more``, or if ``whole`` of lists of these, to a list of tuples.

    ``carry`` columns travel through unchanged, so their names can't clash with those of ``out``.
    """
    small_batches(df.sparkSession)
    # A text that travels along anyway isn't sent twice.
    at = carry.index(text_col) if text_col in carry and df.schema[text_col].dataType == T.StringType() else None
    view = df.select(
        F.struct(*[F.col(quoted(c)) for c in carry]).alias("carry"),
        *([] if at is not None else [F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text")]),
        *[F.col(quoted(c)).alias(f"more{i}") for i, c in enumerate(more)],
    )
    schema = T.StructType([view.schema["carry"], T.StructField("out", out)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for big in batches:
            if at is not None:
                columns = [big.column(0), big.column(0).flatten()[at], *big.columns[1:]]
                big = pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])
            for batch in slices(big, 1, limit) if big.num_rows else ():
                given = [[t or "" for t in batch.column(1).to_pylist()], *(c.to_pylist() for c in batch.columns[2:])]
                rows = fn(*given) if whole else [fn(*x) for x in zip(*given)]
                cols = list(zip(*rows)) if rows else [[] for _ in arrow]
                made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], fields=list(arrow))
                yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["carry", "out"])

    return view.mapInArrow(run, schema)


def kept(make: Callable, *args):
    """What ``make(*args)`` gave before in this worker process, or gives now: a vocabulary and its memory outlive a
    task. Only one is kept."""
    held = sys.__dict__.setdefault("_quire_kept", {})
    key = (make.__qualname__, args)
    if key not in held:
        forget()
        held[key] = make(*args)
    return held[key]


def forget() -> None:
    """Frees what is kept, for tasks that need the room, and hands it back to the system where that can be done."""
    if held := sys.__dict__.get("_quire_kept"):
        held.clear()
        pa.default_memory_pool().release_unused()
        if hasattr(library := ctypes.CDLL(None), "malloc_trim"):
            library.malloc_trim(0)


def slices(batch: pa.RecordBatch, text_at: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    sizes = np.diff(np.frombuffer(batch.column(text_at).buffers()[1], dtype=offset_type(batch.column(text_at)))[batch.column(text_at).offset :][: batch.num_rows + 1])
    began = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(began, i - began)
            began, held = i, 0
        held += n
    if began < batch.num_rows:
        yield batch.slice(began)


def offset_type(a: pa.Array) -> np.dtype:
    return np.dtype(np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32)


def flat(mapped: DataFrame) -> DataFrame:
    return mapped.select("carry.*", "out.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a session on one machine, as in tests, gets a
    temporary one; a cluster is refused, as its executors would write to disks of their own."""
    context = spark.sparkContext
    now = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not now:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        now = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, now, True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(now)
    return now


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at.getParent())
    system.deleteOnExit(at)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that nothing before it runs twice and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = new_folder(spark, "quire")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
