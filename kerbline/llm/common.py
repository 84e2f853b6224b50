"""Shared plumbing: the cluster's shared folder, files written by tasks, words, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Rows that Spark hands to Python at once, where the session keeps its default: texts are long.
ARROW_ROWS = 1000
_ARROW, _FREED = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and all run on one machine (tests)."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='kerbline-')}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table under path: cuts the lineage, and survives the loss of executors."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is executed here leaves no shuffle files once it has ended."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python ARROW_ROWS at a time, unless it was told a number."""
    if spark.conf.get(_ARROW) == "10000":
        spark.conf.set(_ARROW, str(ARROW_ROWS))


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of docs, for operators that read texts in Python."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate files once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_system(uri: str):
    """(file system, path) of a URI, for code that runs in tasks; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put_file(uri: str, chunks) -> int:
    """Writes chunks of bytes under another name, then renames: a task that runs twice leaves one whole file."""
    files, path = file_system(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with files.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(part, path)
    return size


def map_file(uri: str, dtype, n: int, offset: int = 0) -> np.ndarray:
    """n values of a shared file, memory-mapped where the file system is local, else read."""
    if not n:
        return np.zeros(0, dtype)
    files, path = file_system(uri)
    if files.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r", offset=offset, shape=(n,))
    with files.open_input_file(path) as f:
        f.seek(offset)
        return np.frombuffer(f.read(n * np.dtype(dtype).itemsize), dtype)


def by_size(df: DataFrame, times: int = 1) -> int:
    """How often 32 MB go into times as many bytes as df has, once at least and 20,000 times at most."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:  # Spark's word for unknown
        size = 0
    return max(min(size * times >> 25, 20_000), 1)


def shards(df: DataFrame, times: int = 1) -> int:
    """Into how many parts times as many bytes as df has are dealt: grows with the input, never below the session's setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_size(df, times))


def binaries(batch: pa.RecordBatch, k: int) -> list:
    """Column k, strings as their UTF-8 bytes (null: None)."""
    return batch.column(k).cast(pa.large_binary() if pa.types.is_large_string(batch.schema.field(k).type) else pa.binary()).to_pylist()


def kept(name: str, make):
    """What a worker process keeps under name between its tasks; made where it isn't there."""
    held = sys.modules.setdefault("_kerbline_kept", types.ModuleType("_kerbline_kept")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def released() -> None:
    """Frees what earlier tasks of another operator kept in this worker."""
    sys.modules.pop("_kerbline_kept", None)
    trimmed()


def trimmed() -> None:
    """Gives a worker's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return text.lower().split() if text else []


def in_pieces(batches: Iterator[pa.RecordBatch], budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about budget bytes, one row at least: bounds what a task holds."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(n, int(budget * n / max(1, batch.nbytes))))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (node, smallest node) of the components that an array of pairs forms."""
    nodes, where = np.unique(pairs, return_inverse=True)
    where, up = where.reshape(-1, 2), np.arange(len(nodes))
    while True:
        low = np.minimum(up[where[:, 0]], up[where[:, 1]])
        new = up.copy()
        for side in (0, 1):
            np.minimum.at(new, where[:, side], low)
            np.minimum.at(new, up[where[:, side]], low)
        new = new[new]
        if (new == up).all():
            break
        up = new
    keep = up != np.arange(len(nodes))
    return np.stack([nodes[keep], nodes[up[keep]]], axis=1)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    schema = pa.schema([("v", pa.int64()), ("u", pa.int64())])

    def out():
        tree = forest(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(tree[:, 0]), pa.array(tree[:, 1])], schema=schema)

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
            size += batch.num_rows
        if size > 500_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) with component the smallest node reachable, for nodes that are not the smallest themselves.

    edges: two columns of non-null longs. Each task first thins its own edges to a forest; then large-star and
    small-star rounds, each written to the shared folder. A round aggregates minima before it shuffles and joins
    them back, so a node with very many links is a skewed join that Spark splits, and never one task's list.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    now = written(edges.where(F.col(a) != F.col(b)).select(a, b).mapInArrow(_thin, "v long, u long").distinct(), scratch(spark, f"{name}-edges"))
    before = None
    while True:
        both = now.select(F.col("v").alias("n"), F.col("u").alias("m")).unionByName(now.select(F.col("u").alias("n"), F.col("v").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("l")).select("n", F.least("n", "l").alias("low"))
        large = both.join(low, "n").where("m > n and m <> low").select(F.col("m").alias("v"), F.col("low").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").where("u <> low").select(F.col("u").alias("v"), F.col("low").alias("u"))
        now = written(small.unionByName(low.select("v", F.col("low").alias("u"))).distinct(), scratch(spark, f"{name}-round"))
        stats = tuple(now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first())
        if stats == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = stats
