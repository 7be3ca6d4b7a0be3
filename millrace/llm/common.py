"""Shared storage, Arrow row streams, word hashing and connected components for the text operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_GAPS = b" \t\n\x0b\x0c\r"
#: Rows handed to Python code at a time, so that very long texts never fill a worker.
SLICE_ROWS = 256
BATCH_ROWS = 1024

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a temporary one serves local sessions alone."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/millrace-{sc.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() once nothing reads it any more."""
    path = df._millrace_path
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath.getParent(), True)
    _written.remove(path)


def sweep(spark: SparkSession) -> None:
    """Delete every table that materialize() wrote and that is still there; results read from them are lost."""
    for path in list(_written):
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath.getParent(), True)
        _written.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished stages: it acts when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over bounded slices of the input batches.

    Where the session has Spark's default of 10,000 rows a batch it gets BATCH_ROWS: batches of whole texts would
    fill JVM and Python worker otherwise.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        yield from fn(slices(batches))

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as UTF-8, without a detour over str; null stays None."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base % (1 << 64)
    return out


_POWERS = _powers(0x9E3779B97F4A7C15, 256)
_OTHER_POWERS = _powers(0xD1342543DE82EF95, 256)


def window_hashes(h: np.ndarray, width: int, other: bool = False) -> np.ndarray:
    """63-bit hashes (as int64) of every run of `width` consecutive word hashes; empty if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    powers = _OTHER_POWERS if other else _POWERS
    out = h[:n] * powers[0]
    for k in range(1, width):
        out += h[k : k + n] * powers[k]
    return (mix64(out) >> np.uint64(1)).astype(np.int64)


FILTER_BITS = 26
SALTS = 64
_FILTER_BLOCK = 1 << 17  # bytes


def _filter_places(ids: np.ndarray) -> list[np.ndarray]:
    h = ids.astype(np.int64).view(np.uint64)
    return [(mix64(h * np.uint64(2) + np.uint64(k)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for k in range(3)]


def _filter_rows(batches: Iterator[pa.RecordBatch]):
    bits = np.zeros(1 << FILTER_BITS, bool)
    for b in batches:
        for at in _filter_places(b.column(0).drop_null().to_numpy()):
            bits[at] = True
    packed = np.packbits(bits)
    for k in range(0, len(packed), _FILTER_BLOCK):
        if packed[k : k + _FILTER_BLOCK].any():
            yield pa.record_batch([pa.array([k // _FILTER_BLOCK], pa.int32()), pa.array([salt()], pa.int32()), pa.array([packed[k : k + _FILTER_BLOCK].tobytes()], pa.binary())], ["block", "salt", "bits"])


def _join_filters(table: pa.Table) -> pa.Table:
    out = np.zeros(_FILTER_BLOCK, np.uint8)
    for x in table["bits"]:
        out |= np.frombuffer(x.as_buffer(), np.uint8)
    return pa.table({"block": table["block"][:1], "bits": pa.array([out.tobytes()], pa.binary())})


def salt() -> int:
    """A number of the task, by which blocks that every task makes are first merged in SALTS groups."""
    task = TaskContext.get()
    return task.partitionId() % SALTS if task else 0


def merged(rows: DataFrame, join: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows (block, salt, data) merged by block in two steps, so that no task gets all tasks' rows of a block."""
    return rows.groupBy("block", "salt").applyInArrow(join, schema).groupBy("block").applyInArrow(join, schema)


def id_filter(ids: DataFrame):
    """A broadcast Bloom filter of a column of ids, 8 MB at every size of the input; if it fills up, more ids pass and results stay the same."""
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in merged(map_arrow(ids, _filter_rows, "block int, salt int, bits binary"), _join_filters, "block int, bits binary").collect():
        out[r["block"] * _FILTER_BLOCK : (r["block"] + 1) * _FILTER_BLOCK] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out)


def passes(ids: pa.Array, shared) -> np.ndarray:
    """Which ids the filter lets pass; a null id does not pass."""
    bits = shared.value
    ok = ~ids.is_null().to_numpy(zero_copy_only=False)
    for p in _filter_places(ids.fill_null(0).to_numpy()):
        ok &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def passing(df: DataFrame, id_col: str, shared) -> DataFrame:
    """Rows whose id passes the filter."""
    at = df.columns.index(id_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(passes(b.column(at), shared)))

    return map_arrow(df, run, df.schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph edges(a, b) as (id, component_id), the smallest id of each.

    Alternating large-star and small-star rounds: every round is a grouped minimum and a join, so it needs
    logarithmically many rounds and moves no more rows than there are edges. Rounds end with checkpoint(); ids
    that have no edge to another id are not in the result. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()

    def mark(d: DataFrame):
        return tuple(d.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    last = mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = small.checkpoint()
        now = mark(new)
        e = new
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()
