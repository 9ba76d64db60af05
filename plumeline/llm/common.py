"""Pieces shared by the training-data operators: shared storage and byte-level array helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators split and normalise on: space, tab, LF, VT, FF and CR.
SPACES = r"[\x20\x09-\x0D]+"

#: Bytes of text that one numpy pass handles; it bounds a worker's memory, not what is processed.
CHUNK_BYTES = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on one machine may it be unset; a temporary one stands in."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = configured or tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: A driver's heap beyond this is collected before a table is cut; it bounds what is garbage, not what is processed.
HEAP_BYTES = 320_000_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in reliable shared storage and cut its lineage; before that, the driver gives back what it doesn't use."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryMXBean().getHeapMemoryUsage().getCommitted() > HEAP_BYTES:
        release(df.sparkSession)
    else:
        trim_driver(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a cut table that share a partition at least.
SMALL = 50_000


def cut_counted(df: DataFrame, **sums) -> tuple[DataFrame, dict[str, int]]:
    """cut, with the rows (n) and further sums counted in the same job; a small table gets few partitions."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(c) for c, x in sums.items()]))
    got = {c: int(x or 0) for c, x in seen.get.items()}
    return done.coalesce(got["n"] // SMALL + 1), got


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, Python's first.

    Only then does Spark delete the shuffle files, broadcasts and checkpoints of tables that nothing refers to
    any more, and the driver's heap shrinks to what is in use. For operators of many jobs, between their steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> None:
    """Have the driver's JVM return to the system what its allocator keeps outside the heap.

    Each exchange and each compiled method leaves freed pieces in the arenas of hundreds of threads, which count
    against the driver. The JVM has a command for it (System.trim_native_heap); where it lacks it, nothing happens.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    # by reflection on the interface: the server's own class isn't accessible
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = named(name)
    with contextlib.suppress(Py4JError):
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def to_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offsets of its rows (nulls count as empty)."""
    column = column.fill_null("") if column.null_count else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    lo, hi = int(at[0]), int(at[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, at - lo


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a row is never divided."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end
        start = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd 64-bit base and of its inverse modulo 2**64, for n units at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(10, n.bit_length())
        up = np.full(size, _ODD, dtype=np.uint64)
        down = np.full(size, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _POWERS[0]


def give_back() -> None:
    """Return what arrays took to the system: a large table of powers, and what the allocator keeps."""
    if _POWERS and len(_POWERS[0][0]) > 2 * CHUNK_BYTES:
        _POWERS.clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """run, a function over record batches, which at its end gives back the memory that its arrays took.

    Python workers live on from task to task and from stage to stage, and what the allocator keeps counts
    against their executor. Tasks receive give_back by its name, so that no table of this module goes with them.
    """

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


#: Bytes of an Arrow batch; one longer row is a batch of its own.
BATCH_BYTES = 4_000_000


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow of run, trimmed, in batches that are bounded in bytes.

    Spark alone counts a batch's rows, and 10,000 texts take tens of megabytes several times over, outside the
    heap of the executor as well as in its workers. The bound is a setting of the session; one set there already stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(trimmed(run), schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of units[start:end], all of them from one prefix sum."""
    up, down = _powers(len(units))
    prefix = np.zeros(len(units) + 1, dtype=np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[: len(units)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, split at white space, with A-Z in lower case.

    Returns starts and ends in raw, 64-bit hashes, and for each row the place of its first word (one more entry ends the last).
    """
    low = _LOWER[raw]
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


#: Bits of the membership filter, in rows of 32,768 bits: 512 rows of 4 KB, whatever the number of keys.
FILTER_BITS = 1 << 24
_ROW_BITS = 32_768


def membership(keys: DataFrame, key: str) -> DataFrame:
    """A one-hash filter of the keys (longs), of fixed size: filter_row and filter_bits."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return keys.select(at.alias("at")).groupBy((F.col("at") / _ROW_BITS).cast("int").alias("filter_row")).agg(F.bitmap_construct_agg(F.col("at") % _ROW_BITS).alias("filter_bits"))


def with_membership(df: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """df with maybe_in: false only where the key is certainly not among the filter's keys.

    It lets a join move only the rows that may match; the filter's size is fixed, so it is broadcast.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    marked = df.withColumn("filter_at", at).withColumn("filter_row", (F.col("filter_at") / _ROW_BITS).cast("int"))
    within = (F.col("filter_at") % _ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("filter_bits", (within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.when(F.col("filter_bits").isNull(), 0).otherwise(F.call_function("bit_get", byte, within % 8))
    joined = marked.join(F.broadcast(filter_), "filter_row", "left")
    return joined.withColumn("maybe_in", bit == 1).drop("filter_row", "filter_at", "filter_bits")
