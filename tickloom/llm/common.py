"""What the operators of this subpackage share: shared-folder staging and the numpy word kernel."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the word rule ``[^\x20\x09-\x0D]+`` as a Java character class.
SPACE = r"[\x20\x09-\x0D]"

#: Bytes of text that the numpy kernels hold at once; a longer single text is held alone.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset (tests), below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tickloom-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of df through a table in the shared folder, so that lost executors cost no recomputation of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Deletes the tables of what `stage` returned, once nothing is to be read from them any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)


def released(kernel: Callable) -> Callable:
    """The kernel, giving what it has freed back to the system when its task ends: Python workers outlive their tasks."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def give_back(spark: SparkSession | None = None) -> None:
    """Gives what this process has freed back to the system; on the driver, with spark, what its JVM holds no more as well.

    The collection also lets Spark's cleaner drop broadcasts and shuffle files that no table needs any more.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)
    if spark is not None:
        gc.collect()
        _give_back_jvm(spark)


def _give_back_jvm(spark: SparkSession) -> str | None:
    """Collects the garbage of the driver's JVM, then returns what is free of its heap and of its native allocator.

    By itself a heap keeps more than twice its live objects after that, and the allocator, which serves hundreds of
    threads, all it once had. Other JVMs than HotSpot, and on the allocator those before 17.0.9, only collect. Returns
    what the JVM says of its allocator.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    beans = jvm.java.lang.management.ManagementFactory
    vm = ratio = None
    with contextlib.suppress(Py4JError, AttributeError):
        vm = beans.getPlatformMXBean(kind("com.sun.management.HotSpotDiagnosticMXBean"))
        ratio = vm.getVMOption("MaxHeapFreeRatio").getValue()
        vm.setVMOption("MaxHeapFreeRatio", vm.getVMOption("MinHeapFreeRatio").getValue())  # for this collection alone
    try:
        jvm.System.gc()
    finally:
        if ratio:
            vm.setVMOption("MaxHeapFreeRatio", ratio)
    with contextlib.suppress(Py4JError):
        types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(beans.getPlatformMBeanServer(), values)
    return None


def words(text) -> F.Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column, in order; of a null, none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda w: w != "")


# -- numpy kernel ---------------------------------------------------------------------------------------------------

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_VALUE_FOLDED = _VALUE.copy()
_VALUE_FOLDED[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        m = max(n, CHUNK + 1)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts of about limit bytes; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hashes(data: np.ndarray, values: np.ndarray = _VALUE) -> np.ndarray:
    """Prefix sums P of the polynomial hash: data[s:e] hashes to (P[e] - P[s]) * inverse ** s."""
    up, _ = _powers(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], dtype=np.uint64, out=p[1:])
    return p


def span_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _powers(len(p))
    return mix((p[end] - p[start]) * down[start])


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, text index) of each word of the texts in data; fold: A-Z as a-z."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ink = ~_WS[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edge = offsets[offsets < n]
    first[edge] = ink[edge]
    edge = offsets[offsets > 0] - 1
    last[edge] = ink[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    p = prefix_hashes(data, _VALUE_FOLDED if fold else _VALUE)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return start, end, span_hashes(p, start, end), owner


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its k-word shingles; hashes[bounds[i]:bounds[i+1]] are text i's words.

    A text of fewer than k words has its whole sequence as one shingle, a text without words has none.
    """
    n = len(hashes)
    grams = np.zeros(n, np.uint64)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j])
        grams[: n - k + 1] = acc
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            acc = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                acc = mix(acc * np.uint64(0xC2B2AE3D27D4EB4F) + h)
            out.append(acc)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text of the column, in order, the sorted distinct hashes of its k-word shingles, A-Z folded."""
    for i, j, data, offsets in text_chunks(column):
        _, _, hashes, owner = word_hashes(data, offsets, True)
        yield from shingle_hashes(hashes, np.searchsorted(owner, np.arange(j - i + 1)), k)
