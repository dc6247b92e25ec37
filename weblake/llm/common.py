"""Helpers shared by the training-data operators.

Conventions of the subpackage
-----------------------------
* A *word* is a run of characters other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).  ``bytes.split()``
  splits on exactly these six characters, so word work is done on UTF-8 bytes.
* Lower-casing touches A-Z only (``bytes.lower()``).
* A null text is treated as the empty text unless an operator says otherwise.
* Operators read the columns they name and ignore all others, so extra columns cannot clash with their own.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shipping

WORD = "[^\\x20\\x09-\\x0D]+"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, and sets what its operators need of a session where it has Spark's own values: how
    many rows and bytes an Arrow batch has."""
    shipping.ship(spark)
    # Texts are long, and a Python worker holds a batch several times over: with Spark's own limits (10,000 rows, 64 MB) that
    # takes hundreds of MB.
    for name, default, own in (("maxRecordsPerBatch", "10000", "3000"), ("maxBytesPerBatch", "67108864b", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where that is unset a session in one process (tests) gets a
    folder of its own, and any other an error."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if not found and not shipping.one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = found or tempfile.mkdtemp(prefix="weblake-")
        spark.sparkContext.setCheckpointDir(found)
    return found or jsc.getCheckpointDir().get()


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of the value's text, modulo ``modulus``; a null counts as -1, so it is never held out."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(-1))


def row_key(*columns: Column) -> Column:
    """128 bits that stand for a row's values: two hashes with seeds of their own."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def ahead(sums: DataFrame, by: list[str], bucket: str, value: str, group: int = 1000) -> DataFrame:
    """``sums`` (one row for each of ``by`` and ``bucket``) with ``ahead``: the sum of ``value`` in the buckets before.  Buckets are
    summed in groups first, so that no task has more than a thousandth of a key's buckets or ``group`` of them."""
    marked = sums.withColumn("_group", F.floor(F.col(bucket) / group))
    upper = marked.groupBy(*by, "_group").agg(F.sum(value).alias("_all"))
    upper = upper.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_group").alias("_of"), (F.sum("_all").over(Window.partitionBy(*by).orderBy("_group")) - F.col("_all")).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy(*by, "_group").orderBy(bucket)) - F.col(value)
    same = F.col("_group") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return marked.withColumn("_inner", inner).join(upper, same).withColumn("ahead", F.col("_before") + F.col("_inner")).select(*sums.columns, "ahead")


#: What clears the caches that operators keep in a Python worker between tasks.
_caches: dict[str, Callable[[], None]] = {}


def keep_cache(owner: str, clear: Callable[[], None]) -> None:
    _caches[owner] = clear


def release(owner: str = "") -> None:
    """Called as a task begins: workers are used again by later stages, so what other operators hold goes."""
    for name, clear in _caches.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()
    # numpy's freed arrays stay with the C library, worker by worker, unless it is asked.
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None


def tidy(task):
    """A function of a Python task (of batches, of a group, or of two groups) that gives back its memory when it is done."""

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    def group(table: pa.Table) -> pa.Table:
        try:
            return task(table)
        finally:
            release()

    def groups(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return task(left, right)
        finally:
            release()

    return {"batches": batches, "table": group, "left": groups}[task.__code__.co_varnames[0]]


def as_bytes(column: pa.Array, owner: str = "") -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as the empty text."""
    release(owner)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# --- vectorised hashing of words ------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]  # A-Z count as a-z
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_MUL = _rng.integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, np.uint64)
        found[0] = 1
        _powers[base] = found = np.cumprod(found, dtype=np.uint64)
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order (``fold``: A-Z count as a-z), the count of words of each
    text, and each word's length in code points."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    word = ~_SPACE[buf]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[buf] * _power(_STEP, n), out=total[1:])
    h = mix((total[e] - total[s]) * _power(_BACK, n + 1)[s])
    points = np.zeros(n + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    counts = np.diff(np.searchsorted(s, np.concatenate((begins, [n + 1]))))
    return h, counts, points[e] - points[s]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and counts of ``word_hashes`` for many texts, a block at a time to stay in the processor's cache."""
    parts = [word_hashes(texts[a:b])[:2] for a, b in blocks(map(len, texts))]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _MUL[0]
    for i in range(1, k):
        out = out + h[i : i + n] * _MUL[i]
    return mix(out + np.uint64(k))


def blocks(sizes, limit: int = 1 << 20):
    """Ranges of consecutive items whose sizes add up to about ``limit`` (a larger item stands alone)."""
    sizes = list(sizes)
    begin, total = 0, 0
    for i, x in enumerate(sizes):
        if total and total + x > limit:
            yield begin, i
            begin, total = i, 0
        total += x
    if begin < len(sizes):
        yield begin, len(sizes)
