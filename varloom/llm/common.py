"""What the corpus operators share: shared-folder tables, size-checked joins, byte-level word kernels."""

from __future__ import annotations

import atexit
import ctypes
import gc
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (ids, hashes) that may be broadcast: about 32 MB at 32 bytes a row.
BROADCAST_ROWS = 1_000_000
#: Bytes of its files beyond which a lookup table isn't broadcast, however few its rows.
BROADCAST_BYTES = 32 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


# shared folder
def shared_root(spark: SparkSession) -> str:
    """Folder that every executor sees: spark.checkpoint.dir; a temporary one only on a local master where it is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="varloom-ckpt-")
        sc.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return str(root).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/varloom-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hp)
    return path


def local_path(path: str) -> str:
    """The mounted form of a file: URI (Python workers open shared files themselves)."""
    return path[5:] if path.startswith("file:/") and not path.startswith("file://") else path.removeprefix("file://")


def drop_path(spark: SparkSession, path: str) -> None:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._varloom_path = path
    return out


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes on disk of a materialised table, read back whole; None for others."""
    path = getattr(df, "_varloom_path", None)
    if path is None:
        return None
    hp = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hp).getLength()


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, salt: Column | None = None, salts: int = 16, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a wide table with a narrow lookup table.

    The lookup is counted first, and a materialised one also measured. Up to ``max_rows`` rows and ``max_bytes`` of
    (compressed) files it is broadcast; beyond, both sides are shuffled, and with ``salt`` given the lookup is
    repeated over the salts so a hot key is split.
    """
    n = small.count()
    if n <= max_rows and (stored_bytes(small) or 0) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    if salt is None or how not in ("left", "inner", "left_anti", "left_semi"):
        return big.join(small, on, how)
    b = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*on, "_salt"], how).drop("_salt")


def within(sample: DataFrame, max_bytes: int) -> DataFrame:
    """At most about ``max_bytes`` of the distinct rows (doc_id, text, ...), by a hash of both: an id with many texts is cut too."""
    size = sample.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    grain = 1 << 30
    return sample if size <= max_bytes else sample.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(12)), F.lit(grain)) < int(grain * max_bytes / size))


def fit_in_task(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """Fit a model on a bounded sample inside one task, so that neither its rows nor its arrays burden the driver.

    ``fit`` gets the rows as tuples (strings as UTF-8 bytes), ordered by all their columns; Arrow's copy of
    them is given back before it runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows += zip(*[(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in b.columns], strict=True)
        b = None
        pa.default_memory_pool().release_unused()
        rows.sort()
        model = fit(rows) if rows else None
        rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = [r for r in sample.repartition(1).mapInArrow(frugal(run), "model binary").collect()]
    models = [m for m in (pickle.loads(bytes(r[0])) for r in got) if m is not None]
    return models[0] if models else None


# columns
def crc_fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


# Arrow batches
def trim() -> None:
    """Give freed memory back to the system: workers are reused, and would hold it beside the next task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A ``mapInArrow`` function that trims its worker's memory when its partition ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def text_rows(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (n + 1) of a string array; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32, count=n + 1, offset=arr.offset * (8 if wide else 4)).astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def row_chunks(offs: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text; a longer single text is a range of its own."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def lut(word: np.ndarray, lower: bool = True) -> np.ndarray:
    """Byte table: 0 for separators, else the byte (A-Z lower-cased)."""
    t = np.where(word, np.arange(256), 0).astype(np.uint8)
    if lower:
        up = np.arange(65, 91)
        t[up] = np.where(word[up], up + 32, 0)
    return t


def spans(cls: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of non-zero bytes; runs end with their row."""
    n = len(cls)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = cls != 0
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    first = offs[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    last = offs[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def cuts(word: np.ndarray, data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that cover a text and end at separators (``word`` tells word bytes); a longer word stays whole."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + size, n)
        if b < n:
            gap = np.flatnonzero(~word[data[a:b]])
            if len(gap):
                b = a + int(gap[-1]) + 1
            else:
                while b < n and word[data[b]]:
                    more = np.flatnonzero(~word[data[b : b + size]])
                    b = b + int(more[0]) if len(more) else min(b + size, n)
        yield a, b
        a = b


_R = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 20
_POW: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse over one window: 16 MB, whatever the texts."""
    if not _POW:
        for base in (_R, pow(_R, -1, 1 << 64)):
            t = np.full(_SPAN + 1, base, np.uint64)
            t[0] = 1
            _POW.append(np.multiply.accumulate(t))
    return _POW


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def run_hashes(cls: np.ndarray, starts: np.ndarray, ends: np.ndarray, *shorter: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of ascending byte ranges, equal for equal bytes anywhere, by prefix sums over windows of bounded length.

    Each of ``shorter`` gives other ends, none beyond ``ends``, for further hashes from the same starts.
    """
    p, q = _powers()
    stops = [ends, *shorter]
    out = [np.empty(len(starts), np.uint64) for _ in stops]
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + _SPAN, side="right"))
        if j > i:
            c = cls[lo : int(ends[j - 1])]
            total = np.zeros(len(c) + 1, np.uint64)
            np.cumsum((c.astype(np.uint64) + np.uint64(1)) * p[: len(c)], out=total[1:])
            a = starts[i:j] - lo
            for o, e in zip(out, stops, strict=True):
                o[i:j] = (total[e[i:j] - lo] - total[a]) * q[a]
        else:  # one range longer than a window, piece by piece
            j = i + 1
            for o, e in zip(out, stops, strict=True):
                h = 0
                for at in range(lo, int(e[i]), _SPAN):
                    c = cls[at : min(at + _SPAN, int(e[i]))].astype(np.uint64) + np.uint64(1)
                    h += int((c * p[: len(c)]).sum(dtype=np.uint64)) * pow(_R, at - lo, 1 << 64)
                o[i] = h & ((1 << 64) - 1)
        i = j
    return [mix64(o ^ ((e - starts).astype(np.uint64) << np.uint64(56))) for o, e in zip(out, stops, strict=True)]
