"""Quality selection by importance resampling over hashed n-grams.

Texts are split into words and runs of punctuation (case kept); unigrams and bigrams are hashed into
``BUCKETS`` buckets. Two generative models are bucket frequencies with add-one smoothing: the raw model
over every document, and the target model over a sample of rows labelled good (``max_target`` rows by id
hash). A document's log importance is the log likelihood ratio of its n-grams, target over raw, summed, times
``temper`` (1: importance resampling proper; less flattens it); Gumbel noise drawn from a hash of its id is added
and the ``k`` largest keys are taken, which samples without replacement in proportion to the importance. ``k`` is
the good share of labelled rows plus ``margin``.

The k-th largest key is found exactly by counting keys in ever finer ranges, so no task sorts or
holds all keys. Both passes read whole texts, a long one a megabyte at a time; only bucket counts (bounded) reach
the driver.

Edge cases: a text without n-grams (null or blank) has importance minus infinity and is only taken when nothing
else is left, then by its noise; among rows with one key (repeated rows, and blank ones without an id) as many as are
wanted are taken, in the order of the table; ids of any type; with no good labels the target is the raw model, and
the sample is uniform; empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import cuts, frugal, materialize, row_chunks, run_hashes, text_rows
from varloom.session import ship

BUCKETS = 1 << 14
CHUNK = 1 << 20
_CLASS = np.full(256, 2, np.uint8)  # 2 punctuation
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x5F] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0


def ngrams(data: np.ndarray, offs: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every unigram and bigram; ``before`` has the hash of the word before the data, and gets that of its last."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    c = _CLASS[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    change[1:n] = c[1:] != c[:-1]
    change[offs] = True
    cut = np.flatnonzero(change)
    starts, ends = cut[:-1], cut[1:]
    word = c[starts] != 0
    starts, ends = starts[word], ends[word]
    row = np.searchsorted(offs, starts, side="right") - 1
    h = run_hashes(data, starts, ends)[0]
    both, of = h, row
    if before is not None:
        both, of = np.concatenate([before, h]), np.concatenate([np.zeros(len(before), row.dtype), row])
    two = both[:-1] * np.uint64(0x9E3779B97F4A7C15) + both[1:]
    two = two ^ (two >> np.uint64(29))
    ok = of[1:] == of[:-1]
    b = np.concatenate([h, two[ok]]) & np.uint64(BUCKETS - 1)
    return b.astype(np.int64), np.concatenate([row, of[1:][ok]])


def _chunks(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets, rows) of all n-grams of a batch in bounded parts; a long text is several."""
    for lo, hi in row_chunks(offs, CHUNK):
        part = data[offs[lo] : offs[hi]]
        if hi - lo == 1 and len(part) > CHUNK:
            before = np.zeros(0, np.uint64)
            for a, b in cuts(_CLASS != 0, part, CHUNK):
                g, row = ngrams(part[a:b], np.array([0, b - a]), before)
                yield lo, hi, g, row
                last = part[a:b]
                end = len(last) - int((_CLASS[last[::-1]] != 0).argmax()) if (_CLASS[last] != 0).any() else 0
                if end:
                    kind = _CLASS[last[end - 1]]
                    other = np.flatnonzero(_CLASS[last[:end]] != kind)
                    start = int(other[-1]) + 1 if len(other) else 0
                    before = run_hashes(last, np.array([start]), np.array([end]))[0]
        else:
            yield lo, hi, *ngrams(part, offs[lo : hi + 1] - offs[lo])


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            data, offs = text_rows(b.column(0))
            for _, _, g, _ in _chunks(data, offs):
                total += np.bincount(g, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    got = docs.select(text_col).mapInArrow(frugal(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        target = raw
    p, q = target + 1.0, raw + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", temper: float = 1.0) -> DataFrame:
    """doc_id, n_grams, importance (its logarithm, tempered) of every document."""
    ship(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_rows(b.column(1))
            n, s = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1)
            for lo, hi, g, row in _chunks(data, offs):
                n[lo:hi] += np.bincount(row, minlength=hi - lo)
                s[lo:hi] += np.bincount(row, weights=table.value[g], minlength=hi - lo)
            imp = np.where(n > 0, temper * s, -np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(imp)], ["doc_id", "n_grams", "importance"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_grams long, importance double")


def gumbel(seed: int):
    """Gumbel noise from a hash of doc_id: 52 bits as a uniform in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_key(keys: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest finite ``key`` (1 <= k <= rows), and how many keys are larger."""
    lo, hi, above = *keys.agg(F.min("key"), F.max("key")).first(), 0
    while lo < hi:
        width = (hi - lo) / 4096
        cell = F.least(F.floor((F.col("key") - lo) / width), F.lit(4095)).cast("int")
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        got = inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("lo")).collect()  # at most 4,096 rows
        for r in got:
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
    return lo, above


def first_rows(rows: DataFrame, k: int) -> int:
    """The ``place`` of the k-th row in the order of the table; places are (partition, number) in one long."""
    part = F.shiftright("place", 33)
    for r in sorted(rows.groupBy(part.alias("p")).count().collect()):  # a row a partition
        if r["count"] >= k:
            return rows.where(part == r.p).select("place").orderBy("place").limit(k).agg(F.max("place")).first()[0]
        k -= r["count"]
    raise ValueError("fewer rows than asked for")


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """Adds ``selected``: the k rows with the largest ``key`` (finite), of rows with one key the first in the table.

    ``rows`` is a materialised table whose column ``place`` is ``monotonically_increasing_id``.
    """
    n = rows.count()
    if k >= n or k <= 0:
        return rows.withColumn("selected", F.lit(k > 0))
    key, above = kth_key(rows, k)
    tie = rows.where(F.col("key") == key)
    last = first_rows(tie, k - above) if tie.count() > k - above else (1 << 63) - 1
    return rows.withColumn("selected", (F.col("key") > key) | ((F.col("key") == key) & (F.col("place") <= last)))


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, margin: float = 0.03, temper: float = 1.0, seed: int = 17, max_target: int = 50_000) -> DataFrame:
    """doc_id, n_grams, importance, key, selected of every document."""
    lab = labels.where("quality in (0, 1) and doc_id is not null")
    good, seen = lab.agg(F.count_if(F.col("quality") == 1), F.count(F.lit(1))).first()
    grain = 1 << 30
    cut = grain if good <= max_target else int(grain * max_target / good)
    ids = lab.where((F.col("quality") == 1) & (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(19)), F.lit(grain)) < cut)).select("doc_id").distinct()
    target = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    ratio = log_ratio(bucket_counts(target, "text"), bucket_counts(docs, text_col))
    noise = gumbel(seed)
    rows = weigh(docs, ratio, id_col, text_col, temper).withColumn("key", F.when(F.col("n_grams") > 0, F.col("importance") + noise).otherwise(noise))
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "quality-keys")
    if share is None:
        share = min(1.0, good / seen + margin) if seen else 1.0
    k = int(rows.count() * share + 0.5)
    some = rows.where("n_grams > 0")
    n = some.count()
    # blank texts come after all others, by their noise alone
    out = top_k(some, min(k, n)).unionByName(top_k(rows.where("n_grams = 0"), k - min(k, n)))
    return out.select("doc_id", "n_grams", "importance", F.when(F.col("n_grams") > 0, F.col("key")).otherwise(float("-inf")).alias("key"), "selected")
