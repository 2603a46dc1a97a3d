"""The packed genotype file: one file a chromosome, read and written through Spark.

Layout (little-endian): a 256-byte header (8-byte magic, version, encoding, samples, variants, bytes a
variant, offsets of statistics, data and gidx, flags), three float32 arrays (mu_x, sxx, maf), an optional int64
gidx array, and fixed-size variant records. Readers follow the offsets. Any 8-byte magic can be asked for, so
files of other writers with this layout can be read and written.

``spark.read.format("gtpack")`` splits a file into ranges of variants; options: ``path`` (a file or a folder of
``chr<N>.*`` files), ``stats_only`` (no genotype bytes are read), ``start``, ``end`` and ``rows_per_split``.
"""

from __future__ import annotations

import glob
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan, WriterCommitMessage

from varloom.functions.codec import MISSING, codes_of, counts, pack, stats_of_counts, unpack, variant_stats, width

MAGIC = b"VARLPK01"
VERSION = 1
HEADER = 256
SUFFIX = ".gtpack"
BIT2, U8, F16, F32 = range(4)
HAS_MISSING, HAS_GIDX = 1, 2
_BYTES = {BIT2: width, U8: lambda n: n, F16: lambda n: 2 * n, F32: lambda n: 4 * n}
_HEAD = struct.Struct("<8sIIQQQQQQI")


@dataclass(frozen=True)
class Header:
    magic: bytes
    version: int
    encoding: int
    n_samples: int
    n_variants: int
    bytes_per_variant: int
    stats_offset: int
    data_offset: int
    gidx_offset: int
    flags: int
    size: int

    @property
    def has_missing(self) -> bool:
        return bool(self.flags & HAS_MISSING)

    @property
    def has_gidx(self) -> bool:
        return bool(self.flags & HAS_GIDX)


def read_header(path: str, magic: bytes | None = None) -> Header:
    """The header; no data is read. ``magic`` is checked when given."""
    with open(path, "rb") as f:
        raw = f.read(HEADER)
    if len(raw) < HEADER:
        raise ValueError(f"{path}: too short for a header")
    h = Header(*_HEAD.unpack_from(raw), os.path.getsize(path))
    if magic is not None and h.magic != magic:
        raise ValueError(f"{path}: magic {h.magic!r}, expected {magic!r}")
    return h


def info(path: str) -> dict:
    h = read_header(path)
    return {"path": path, "version": h.version, "encoding": h.encoding, "n_samples": h.n_samples, "n_variants": h.n_variants, "bytes_per_variant": h.bytes_per_variant, "has_missing": h.has_missing, "has_gidx": h.has_gidx, "size": h.size}


def validate(path: str, magic: bytes | None = None) -> dict:
    """Structural problems of a file; a bad format is reported, not raised."""
    bad: list[str] = []
    try:
        h = read_header(path)
    except (OSError, ValueError) as e:
        return {"path": path, "ok": False, "problems": [str(e)]}
    if h.magic != (magic or MAGIC):
        bad.append(f"magic {h.magic!r}")
    if h.version != VERSION:
        bad.append(f"version {h.version}")
    if h.encoding not in _BYTES:
        bad.append(f"encoding {h.encoding}")
    elif h.bytes_per_variant != _BYTES[h.encoding](h.n_samples):
        bad.append(f"bytes per variant {h.bytes_per_variant}, expected {_BYTES[h.encoding](h.n_samples)}")
    parts = [("header", 0, HEADER), ("stats", h.stats_offset, 12 * h.n_variants), ("data", h.data_offset, h.n_variants * h.bytes_per_variant)]
    if h.has_gidx:
        parts.append(("gidx", h.gidx_offset, 8 * h.n_variants))
    for name, at, size in parts:
        if at + size > h.size:
            bad.append(f"{name} ends at {at + size}, the file at {h.size}")
    parts.sort(key=lambda p: p[1])
    for (n1, a, s), (n2, b, _) in zip(parts, parts[1:], strict=False):
        if a + s > b:
            bad.append(f"{n1} overlaps {n2}")
    return {"path": path, "ok": not bad, "problems": bad, "n_samples": h.n_samples, "n_variants": h.n_variants}


class Reader:
    """One file by ranges or by index lists. Statistics and gidx are mapped, records are read when asked for."""

    def __init__(self, path: str, magic: bytes | None = None):
        self.header = h = read_header(path, magic)
        self.map = np.memmap(path, np.uint8, "r")
        f = lambda k: np.frombuffer(self.map, np.float32, h.n_variants, h.stats_offset + 4 * k * h.n_variants)
        self.mu_x, self.sxx, self.maf = f(0), f(1), f(2)
        self.gidx = np.frombuffer(self.map, np.int64, h.n_variants, h.gidx_offset) if h.has_gidx else np.arange(h.n_variants)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        del self.map

    def __len__(self) -> int:
        return self.header.n_variants

    @property
    def shape(self) -> tuple[int, int]:
        return self.header.n_samples, self.header.n_variants

    def stats(self, start: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = slice(start, end)
        return self.mu_x[s], self.sxx[s], self.maf[s]

    def raw(self, start: int, end: int) -> np.ndarray:
        h = self.header
        a = h.data_offset + start * h.bytes_per_variant
        return np.asarray(self.map[a : a + (end - start) * h.bytes_per_variant]).reshape(end - start, h.bytes_per_variant)

    def decode(self, raw: np.ndarray) -> np.ndarray:
        """Dosages (variants, samples), NaN where missing, in any encoding."""
        h = self.header
        if h.encoding == BIT2:
            c = unpack(raw, h.n_samples)
            return np.where(c == MISSING, np.nan, c.astype(np.float32))
        if h.encoding == U8:
            return np.where(raw == MISSING, np.nan, raw.astype(np.float32))
        return np.ascontiguousarray(raw).view(np.float16 if h.encoding == F16 else np.float32).astype(np.float32)

    def dosages(self, start: int = 0, end: int | None = None) -> np.ndarray:
        return self.decode(self.raw(start, len(self) if end is None else end))

    def dosages_at(self, index) -> np.ndarray:
        """Rows in the order asked for; adjacent indices are read as one range."""
        idx = np.asarray(index, np.int64)
        uniq, back = np.unique(idx, return_inverse=True)
        if not len(uniq):
            return np.zeros((0, self.header.n_samples), np.float32)
        cut = np.flatnonzero(np.diff(uniq) > 1) + 1
        return np.concatenate([self.dosages(int(r[0]), int(r[-1]) + 1) for r in np.split(uniq, cut)])[back]

    def codes(self, start: int, end: int) -> np.ndarray:
        raw = self.raw(start, end)
        return raw if self.header.encoding == BIT2 else pack(codes_of(self.decode(raw)))


class Writer:
    """Streams variants into a file; the header comes last, so an unfinished file is invalid."""

    def __init__(self, path: str, n_samples: int, n_variants: int, encoding: int = BIT2, magic: bytes = MAGIC):
        self.path, self.n, self.m, self.encoding, self.magic = path, n_samples, n_variants, encoding, magic
        self.size = _BYTES[encoding](n_samples)
        self.stats_at = HEADER
        self.gidx_at = HEADER + 12 * n_variants
        self.data_at = self.gidx_at + 8 * n_variants
        self.stat = np.zeros((3, n_variants), np.float32)
        self.gidx = np.zeros(n_variants, np.int64)
        self.k, self.missing = 0, False

    def __enter__(self) -> Writer:
        self.f = open(self.path, "wb")
        self.f.seek(self.data_at)
        return self

    def add(self, dosage, gidx: int | None = None) -> None:
        d = np.asarray(dosage, float)
        mu, sxx, maf, miss = variant_stats(d)
        if self.encoding == BIT2:
            raw = pack(codes_of(d))
        elif self.encoding == U8:
            raw = codes_of(d)
        else:
            raw = np.where(np.isfinite(d) & (d >= 0) & (d <= 2), d, np.nan).astype(np.float16 if self.encoding == F16 else np.float32)
        self._put(raw.tobytes(), mu, sxx, maf, miss, gidx)

    def add_packed(self, raw: bytes, gidx: int | None = None) -> None:
        c = counts(np.frombuffer(raw, np.uint8), self.n)
        mu, sxx, maf = stats_of_counts(c)
        self._put(raw, float(mu), float(sxx), float(maf), bool(c[3]), gidx)

    def _put(self, raw: bytes, mu: float, sxx: float, maf: float, miss: bool, gidx: int | None) -> None:
        if self.k >= self.m:
            raise ValueError(f"more than the declared {self.m} variants")
        if len(raw) != self.size:
            raise ValueError(f"a record of {len(raw)} bytes, expected {self.size}")
        self.f.write(raw)
        self.stat[:, self.k] = mu, sxx, maf
        self.gidx[self.k] = self.k if gidx is None else gidx
        self.missing |= miss
        self.k += 1

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                if self.k != self.m:
                    raise ValueError(f"{self.m} variants declared, {self.k} written")
                self.f.seek(self.stats_at)
                self.f.write(self.stat.tobytes())
                self.f.write(self.gidx.tobytes())
                self.f.seek(0)
                flags = HAS_GIDX | (HAS_MISSING if self.missing else 0)
                self.f.write(_HEAD.pack(self.magic, VERSION, self.encoding, self.n, self.m, self.size, self.stats_at, self.data_at, self.gidx_at, flags).ljust(HEADER, b"\0"))
        finally:
            self.f.close()


def write_file(path: str, dosages, gidx=None, encoding: int = BIT2, magic: bytes = MAGIC) -> None:
    d = np.asarray(dosages, float)
    with Writer(path, d.shape[1], d.shape[0], encoding, magic) as w:
        for i, row in enumerate(d):
            w.add(row, None if gidx is None else int(gidx[i]))


# Spark source and sink
def chromosome(path: str) -> int:
    m = re.search(r"chr(\d+)", os.path.basename(path))
    return int(m[1]) if m else 0


def files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted((p for p in glob.glob(os.path.join(path, "chr*")) if os.path.isfile(p) and not p.endswith((".bak", ".txt"))), key=lambda p: (chromosome(p), p))
    return [path]


@dataclass
class Range(InputPartition):
    path: str
    chr: int
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}
        self.stats_only = self.o.get("stats_only", "false").lower() == "true"
        self.magic = bytes(self.o["magic"], "latin1") if "magic" in self.o else None
        self.lo, self.hi = int(self.o.get("start", 0)), int(self.o["end"]) if "end" in self.o else None
        self.asked: dict[str, set[int]] = {}
        self.chrs: set[int] | None = {int(x) for x in self.o["chromosomes"].split(",")} if "chromosomes" in self.o else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges and lists of vidx, lists of gidx and chromosomes prune what is read; Spark checks all filters again."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("vidx",):
                self.lo = max(self.lo, int(f.value))
            elif isinstance(f, LessThan) and f.attribute == ("vidx",):
                self.hi = int(f.value) if self.hi is None else min(self.hi, int(f.value))
            elif isinstance(f, EqualTo) and f.attribute == ("chr",):
                self.chrs = {int(f.value)} & (self.chrs or {int(f.value)})
            elif isinstance(f, In) and f.attribute == ("chr",):
                s = {int(v) for v in f.value}
                self.chrs = s & (self.chrs or s)
            elif isinstance(f, In) and f.attribute in (("vidx",), ("gidx",)):
                self.asked[f.attribute[0]] = {int(v) for v in f.value}
            elif isinstance(f, EqualTo) and f.attribute in (("vidx",), ("gidx",)):
                self.asked[f.attribute[0]] = {int(f.value)}
            yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in files(self.o["path"]):
            c = chromosome(p)
            if self.chrs is not None and c not in self.chrs:
                continue
            h = read_header(p, self.magic)
            step = int(self.o.get("rows_per_split", max(1, (32 << 20) // max(h.bytes_per_variant, 1))))
            end = h.n_variants if self.hi is None else min(self.hi, h.n_variants)
            if not self.asked:
                out += [Range(p, c, a, min(a + step, end)) for a in range(self.lo, end, step)]
                continue
            at = np.arange(self.lo, end)
            with Reader(p, self.magic) as r:
                for name, want in self.asked.items():
                    at = at[np.isin(at if name == "vidx" else r.gidx[at], list(want))]
            # adjacent variants are one range
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                out += [Range(p, c, a, min(a + step, int(run[-1]) + 1)) for a in range(int(run[0]), int(run[-1]) + 1, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with Reader(part.path, self.magic) as r:
            for a in range(part.start, part.end, 1024):
                b = min(a + 1024, part.end)
                n = b - a
                mu, sxx, maf = (pa.array(x.astype(np.float64)) for x in r.stats(a, b))
                packed = pa.nulls(n, pa.binary()) if self.stats_only else pa.array([x.tobytes() for x in r.codes(a, b)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.chr, np.int32)), pa.array(r.gidx[a:b]), pa.array(np.arange(a, b)), pa.array(np.full(n, r.header.n_samples, np.int32)), mu, sxx, maf, packed], ["chr", "gidx", "vidx", "n_samples", "mu_x", "sxx", "maf", "packed"])


@dataclass
class _Done(WriterCommitMessage):
    parts: list


class _Writer(DataSourceWriter):
    """Tasks write their variants' records as part files; the commit joins them, chromosome by chromosome."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.magic = bytes(options["magic"], "latin1") if "magic" in options else MAGIC

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        tid = TaskContext.get().taskAttemptId()
        tmp = os.path.join(self.path, "_parts")
        os.makedirs(tmp, exist_ok=True)
        held: dict[int, list] = {}
        for r in rows:
            held.setdefault(r.chr, []).append((r.vidx, r.gidx, r.n_samples, bytes(r.packed)))
        out = []
        for c, v in held.items():
            v.sort()
            p = os.path.join(tmp, f"{c}-{tid}.npz")
            np.savez(p, vidx=[x[0] for x in v], gidx=[x[1] for x in v], raw=np.frombuffer(b"".join(x[3] for x in v), np.uint8).reshape(len(v), -1))
            out.append((c, v[0][2], len(v), v[0][0], p))
        return _Done(out)

    def commit(self, messages: list) -> None:
        by: dict[int, list] = {}
        for m in messages:
            for x in m.parts if m else []:
                by.setdefault(x[0], []).append(x)
        for c, parts in by.items():
            parts.sort(key=lambda x: x[3])
            if len({x[1] for x in parts}) > 1:
                raise ValueError(f"chromosome {c} has rows of different sample counts")
            final = os.path.join(self.path, f"chr{c}{SUFFIX}")
            with Writer(final + ".tmp", parts[0][1], sum(x[2] for x in parts), magic=self.magic) as w:
                last = -1
                for x in parts:
                    z = np.load(x[4])
                    if int(z["vidx"][0]) <= last:
                        raise ValueError("sort the rows by chr and vidx before writing (prepare_for_write)")
                    last = int(z["vidx"][-1])
                    for raw, g in zip(z["raw"], z["gidx"], strict=True):
                        w.add_packed(raw.tobytes(), int(g))
            os.replace(final + ".tmp", final)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        import shutil

        shutil.rmtree(os.path.join(self.path, "_parts"), ignore_errors=True)


class GtPack(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gtpack"

    def schema(self) -> str:
        return "chr int, gidx long, vidx long, n_samples int, mu_x double, sxx double, maf double, packed binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    from varloom.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GtPack)


def prepare_for_write(variants: DataFrame, n: int | None = None) -> DataFrame:
    """Range-partitioned and sorted, so that part files of a chromosome are disjoint runs of vidx."""
    v = variants.select("chr", "gidx", "vidx", "n_samples", "mu_x", "sxx", "maf", "packed")
    return (v.repartitionByRange(n, "chr", "vidx") if n else v.repartitionByRange("chr", "vidx")).sortWithinPartitions("chr", "vidx")
