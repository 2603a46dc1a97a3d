"""SimHash near-duplicate linking with BK-trees.

Fingerprints are 64-bit SimHashes of word shingles. Distinct fingerprints are put into shards of about ``TREE`` to
2 ``TREE`` members by some of their own bits, so that two fingerprints within the radius share at least one shard
(pigeonhole: of radius + s blocks of bits, s are equal; s and the number of bits grow with the table, and a table
that fits one tree has one shard). Every shard is a BK-tree, children keyed by their integer Hamming distance to the
parent, in flat arrays; a lookup follows only the edges within the radius of its distance to the node. A shard with
more than twice ``TREE`` members is several trees, each of which meets all of the shard's queries.

Trees are broadcast in groups of at most ``GROUP_BYTES``, measured, of which a worker holds one at a time, and the
fingerprints are looked up where they are, without a shuffle. With more than ``MAX_GROUPS`` groups the lookups go to
their trees instead, by a shuffle on (shard, sub-tree). Both ways give the same links. Lookups emit a spanning
forest of what they found, never all pairs. Components are closed by alternating large-star and small-star steps on
the shared folder, with hubs joined apart.

Edge cases: a null or word-free text has fingerprint zero and links like any other; repeated rows give
repeated result rows; a null ``doc_id`` stays a row, and a component's id is the smallest non-null id
in it (null when there is none); an empty table gives an empty result; other columns are ignored, whatever their
names; ``near_duplicates`` takes integer ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import cuts, frugal, lookup_join, materialize
from varloom.session import ship

RADIUS = 4
TREE = 10_000
NODE_BYTES = 16
GROUP_BYTES = 8 << 20
MAX_GROUPS = 16
HUB = 100_000
_HASH_CHUNK = 1 << 18
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


# fingerprints
def _majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups: bit set when set in over half of the group's hashes.

    Sixteen passes count four 16-bit lanes at once; segments are at most 65,535 hashes long.
    """
    n = np.diff(bounds)
    seg = [np.arange(a, b, 65_535) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
    out = np.zeros(len(n), np.uint64)
    if not seg:
        return out
    group = np.repeat(np.flatnonzero(n), [len(s) for s in seg])
    at = np.concatenate(seg)
    lane = np.uint64(0x0001000100010001)
    for k in range(16):
        part = np.add.reduceat((hashes >> np.uint64(k)) & lane, at)
        for j in range(4):
            c = np.zeros(len(n), np.int64)
            np.add.at(c, group, ((part >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64))
            out |= (2 * c > n).astype(np.uint64) << np.uint64(16 * j + k)
    return out


def _shingle_hashes(text: bytes | None, width: int, size: int = 1 << 20) -> Iterator[list[int]]:
    """XXH64 (seed 42) of every shingle, repeats included, in lists of bounded length, a megabyte of text at a time."""
    if not text:
        return
    h = xxhash.xxh64_intdigest
    parts = [(0, len(text))] if len(text) <= size else cuts(_WORD, np.frombuffer(text, np.uint8), size)
    before: list[bytes] = []  # the last words of the part before
    some = False
    for lo, hi in parts:
        words = before + text[lo:hi].lower().split()  # bytes: A-Z only, and the six ASCII blanks
        n = len(words)
        if n < width:
            before = words
            continue
        some = True
        line = b" ".join(words)
        length = np.fromiter(map(len, words), np.int64, n) + 1
        ends = np.cumsum(length) - 1
        starts, ends = (ends - length + 1)[: n - width + 1], ends[width - 1 :]
        yield [h(line[i:j], 42) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        before = words[n - width + 1 :]
    if not some and before:
        yield [h(b" ".join(before), 42)]


def fingerprint_texts(texts: list[bytes | None], width: int = 4) -> np.ndarray:
    """Fingerprints of UTF-8 texts as uint64."""
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    total = 0

    def flush() -> None:
        nonlocal total
        if rows:
            out[rows] = _majority(np.concatenate(held), np.cumsum([0, *map(len, held)]))
        held.clear()
        rows.clear()
        total = 0

    for i, t in enumerate(texts):
        parts = [np.array(p, np.uint64) for p in _shingle_hashes(t, width)]
        if parts:
            held.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
            rows.append(i)
            total += len(held[-1])
        if total > _HASH_CHUNK:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (the fingerprint as a signed long)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint_texts(b.column(1).cast(pa.binary()).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


# BK-trees
class Tree:
    """A BK-tree of distinct fingerprints in flat arrays: edges sorted by (parent, distance), the root is node 0."""

    def __init__(self, fp: np.ndarray, key: np.ndarray, kid: np.ndarray):
        self.fp, self.key, self.kid = fp, key, kid
        self.visited = 0
        inner = np.unique(key // 65)
        self.row = np.full(len(fp), -1, np.int32)
        self.row[inner] = np.arange(len(inner))
        # first edge of each inner node at each distance
        want = (inner.astype(np.int64)[:, None] * 65 + np.arange(66)[None, :]).reshape(-1)
        self.at = np.searchsorted(key, want).astype(np.int32)

    @staticmethod
    def edges(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edge keys (parent * 65 + distance) and children, level by level: each node hangs below the last node of its path."""
        cur = np.zeros(len(fp), np.int64)
        pending = np.arange(1, len(fp))
        keys, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(pending):
            key = cur[pending] * 65 + np.bitwise_count(fp[pending] ^ fp[cur[pending]]).astype(np.int64)
            uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = pending[first]
            keys.append(uniq)
            kids.append(child)
            cur[pending] = child[back]
            placed = np.zeros(len(pending), bool)
            placed[first] = True
            pending = pending[~placed]
        key, kid = np.concatenate(keys), np.concatenate(kids)
        order = np.argsort(key)
        return key[order].astype(np.int32), kid[order].astype(np.int32)

    @classmethod
    def build(cls, fp: np.ndarray) -> Tree:
        return cls(fp, *cls.edges(fp))

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, node) of every node within the radius, in bounded parts; only edges within it are followed."""
        a, step = 0, 64
        while a < len(query):
            part = query[a : a + step]
            q, node = np.arange(len(part), dtype=np.int32), np.zeros(len(part), np.int32)
            peak, hits_q, hits_n = 1, [], []
            while len(q):
                peak = max(peak, len(q))
                self.visited += len(q)
                d = np.bitwise_count(part[q] ^ self.fp[node]).astype(np.int32)
                near = d <= radius
                if near.any():
                    hits_q.append(q[near])
                    hits_n.append(node[near])
                row = self.row[node]
                ok = row >= 0
                q, d, row = q[ok], d[ok], row[ok] * np.int32(66)
                lo = self.at[row + np.maximum(d - radius, 0)]
                n = self.at[row + np.minimum(d + radius, 64) + 1] - lo
                q = np.repeat(q, n)
                node = self.kid[np.repeat(lo - np.cumsum(n, dtype=np.int32) + n, n) + np.arange(len(q), dtype=np.int32)]
            if hits_q:
                yield np.concatenate(hits_q).astype(np.int64) + a, np.concatenate(hits_n).astype(np.int64)
            a += len(part)
            step = min(max(step * 400_000 // peak, 1), 2 * step, 4096)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-index labels after joining a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def forest(tree: Tree, query: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between queries and the nodes of a tree."""
    both = np.concatenate([query, tree.fp])
    label = np.arange(len(both))
    for q, n in tree.search(query, radius):
        label = _merge(label, q, n + len(query))
    moved = np.flatnonzero(label != np.arange(len(both)))
    a, b = both[moved], both[label[moved]]
    return a[a != b], b[a != b]


def routes(n: int, radius: int = RADIUS, tree: int = TREE) -> list[list[tuple[int, int]]]:
    """The tables of shards for n fingerprints: for each, the (offset, width) bit fields that name a shard.

    Fingerprints within the radius agree on all fields of at least one table; a shard has about ``tree`` to
    2 ``tree`` members when the bits are even.
    """
    bits = max(int(math.log2(max(n, 1) / tree)), 0)
    if not bits:
        return [[]]
    for s in (1, 2, 3):
        m = radius + s
        if bits <= s * (64 // m) or s == 3:
            break
    edges = [64 * i // m for i in range(m)]
    width = [min(-(-bits // s), 64 // m)] * s
    for i in range(sum(width) - bits if sum(width) > bits else 0):
        width[i] -= 1
    return [[(edges[i], w) for i, w in zip(c, width, strict=True)] for c in combinations(range(m), s)]


def _shard_keys(fp: Column, tables: list[list[tuple[int, int]]]) -> Column:
    """The shards of a fingerprint, one a table: its number and the bits of its fields."""
    out = []
    for k, fields in enumerate(tables):
        c = F.lit(k).cast("long")
        for at, w in fields:
            c = F.shiftleft(c, w).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1)))
        out.append(c)
    return F.array(*out)


def _shards_of(fp: np.ndarray, k: int, fields: list[tuple[int, int]]) -> np.ndarray:
    c = np.full(len(fp), k, np.int64)
    for at, w in fields:
        c = (c << w) | ((fp >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64)
    return c


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(shard, part, fingerprints, roles) of each cell of a partition sorted by shard and part."""
    held: list[list[np.ndarray]] = []
    cur = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1 if len(cols[0]) else []
        for lo, hi in zip([0, *cut], [*cut, len(cols[0])], strict=True):
            if hi == lo:
                continue
            cell = int(cols[0][lo]), int(cols[1][lo])
            if cur is not None and cell != cur:
                yield *cur, *(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            cur = cell
            held.append([cols[2][lo:hi].view(np.uint64), cols[3][lo:hi]])
    if cur is not None:
        yield *cur, *(np.concatenate(x) for x in zip(*held, strict=True))


def links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE, group_bytes: int = GROUP_BYTES, max_groups: int = MAX_GROUPS, rows_per_task: int = 500_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints at ``radius`` or less: spanning forests that together join what is linked."""
    spark = fps.sparkSession
    ship(spark)
    distinct = materialize(fps.select("fp").distinct(), "simhash-fps")
    n = distinct.count()
    tables = routes(n, radius, tree)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(tables) * n // rows_per_task))
    keyed = distinct.select("fp", F.explode(_shard_keys(F.col("fp"), tables)).alias("shard"))
    big = keyed.groupBy("shard").count().where(F.col("count") > 2 * tree).select("shard", F.ceil(F.col("count") / tree).cast("int").alias("g"))
    big = materialize(big, "simhash-big")
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    split = lookup_join(keyed, big, ["shard"], salt=F.col("fp")).withColumn("g", F.coalesce("g", F.lit(1))).withColumn("own", own)
    if n * len(tables) * NODE_BYTES <= max_groups * group_bytes:
        return _broadcast_links(distinct, split, tables, radius, parts, group_bytes)
    # every two parts s <= t of a shard meet in one cell: the tree holds s, the lookups are t's
    s, t = F.col("own"), F.col("t")
    cells = split.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("shard", (F.least(s, t).cast("long") * F.col("g") + F.greatest(s, t)).alias("part"), "fp", F.when(s == t, 0).when(s < t, 1).otherwise(2).cast("tinyint").alias("role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, fp, role in _cells(batches):
            mine, asks = fp[role != 2], fp[role != 1]
            if len(mine) and len(asks) and len(fp) > 1:
                a, b = forest(Tree.build(np.sort(mine)), asks, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return cells.repartition(parts, "shard", "part").sortWithinPartitions("shard", "part").mapInArrow(frugal(run), "a long, b long").distinct()


def _broadcast_links(distinct: DataFrame, split: DataFrame, tables: list, radius: int, parts: int, group_bytes: int) -> DataFrame:
    """The same by broadcast trees, in groups of at most ``group_bytes`` (or one tree)."""
    sc = distinct.sparkSession.sparkContext

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part, fp, _ in _cells(batches):
            fp = np.sort(fp)
            key, kid = Tree.edges(fp)
            size = fp.nbytes + key.nbytes + kid.nbytes
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (fp, key, kid)]], ["shard", "part", "size", "fp", "key", "kid"])

    cells = split.select("shard", F.col("own").alias("part"), "fp", F.lit(0).cast("tinyint").alias("role"))
    trees = materialize(cells.repartition(parts, "shard", "part").sortWithinPartitions("shard", "part").mapInArrow(frugal(build), "shard long, part int, size long, fp binary, key binary, kid binary"), "simhash-trees")
    groups, room = [], 0
    for r in trees.select("shard", "part", "size").orderBy("shard", "part").collect():  # a row a tree, as many as the size check lets through
        if r["size"] > room:
            groups.append([])
            room = group_bytes
        groups[-1].append(r)
        room -= r["size"]
    held = []
    for g in groups:
        (lo, lo_part), (hi, hi_part) = g[0][:2], g[-1][:2]
        after = (F.col("shard") > lo) | ((F.col("shard") == lo) & (F.col("part") >= lo_part))
        before = (F.col("shard") < hi) | ((F.col("shard") == hi) & (F.col("part") <= hi_part))
        rows = trees.where(after & before).collect()
        held.append(sc.broadcast([(r.shard, np.frombuffer(r.fp, np.uint64), np.frombuffer(r.key, np.int32), np.frombuffer(r.kid, np.int32)) for r in rows]))

    def look(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([_shards_of(fp, k, t) for k, t in enumerate(tables)])
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], order % len(fp)
        for b in held:
            for shard, *arrays in b.value:
                lo, hi = np.searchsorted(keys, [shard, shard + 1])
                if hi > lo:
                    x, y = forest(Tree(*arrays), fp[row[lo:hi]], radius)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])
            b.__dict__.pop("_value", None)  # one group in memory at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[np.ndarray] = []
        for b in batches:
            got.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, got)) >= 1_000_000:
                yield from look(np.concatenate(got))
                got = []
        if got:
            yield from look(np.concatenate(got))

    tasks = distinct.repartition(parts, "fp")
    return tasks.mapInArrow(frugal(run), "a long, b long").distinct()


# components
def _with_least(both: DataFrame, m: DataFrame, hub: int) -> DataFrame:
    """Joins (u, v) rows with m(u, m, n); nodes with more than ``hub`` rows are few and joined apart, so no task gets a hub."""
    hubs = m.where(F.col("n") > hub).select("u", F.col("m").alias("hm"))
    if not hubs.limit(1).count():
        return both.join(m.drop("n"), "u")
    marked = lookup_join(both, hubs, ["u"], salt=F.col("v"))
    return marked.where("hm is not null").select("u", "v", F.col("hm").alias("m")).unionByName(marked.where("hm is null").select("u", "v").join(m.where(F.col("n") <= hub).drop("n"), "u"))


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, label): the smallest node of each component of the edges (a, b), by alternating stars until they settle."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        large = materialize(_with_least(both, m, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-low")
        small = _with_least(large, low, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "cc-edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (long), component (label), component_id (smallest id reachable)."""
    fps = materialize(fingerprints(docs, id_col, text_col, width), "simhash-docs")
    comp = materialize(components(links(fps, radius)), "simhash-comp")
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    node = F.col("node").alias("fp")
    linked = materialize(comp.select(node, "label").join(ids, "fp").groupBy("label").agg(F.min("doc_id").alias("cid")), "simhash-cid")
    by_label = materialize(lookup_join(comp.select(node, "label"), linked, ["label"], "inner", salt=F.col("fp")).select("fp", "label", "cid"), "simhash-label")
    # fingerprints that occur once and link to none need no lookup: their id is their own
    own = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", "own"), "simhash-own")
    out = lookup_join(fps, by_label, ["fp"], salt=F.col("doc_id"))
    out = lookup_join(out, own, ["fp"], salt=F.col("doc_id"))
    return out.select("doc_id", "fp", F.coalesce("label", "fp").alias("component"), F.when(F.col("label").isNotNull(), F.col("cid")).otherwise(F.coalesce("own", "doc_id")).alias("component_id"))




def tag(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a key of id and text, nulls told apart from values), doc_id, text and the whole document as ``doc``: no column of it can clash."""
    i, t = F.col(id_col), F.col(text_col)
    return docs.select(F.xxhash64(i.isNull(), i, t.isNull(), t).alias("row"), i.alias("doc_id"), t.alias("text"), F.struct("*").alias("doc"))


def keep_one(tagged: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of one row of each component: that with the smallest id (null last), and of repeated rows one.

    ``tagged`` is made by ``tag``; ``rows`` has (row, doc_id, component), repeats included.
    """
    many = rows.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")).alias("w")).where("c > 1")
    many = materialize(many.select("component", F.col("w.row").alias("winner")), "simhash-winners")
    of = materialize(lookup_join(rows.select("row", "component"), many, ["component"], "inner", salt=F.col("row")), "simhash-members")
    losers = materialize(of.where("row <> winner").select("row").distinct(), "simhash-lost")
    twice = materialize(of.where("row = winner").groupBy("row").count().where("count > 1").select("row"), "simhash-twice")
    kept = lookup_join(tagged.select("row", "doc"), losers, ["row"], "left_anti")
    if twice.limit(1).count():
        again = lookup_join(kept, twice, ["row"], "left_semi").groupBy("row").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
        kept = lookup_join(kept, twice, ["row"], "left_anti").unionByName(again)
    return kept.select("doc.*")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = 4) -> DataFrame:
    """Keep one document of each component: that with the smallest id (of repeated rows, one).

    Rows are told apart by id and text, so that an id that repeats with different texts loses none of them.
    """
    tagged = tag(docs, id_col, text_col)
    nd = near_duplicates(tagged, "row", "text", radius, width).select(F.col("doc_id").alias("row"), "component").distinct()
    return keep_one(tagged, materialize(tagged.select("row", "doc_id").join(materialize(nd, "simhash-nd"), "row"), "simhash-named"))
