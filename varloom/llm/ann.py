"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Distinct vectors are put into shards of at most about ``shard_rows`` rows and ``SHARD_BYTES``: by length, by band of
magnitude (a factor of 16), then by hash, so that single precision inside a shard loses nothing that matters. Each
shard is one graph, stored as flat arrays (level-0 neighbours, upper-level neighbours, vectors, ids). Inner product is
turned into Euclidean distance by one more coordinate that makes all norms equal.

A graph is built by insertion: nodes come in batches that grow with what is there (a single node first, then at most
half of the graph, ``BATCH`` at most). Each node descends from the entry point, greedily above its own level; from its
level down, a beam search of the graph and the other nodes of its batch give candidates, the usual rule (keep a
candidate that is nearer to the node than to any kept one) picks its neighbours, and links back are pruned by the
same rule when a list is full. A ring at the end makes every node reachable. A search descends the levels greedily
and runs a beam of width ``ef`` on level 0, for a block of queries at once.

Every block of queries meets every shard of its length: a shard's graph reaches a task once, before the blocks, in one
sorted stream. Shard results are merged; scores are exact inner products in double precision of the original vectors.

Equal vectors are one node: each keeps the ``k`` + 1 smallest of its ids, which is all that a top-k can show.

Edge cases: vectors that are null, zero, or that hold null or non-finite components take no part, nor do rows with a
null id; a query meets the vectors of its own length; a vec_id that repeats is one candidate, with its best score, and
no candidate of itself; ties go to the smaller vec_id; with fewer than k candidates all are returned; components of any
finite size are searched, and a score beyond double range is infinite; empty tables give empty results; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.llm.common import frugal, lookup_join, materialize, mix64
from varloom.session import ship

DEGREE = 16
SLACK = 16
BUILD_EF = 32
BATCH = 512
EF = 160
SHARD_ROWS = 16_384
SHARD_BYTES = 32 << 20
QUERY_BLOCK = 1024


# one shard's graph
def _levels(n: int) -> np.ndarray:
    """Geometric levels from a hash of the position: reruns build the same graph."""
    u = (mix64(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(DEGREE)).astype(np.int64), 12)


def _augment(v: np.ndarray) -> np.ndarray:
    """Vectors scaled to norms of at most 1, with the coordinate that makes all norms 1."""
    y = v / np.abs(v).max()
    sq = np.einsum("ij,ij->i", y, y)
    top = sq.max()
    return (np.column_stack([y, np.sqrt(np.maximum(top - sq, 0))]) / math.sqrt(top)).astype(np.float32)


def _dots(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows q[i] and x[j], in parts that stay in cache."""
    out = np.empty(len(i), np.float32)
    for a in range(0, len(i), 2048):
        np.einsum("id,id->i", q.take(i[a : a + 2048], 0), x.take(j[a : a + 2048], 0), out=out[a : a + 2048])
    return out


def _beam(x: np.ndarray, nb: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, fan: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` best nodes (n, ef) and their similarities found from ``start`` along ``nb``; -1 where there are fewer, in no order."""
    m = len(q)
    beam = np.full((m, ef), -1, np.int32)
    sims = np.full((m, ef), -np.inf, np.float32)
    open_ = np.full((m, ef), -np.inf, np.float32)  # similarity of what isn't expanded yet
    beam[:, 0] = start
    sims[:, 0] = open_[:, 0] = np.einsum("ij,ij->i", q, x[start])
    seen = np.zeros((m, len(nb)), bool)
    seen[np.arange(m), start] = True
    flat = seen.reshape(-1)
    active = np.arange(m)
    fan = min(fan, ef)
    while len(active):
        b, s, o = beam[active], sims[active], open_[active]
        pick = np.argpartition(-o, fan - 1, axis=1)[:, :fan] if fan < ef else np.tile(np.arange(ef), (len(active), 1))
        node = np.where(np.take_along_axis(o, pick, 1) > -np.inf, np.take_along_axis(b, pick, 1), -1)
        np.put_along_axis(o, pick, -np.inf, 1)
        cand = np.where(node[:, :, None] >= 0, nb.take(np.maximum(node, 0), 0), -1).reshape(len(active), -1)
        cand.sort(axis=1)
        fresh = cand >= 0
        fresh[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        at = np.flatnonzero(fresh)
        r, new = at // cand.shape[1], cand.ravel().take(at)
        place = active.take(r) * len(nb) + new
        fresh = ~flat.take(place)
        r, new = r[fresh], new[fresh]
        flat[place[fresh]] = True
        v = _dots(q, x, active.take(r), new)
        better = v > s.min(1)[r]
        r, new, v = r[better], new[better], v[better]
        # pack what is new to the left, then keep the best
        at = np.arange(len(r)) - np.searchsorted(r, r)
        width = int(at.max()) + 1 if len(at) else 0
        if width:
            more_s = np.full((len(active), width), -np.inf, np.float32)
            more_b = np.full((len(active), width), -1, np.int32)
            more_s[r, at], more_b[r, at] = v, new
            all_s, all_b, all_o = np.concatenate([s, more_s], 1), np.concatenate([b, more_b], 1), np.concatenate([o, more_s], 1)
            keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            s, b, o = (np.take_along_axis(a, keep, 1) for a in (all_s, all_b, all_o))
        sims[active], beam[active], open_[active] = s, b, o
        active = active[(o > -np.inf).any(1)]
    return beam, sims


def _descend(x: np.ndarray, nodes: np.ndarray, nb: np.ndarray, q: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """The node of a level that no neighbour beats, from ``cur`` greedily."""
    cur = cur.copy()
    best = np.einsum("ij,ij->i", q, x[cur])
    active = np.arange(len(q))
    while len(active):
        cand = nb[np.searchsorted(nodes, cur[active])]
        s = np.einsum("qd,qkd->qk", q[active], x[cand])
        s[cand < 0] = -np.inf
        j = s.argmax(1)
        v = s[np.arange(len(active)), j]
        up = v > best[active]
        moved = active[up]
        cur[moved], best[moved] = cand[up, j[up]], v[up]
        active = moved
    return cur


def _select(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, limit: int) -> np.ndarray:
    """Neighbours (n, limit) picked from candidates (n, c): nearer to the node than to any picked one first, then the nearest."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    n, c = cand.shape
    out = np.full((n, limit), -1, np.int32)
    for a in range(0, n, 256):
        k, s = cand[a : a + 256], sim[a : a + 256]
        xs = x.take(np.maximum(k, 0), 0)
        between = xs @ xs.transpose(0, 2, 1)
        kept = np.zeros(k.shape, bool)
        closest = np.full(k.shape, -np.inf, np.float32)  # largest similarity to a picked candidate
        for j in range(c):
            take = (s[:, j] > closest[:, j]) & (k[:, j] >= 0)
            kept[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, :, j]), closest)
        rank = np.argsort(np.where(k < 0, 2, ~kept), axis=1, kind="stable")[:, :limit]
        out[a : a + 256, : rank.shape[1]] = np.take_along_axis(k, rank, 1)
    return out


class _Level:
    """Neighbour lists of one level while it is built; lists may overrun ``limit`` by ``SLACK`` before they are pruned."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, limit: int):
        self.x, self.nodes, self.limit = x, nodes, limit
        self.nb = np.full((len(nodes), limit + SLACK), -1, np.int32)
        self.n = np.zeros(len(nodes), np.int64)

    def link(self, new: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        """Links new nodes with their picked candidates, and those back."""
        half = self.limit // 2
        mine = _select(self.x, cand, sim, half)
        at = np.searchsorted(self.nodes, new)
        self.nb[at, :half] = mine
        self.n[at] = (mine >= 0).sum(1)
        r, c = np.nonzero(mine >= 0)
        src, dst = new[r], np.searchsorted(self.nodes, mine[r, c])
        # nodes of a batch may have picked each other
        fresh = ~(self.nb[dst] == src[:, None]).any(1)
        src, dst = src[fresh], dst[fresh]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        place = self.n[dst] + np.arange(len(dst)) - np.searchsorted(dst, dst)
        fits = place < self.nb.shape[1]
        self.nb[dst[fits], place[fits]] = src[fits]
        self.n[dst[fits]] = np.maximum(self.n[dst[fits]], place[fits] + 1)
        np.maximum.at(self.n, dst[fits], place[fits] + 1)
        if not fits.all():
            full, where = np.unique(dst[~fits], return_inverse=True)
            rank = place[~fits] - self.nb.shape[1]
            more = np.full((len(full), int(rank.max()) + 1), -1, np.int32)
            more[where, rank] = src[~fits]
            self.prune(full, more)

    def prune(self, at: np.ndarray, more: np.ndarray | None = None) -> None:
        node = self.nodes[at]
        cand = self.nb[at] if more is None else np.concatenate([self.nb[at], more], 1)
        sim = np.einsum("qd,qkd->qk", self.x[node], self.x[np.maximum(cand, 0)])
        sim[cand < 0] = -np.inf
        self.nb[at] = -1
        self.nb[at, : self.limit] = _select(self.x, cand, sim, self.limit)
        self.n[at] = (self.nb[at] >= 0).sum(1)

    def close(self) -> np.ndarray:
        """The finished lists: pruned to the limit, with a ring through all nodes in one more place."""
        over = np.flatnonzero(self.n > self.limit)
        if len(over):
            self.prune(over)
        ring = np.roll(self.nodes, -1) if len(self.nodes) > 1 else np.full(1, -1)
        return np.column_stack([self.nb[:, : self.limit], ring]).astype(np.int32)


class Graph:
    """A shard's index in flat arrays."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, id_at: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.ids, self.id_at, self.layers = vectors, ids, id_at, layers
        self.x = _augment(vectors)

    @classmethod
    def build(cls, vectors: np.ndarray, ids: list[np.ndarray]) -> Graph:
        n = len(vectors)
        levels, x = _levels(n), _augment(vectors)
        build = [_Level(x, np.flatnonzero(levels >= lev), 2 * DEGREE if lev == 0 else DEGREE) for lev in range(int(levels.max()) + 1)]
        entry, top, a = 0, int(levels[0]), 1
        while a < n:
            b = min(a + min(max(a // 2, 1), BATCH), n)
            new = np.arange(a, b)
            q, cur = x[new], np.full(b - a, entry)
            for lev in range(top, -1, -1):
                level = build[lev]
                lo = int(np.searchsorted(level.nodes, a))  # nodes of this level that are in the graph
                below = levels[new] < lev
                if lev and below.any():
                    cur[below] = _descend(x, level.nodes, level.nb, q[below], cur[below])
                mine = np.flatnonzero(~below)
                if len(mine):
                    # searched by place within the level
                    start = np.searchsorted(level.nodes, cur[mine])
                    places = level.nb[:lo] if lev == 0 else np.where(level.nb[:lo] >= 0, np.searchsorted(level.nodes, level.nb[:lo]), -1)
                    found, sim = _beam(x if lev == 0 else x[level.nodes[:lo]], places, q[mine], start, min(BUILD_EF, lo))
                    found = np.where(found >= 0, level.nodes[np.maximum(found, 0)], -1)
                    cur[mine] = np.take_along_axis(found, sim.argmax(1)[:, None], 1)[:, 0]
                    level.link(new[mine], *cls._with_mates(q[mine], new[mine], found, sim))
            for lev in range(top + 1, int(levels[new].max()) + 1):  # levels that begin with this batch
                mine = np.flatnonzero(levels[new] >= lev)
                none = np.full((len(mine), 1), -1, np.int32)
                build[lev].link(new[mine], *cls._with_mates(q[mine], new[mine], none, np.full(none.shape, -np.inf, np.float32)))
            if levels[new].max() > top:
                top = int(levels[new].max())
                entry = int(new[levels[new].argmax()])
            a = b
        return cls(vectors, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(i) for i in ids])]), [(lev.nodes, lev.close()) for lev in build])

    @staticmethod
    def _with_mates(q: np.ndarray, new: np.ndarray, found: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates with the nearest nodes of the same batch."""
        k = min(len(new) - 1, 16)
        if k > 0:
            s = q @ q.T
            np.fill_diagonal(s, -np.inf)
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found, sim = np.concatenate([found, new[near].astype(np.int32)], 1), np.concatenate([sim, np.take_along_axis(s, near, 1)], 1)
        return found, sim

    def dump(self) -> bytes:
        parts = [self.vectors, self.ids, self.id_at, *[a for lay in self.layers for a in lay]]
        sink = pa.BufferOutputStream()
        for p in parts:
            pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(p)), sink)
        return len(parts).to_bytes(4, "little") + sink.getvalue().to_pybytes()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        src = pa.BufferReader(pa.py_buffer(raw[4:]))
        p = [pa.ipc.read_tensor(src).to_numpy() for _ in range(int.from_bytes(raw[:4], "little"))]
        return cls(*p[:3], list(zip(p[3::2], p[4::2], strict=True)))

    def search(self, queries: np.ndarray, want: int, ef: int = EF, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (n, want) nearest to each query by inner product, best first; -1 where there are fewer."""
        n, m = len(self.x), len(queries)
        # the size of a query changes no order
        q = np.column_stack([queries / np.abs(queries).max(1, keepdims=True), np.zeros(m)]).astype(np.float32)
        cur = np.full(m, self.layers[-1][0][0])
        for nodes, nb in reversed(self.layers[1:]):
            cur = _descend(self.x, nodes, nb, q, cur)
        ef = min(max(ef, want), n)
        beam, sims = _beam(self.x, self.layers[0][1], q, cur, ef, fan)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :want]
        fill = ((0, 0), (0, max(want - ef, 0)))
        return np.pad(np.take_along_axis(beam, order, 1), fill, constant_values=-1), np.pad(np.take_along_axis(sims, order, 1), fill, constant_values=-np.inf)


# Spark
def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v, d (length) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    lo, hi = F.array_min(v), F.array_max(v)  # a NaN is the largest number
    ok = F.forall(v, lambda x: x.isNotNull()) & (hi < float("inf")) & (lo > float("-inf")) & ((lo < 0) | (hi > 0))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(vec_col).alias("d"))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def build_index(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, d, graph: one row a shard, from (vec_id, v, d) rows."""
    ship(vectors.sparkSession)
    band = F.floor(F.log2(F.greatest(F.array_max("v"), -F.array_min("v"))) / 4).cast("int")
    base = materialize(vectors.select("vec_id", "v", "d", band.alias("band"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")), "ann-vectors")
    # of more than k + 1 equal vectors, the k + 1 smallest ids, by salted ranks so that many copies are not one task's
    copies = materialize(base.groupBy("h", "h2").count().where(F.col("count") > k + 1).select("h", "h2", F.lit(True).alias("hot")), "ann-copies")
    marked = lookup_join(base, copies, ["h", "h2"], salt=F.col("vec_id"))
    hot = marked.where("hot").select("vec_id", "v", "d", "band", "h", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(32)).cast("int").alias("s")).distinct()
    hot = hot.withColumn("r", F.row_number().over(W.partitionBy("h", "h2", "s").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    hot = hot.withColumn("r", F.row_number().over(W.partitionBy("h", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = marked.where("hot is null").select("vec_id", "v", "d", "band", "h").unionByName(hot.select("vec_id", "v", "d", "band", "h")) if copies.limit(1).count() else base.select("vec_id", "v", "d", "band", "h")
    room = F.greatest(F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("d")))), F.lit(256))
    groups = base.groupBy("d", "band").count().withColumn("shards", F.ceil(F.col("count") / room).cast("int"))
    groups = materialize(groups.select("d", "band", "shards", (F.sum("shards").over(W.orderBy("d", "band")) - F.col("shards")).cast("int").alias("first")), "ann-groups")
    total = groups.agg(F.sum("shards")).first()[0] or 1

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, vecs = table.column("vec_id").to_numpy(), _vectors(table.column("v"))
        order = np.argsort(ids, kind="stable")
        same: dict[bytes, int] = {}
        node = np.array([same.setdefault(vecs[i].tobytes(), len(same)) for i in order.tolist()])
        first = np.unique(node, return_index=True)[1]
        by = np.argsort(node, kind="stable")
        held = [np.unique(x)[: k + 1] for x in np.split(ids[order][by], np.flatnonzero(np.diff(node[by])) + 1)]
        g = Graph.build(np.ascontiguousarray(vecs[order[first]] + 0.0), held)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "d": pa.array([vecs.shape[1]], pa.int32()), "graph": pa.array([g.dump()], pa.binary())})

    keyed = lookup_join(few, groups, ["d", "band"], "inner", salt=F.col("vec_id")).select("vec_id", "v", (F.col("first") + F.pmod(F.col("h"), F.col("shards"))).cast("int").alias("shard"))
    return materialize(keyed.repartition(total, "shard").groupBy("shard").applyInArrow(run, "shard int, d int, graph binary"), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score: each shard's k best for each query (vec_id, v, d), the query's own id left out."""
    spark = index.sparkSession
    ship(spark)
    q = materialize(queries.distinct(), "ann-queries")
    blocks = max(1, -(-q.count() // block))
    shards = index.count()
    tasks = max(spark.sparkContext.defaultParallelism, shards)
    parts = max(1, min(blocks, tasks // max(shards, 1)))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v, i = _vectors(table.column("v")), table.column("vec_id").to_numpy()
        return pa.table({"d": pa.array([v.shape[1]], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "q_ids": pa.array([np.ascontiguousarray(i).tobytes()], pa.binary()), "q_vecs": pa.array([v.tobytes()], pa.binary())})

    packed = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("d", "block").applyInArrow(pack, "d int, block int, q_ids binary, q_vecs binary")
    packed = materialize(packed, "ann-blocks")
    # every block meets every shard of its length; a shard's graph comes first in its stream
    asked = lookup_join(packed, materialize(index.select("shard", "d"), "ann-shards"), ["d"], "inner", salt=F.col("block"))
    asked = asked.select("shard", F.pmod("block", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("turn"), "q_ids", "q_vecs", F.lit(None).cast("binary").alias("graph"))
    graphs = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("turn"), F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q_vecs"), "graph")
    stream = graphs.unionByName(asked).repartition(max(shards * parts, 1), "shard", "part").sortWithinPartitions("shard", "part", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for b in batches:
            for i in range(b.num_rows):
                raw, q_ids, q_vecs = (b.column(c)[i].as_py() for c in (2, 0, 1))
                if raw is not None:
                    graph = Graph.load(raw)
                    continue
                ids = np.frombuffer(q_ids, np.int64)
                vecs = np.frombuffer(q_vecs, np.float64).reshape(len(ids), -1)
                for a in range(0, len(ids), 512):
                    node, _ = graph.search(vecs[a : a + 512], k + 1, ef)
                    row, col = np.nonzero(node >= 0)
                    hit = node[row, col]
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = np.einsum("id,id->i", vecs[a + row], graph.vectors[hit])
                    size = np.diff(graph.id_at)[hit]
                    r = np.repeat(row, size)
                    take = np.repeat(graph.id_at[hit], size) + np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
                    cand, sc = graph.ids[take], np.repeat(score, size)
                    ok = cand != ids[a + r]
                    r, cand, sc = r[ok], cand[ok], sc[ok]
                    order = np.lexsort((cand, -sc, r))
                    r, cand, sc = r[order], cand[order], sc[order]
                    top = np.arange(len(r)) - np.searchsorted(r, r) < k
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + r[top]]), pa.array(cand[top]), pa.array(sc[top])], ["query_id", "vec_id", "score"])

    return stream.select("q_ids", "q_vecs", "graph").mapInArrow(frugal(run), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", ef: int = EF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query."""
    hits = search(build_index(_usable(vectors, id_col, vec_col), k, shard_rows), _usable(queries, id_col, vec_col), k, ef)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
