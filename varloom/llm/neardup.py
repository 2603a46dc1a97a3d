"""Near-duplicate removal at a similarity of word shingles: SimHash links first, min-hash candidates beyond their radius.

Two texts are near-duplicates when the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
Candidates come from the BK-trees of ``simhash`` over five-word fingerprints (each shingle set with the first of its
component). At that similarity SimHashes differ by about ten of 64 bits and by up to eighteen, too many for blocks of
equal bits, so further candidates come from min-hashes: 80 of them in 20 bands of four, of which a pair at 0.8 misses
all with probability 3e-5 (less above). Every candidate pair is then verified on the shingles themselves, so that
nothing below 0.8 is linked; components of the verified links are closed by ``simhash.components``.

Scale: texts are hashed once; one row a distinct shingle set and band is shuffled, bands of one set leave at once,
and shingle sets are made only for texts in candidate pairs. Pairs come from a join on the band, so no task holds a
band's pairs; a band shared by many different texts costs their pairs.

Edge cases: words are as in ``simhash``; a text under five words is one shingle; null and word-free texts are one
set; rows that agree in id and text count once; rows that only share a ``doc_id`` are kept or dropped each by its
own text; ids of any type that has an order; other columns stay, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import frugal, lookup_join, materialize, mix64
from varloom.llm import simhash
from varloom.llm.simhash import _majority, _shingle_hashes, components, keep_one, tag
from varloom.session import ship

WIDTH = 5
BANDS, ROWS = 20, 4
_CHUNK = 4096
_odd = np.random.default_rng(80).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT, _FOLD = _odd[0], _odd[1].reshape(BANDS, ROWS)


def _hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    parts = [np.array(p, np.uint64) for p in _shingle_hashes(text, width)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    return np.unique(_hashes(text, width))


def bands(s: np.ndarray) -> np.ndarray:
    """The band keys of a shingle set; sets that agree in a band's four min-hashes share its key."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(s), _CHUNK):
        np.minimum(low, (s[a : a + _CHUNK, None] * _MULT).min(0), out=low)
    return mix64((low.reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, size, keys, fps = [], [], [], []
        for t in b.column(2).cast(pa.binary()):
            h = _hashes(t.as_py())
            fps.append(_majority(h, np.array([0, len(h)])))
            s = np.unique(h)
            node.append(_node(s))
            size.append(len(s))
            keys.append(bands(s).view(np.int64))
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        offs = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
        fp = pa.array(np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), fp, pa.ListArray.from_arrays(offs, flat)], ["row", "doc_id", "node", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [shingles(t.as_py()) for t in b.column(0).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in got], pa.int64()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], ["node", "s"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (cell, node, n) of cells with more than one node."""
    cols = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not cols:
        return
    cell, node, n = (np.concatenate(x) for x in zip(*cols, strict=True))
    del cols
    order = np.argsort(cell, kind="stable")
    same = cell[order][1:] == cell[order][:-1]
    at = order[np.append(same, False) | np.insert(same, 0, False)]
    yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(node[at]), pa.array(n[at])], ["cell", "node", "n"])


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, na, b, nb): each shingle set with the smallest one of its SimHash component."""
    comp = materialize(components(simhash.links(nodes.select("fp"))), "dedup-fp-comp")
    named = lookup_join(nodes.select("fp", "node", "n"), comp.withColumnRenamed("node", "fp"), ["fp"], salt=F.col("node")).withColumn("label", F.coalesce("label", "fp"))
    named = materialize(named.select("label", "node", "n"), "dedup-fp-named")
    first = materialize(named.groupBy("label").agg(F.min(F.struct("node", "n")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("label", F.col("f.node").alias("a"), F.col("f.n").alias("na")), "dedup-fp-first")
    return lookup_join(named, first, ["label"], "inner", salt=F.col("node")).where("a < node").select("a", "na", F.col("node").alias("b"), F.col("n").alias("nb"))


def links(tagged: DataFrame, rows: DataFrame, percent: int = 80, rows_per_task: int = 1_000_000) -> DataFrame:
    """Verified links (a, b) between shingle sets; ``tagged`` has the texts under the row keys of ``rows``."""
    spark = rows.sparkSession
    nodes = materialize(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("row").alias("row"), F.first("fp").alias("fp")), "dedup-nodes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-BANDS * nodes.count() // rows_per_task))
    keyed = nodes.select(F.explode("bands").alias("cell"), "node", "n").repartition(parts, "cell")
    multi = materialize(keyed.mapInArrow(frugal(_shared), "cell long, node long, n long"), "dedup-cells")
    a = multi.select("cell", F.col("node").alias("a"), F.col("n").alias("na"))
    b = multi.select("cell", F.col("node").alias("b"), F.col("n").alias("nb"))
    found = a.join(b, "cell").where("a < b").select("a", "na", "b", "nb").unionByName(_simhash_pairs(nodes))
    # sets whose sizes differ by more cannot be that similar
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = materialize(found.where(near).distinct(), "dedup-pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    need = materialize(nodes.join(asked, "node", "left_semi").select("row"), "dedup-need")
    texts = lookup_join(tagged.select("row", "text"), need, ["row"], "left_semi")
    sets = materialize(texts.select("text").mapInArrow(frugal(_sets), "node long, s array<long>").dropDuplicates(["node"]), "dedup-sets")
    j = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return j.withColumn("both", both).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Keep the document with the smallest id of each component of texts at ``percent`` similarity or more."""
    ship(docs.sparkSession)
    tagged = tag(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = materialize(tagged.select("row", "doc_id", "text").mapInArrow(frugal(_sketch), f"row long, doc_id {id_type}, node long, n long, fp long, bands array<long>"), "dedup-rows")
    comp = materialize(components(links(tagged, rows, percent)), "dedup-comp")
    named = lookup_join(rows.select("row", "doc_id", "node"), comp, ["node"], salt=F.col("row"))
    return keep_one(tagged, materialize(named.select("row", "doc_id", F.coalesce("label", "node").alias("component")), "dedup-named"))
