"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The mix is a row of slots, each one block of ``block`` words. Slot ``t`` gets the golden-ratio point
frac((t + 1) * phi) (in exact 31-bit integer arithmetic), which falls into one source's interval of the
cumulative targets. A source's stream is its documents in the order of md5(doc_id), repeated end to end and cut
into equal blocks up to its target; the blocks are shuffled by md5(seed, source, block), and the k-th slot of the
source holds the k-th of them. What a document gives is what lies in the blocks that slots hold. Points stay within
O(log N) slots of every target; slots past a source's target are dropped and the few missing blocks follow at the
end, so a source's words taken are its target rounded down. Targets are ``min(3 * size, lambda * weight)``, the
fixed point of capping at three times the size and resharing the excess by weight; so no document is taken more
than three times.

``mix`` counts words per document; ``mixed_text`` makes the mix: its rows, in order of (slot, at), are the training
stream, and the pieces of one copy of a document add up to its whole text.

All steps but the cutting of texts are DataFrame operations: positions in a stream and ranks of blocks are prefix
sums over md5 buckets and then within a bucket, slots are ranked per (source, run of slots) and then summed, slots
find their source through a grid of the unit interval (an equality join), and pieces meet slots by (source, block),
so a source with a third of all rows is spread over many groups. Per-source tables have one row a source and are
the only unpartitioned windows.

Edge cases: a null or blank text has size 0 and takes 0; a null source is a source of its own, last in
order; sources without words have target 0; documents that repeat are separate rows of the stream; a
null ``doc_id`` is ordered as the empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.llm.common import frugal, lookup_join, materialize
from varloom.session import ship

BLOCK = 256
MAX_EPOCHS = 3
GOLD, RING = 1327217885, 1 << 31  # GOLD / RING is the golden ratio's fraction, GOLD is odd
GRID = 4096
RUN = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, pos, source_size, target for (source, size) rows; ``weights`` repeat over the sources in code-point order."""
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("pos", F.row_number().over(order) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "pos")
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double"))
    s = s.withColumn("lam", (F.col("total") - F.col("before")) / F.col("left"))
    # the first source, in order of cap / weight, whose cap isn't reached sets lambda for all after it
    s = s.withColumn("lam", F.min(F.when(F.col("cap") >= F.col("lam") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "pos", "lam"))).over(W.partitionBy())["lam"])
    return s.select("source", "pos", "source_size", F.least("cap", F.col("lam") * F.col("w")).alias("target"))


def _ranked(rows: DataFrame, group: str, key: Column, order: list[str], size: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows of the group that come before, in order of md5 ``key``."""
    rows = rows.withColumn("_key", key).withColumn("_b", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")).withColumn("_n", size)
    sums = rows.groupBy(group, "_b").agg(F.sum("_n").alias("_n"))
    sums = sums.select(group, "_b", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum("_n").over(W.partitionBy(group, "_b").orderBy("_key", *order).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    # the rows are partitioned and sorted like that already: a merge costs no shuffle of theirs
    return rows.withColumn("_in", inside).join(sums.hint("merge"), [group, "_b"]).withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_key", "_b", "_n", "_base", "_in")


def _named(source: Column) -> Column:
    """The source as a name that tells null from text."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def streams(sizes: DataFrame, seed: str = "") -> DataFrame:
    """Adds ``cum``, the first word of each (doc_id, source, size) row in its source's stream."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return _ranked(sizes.withColumn("_s", _named(F.col("source"))), "_s", key, ["doc_id", "size"], F.col("size"), "cum").drop("_s")


def schedule(target: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, pos, rank: the source of every slot and the number of the block of its stream that it holds."""
    spark = target.sparkSession
    t = target.select("pos", "target").withColumn("want", F.floor(F.col("target") + 1e-6).cast("long"))
    total = t.agg(F.sum("want")).first()[0] or 0
    n = -(-total // block)
    edge = F.sum("target").over(W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    all_ = F.sum("target").over(W.partitionBy())
    bounds = t.where("target > 0").withColumn("hi", F.floor(edge / all_ * RING + 0.5).cast("long")).withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("pos")), F.lit(0)))
    width = RING // GRID
    cells = bounds.where("hi > lo").select("pos", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    grid = materialize(cells.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "pos"))).alias("parts")), "mix-grid")
    slots = spark.range(0, n).select(F.col("id").alias("slot"), F.pmod((F.pmod(F.col("id") + 1, F.lit(RING)) * F.lit(GOLD)), F.lit(RING)).alias("u"))
    slots = lookup_join(slots.withColumn("cell", F.floor(F.col("u") / width)), grid, ["cell"], "inner", salt=F.col("slot"))
    slots = slots.select("slot", F.filter("parts", lambda p: (p["lo"] <= F.col("u")) & (F.col("u") < p["hi"]))[0]["pos"].alias("pos"), F.floor(F.col("slot") / RUN).alias("run"))
    slots = materialize(slots, "mix-slots")
    runs = slots.groupBy("pos", "run").count()
    runs = runs.select("pos", "run", F.coalesce(F.sum("count").over(W.partitionBy("pos").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = slots.withColumn("k", F.row_number().over(W.partitionBy("pos", "run").orderBy("slot")) - 1).join(runs, ["pos", "run"]).select("slot", "pos", (F.col("base") + F.col("k")).cast("long").alias("rank"))
    blocks = t.select("pos", F.ceil(F.col("want") / block).cast("long").alias("blocks"))
    kept = lookup_join(ranked, blocks.where("blocks > 0"), ["pos"], "inner", salt=F.col("slot")).where("rank < blocks").drop("blocks")
    have = slots.groupBy("pos").count()
    short = blocks.join(have, "pos", "left").withColumn("have", F.coalesce("count", F.lit(0))).where("blocks > have")
    tail = short.select("pos", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("rank"))
    tail = tail.select((F.row_number().over(W.orderBy("rank", "pos")) - 1 + n).cast("long").alias("slot"), "pos", F.col("rank").cast("long").alias("rank"))
    return kept.select("slot", "pos", "rank").unionByName(tail)


def shuffled(target: DataFrame, block: int = BLOCK, seed: str = "") -> DataFrame:
    """pos, block, rank: every block of a source's stream up to its target, in shuffled order."""
    n = F.ceil(F.floor(F.col("target") + 1e-6) / block).cast("long")
    runs = target.select("pos", n.alias("n")).where("n > 0").select("pos", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    parts = max(1, int(target.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = runs.repartition(parts, "pos", "run").select("pos", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)).alias("block"))
    key = F.md5(F.concat(F.lit(seed), F.col("pos").cast("string"), F.lit(":"), F.col("block").cast("string")).cast("binary"))
    return _ranked(blocks.select("pos", F.col("block").cast("long").alias("block")), "pos", key, ["block"], F.lit(1), "rank")


def placed(target: DataFrame, block: int = BLOCK, seed: str = "") -> DataFrame:
    """pos, block, slot: where in the mix each block of a source's stream stands."""
    return schedule(target, block).join(shuffled(target, block, seed).hint("merge"), ["pos", "rank"]).select("pos", "block", "slot")


def _with_target(rows: DataFrame, target: DataFrame) -> DataFrame:
    want = F.floor(F.col("target") + 1e-6).cast("long")
    return lookup_join(rows.withColumn("_s", _named(F.col("source"))), target.withColumn("_s", _named(F.col("source"))).drop("source"), ["_s"], "inner", salt=F.col("cum")).withColumn("want", want).drop("_s")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """pos, cum, block, words: what each row(pos, cum, size, source_size, want) of a stream lays into its blocks, copy by copy."""
    d = rows.where("size > 0 and want > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("want") - 1) / F.col("source_size")))))
    d = d.withColumn("a", F.col("cum") + F.col("copy") * F.col("source_size")).withColumn("z", F.least(F.col("a") + F.col("size"), F.col("want"))).where("a < z")
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block))))
    words = F.least("z", (F.col("block") + 1) * block) - F.greatest("a", F.col("block") * block)
    return d.select("pos", "cum", F.col("block").cast("long").alias("block"), words.cast("long").alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), block: int = BLOCK, seed: str = "") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words in the slots that it fills), first_slot (null if none)."""
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    target = materialize(targets(sizes, weights), "mix-targets")
    rows = materialize(_with_target(streams(sizes, seed), target), "mix-rows")
    # tables that grow with the documents: never broadcast, whatever their compressed files weigh
    got = pieces(rows, block).join(placed(target, block, seed).hint("merge"), ["pos", "block"]).groupBy("pos", "cum").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    # rows without words share their place in the stream with the next one
    out = rows.withColumn("_at", F.when(F.col("size") > 0, F.col("cum"))).join(got.withColumnRenamed("cum", "_at").hint("merge"), ["pos", "_at"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_OUT_BYTES = 4 << 20


def _cut(block: int):
    """Texts into the pieces that they lay into blocks; the white space after a word goes with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pos", "block", "at", "start", "words", "text", "doc_id", "source"]
        for b in batches:
            out: list[tuple] = []
            rows: list[int] = []
            held = 0
            ids, sources = b.column(0), b.column(1)

            def batch():
                cols = list(zip(*out, strict=True))
                take = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string()), ids.take(take), sources.take(take)], names)  # noqa: B023

            for i in range(b.num_rows):
                raw = b.column(2).slice(i, 1).cast(pa.binary())[0].as_py()
                pos, size, cum, source_size, want = (b.column(k)[i].as_py() for k in range(3, 8))
                gap = _GAP[np.frombuffer(raw, np.uint8)]
                first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
                edge = np.concatenate([[0], first[1:], [len(raw)]])
                for copy in range((want - 1) // source_size + 1):
                    a = cum + copy * source_size
                    z = min(a + size, want)
                    while a < z:
                        e = min(z, (a // block + 1) * block)
                        s = a - cum - copy * source_size
                        t = raw[edge[s] : edge[s + e - a]]
                        out.append((pos, a // block, a, s, e - a, t.decode()))
                        rows.append(i)
                        held += len(t) + 64
                        a = e
                        if held > _OUT_BYTES:
                            yield batch()
                            out, rows, held = [], [], 0
            if out:
                yield batch()

    return run


def mixed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), block: int = BLOCK, seed: str = "") -> DataFrame:
    """The mix: slot, at (place in the source's stream, which orders a slot's pieces), source, doc_id, start (first word), words, text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), word_count(F.col(text_col)).alias("size"))
    sizes = materialize(rows.select("doc_id", "source", "size"), "mix-sizes")
    target = materialize(targets(sizes, weights), "mix-targets")
    placed_rows = _with_target(streams(rows, seed), target).where("size > 0 and want > 0")
    id_type, source_type = docs.schema[id_col].dataType.simpleString(), docs.schema[source_col].dataType.simpleString()
    parts = placed_rows.select("doc_id", "source", "text", "pos", "size", "cum", "source_size", "want").mapInArrow(frugal(_cut(block)), f"pos long, block long, at long, start long, words long, text string, doc_id {id_type}, source {source_type}")
    plan = materialize(placed(target, block, seed), "mix-plan")
    return parts.join(plan.hint("merge"), ["pos", "block"]).select("slot", "at", "source", "doc_id", "start", "words", "text")
