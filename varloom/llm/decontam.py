"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, verified hits, span removal.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is ``n``
consecutive words of a benchmark item (a shorter, non-empty item is one window). Documents are scanned
as bytes: word hashes from one prefix sum, a vocabulary test, window hashes only inside runs of known
words, and a comparison of the words themselves for every hash hit; a text is read a megabyte at a time, whatever
its length. The benchmark is packed into blocks of at most ``block_bytes`` of text, in flat arrays of about ten times
that; each is one broadcast, and a worker holds one block at a time, so the broadcast has a bound whatever the
benchmark's size.

Edge cases: null and word-free texts have no words and no hits; an item without words has no window;
items with the same id count once; a null item id is the empty string; a null ``doc_id`` stays a row;
repeated rows give repeated result rows; empty tables give empty results (or no hits); other columns
are ignored by ``scan`` and returned unchanged by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import cuts, frugal, lut, row_chunks, run_hashes, spans, text_rows
from varloom.session import ship

_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x41] = _WORD[0x5B:0x61] = _WORD[0x7B:0x80] = False
_LUT = lut(_WORD)
CHUNK = 1 << 20
BLOCK_BYTES = 4 << 20
_STEP, _STEP2 = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)


def item_words(text: str | None) -> list[bytes]:
    return _LUT[np.frombuffer((text or "").encode(), np.uint8)].tobytes().replace(b"\0", b" ").split()


class Windows:
    """The windows of one block of benchmark items in flat arrays: about ten times its text, whatever the items.

    ``buf`` has all words, space-joined; a window is named by its first word. Equal windows are one group (two
    64-bit hashes) with a list of item numbers.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        """``items``: (id, words); no words, no window."""
        items = [x for x in items if x[1]]
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        count = np.array([len(w) for _, w in items], np.int64)
        first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        size = np.fromiter((len(x) for _, w in items for x in w), np.int64, int(first[-1]))
        self.buf = b" ".join(x for _, w in items for x in w)
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        wh = run_hashes(np.frombuffer(self.buf, np.uint8), self.starts, self.ends)[0]
        self.vocab = np.unique(wh)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocab & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        item = np.array([number[i] for i, _ in items], np.int32)
        self.by_len: dict[int, tuple[np.ndarray, ...]] = {}
        for width in sorted({min(n, int(c)) for c in count}):
            full = np.flatnonzero(count >= n if width == n else count == width)
            many = count[full] - width + 1
            at = np.repeat(first[full] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            h, h2 = (self.hash_window([wh[at + k] for k in range(width)], step) for step in (_STEP, _STEP2))
            owner = np.repeat(item[full], many)
            order = np.lexsort((owner, h2, h))
            at, h, h2, owner = at[order], h[order], h2[order], owner[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
            keep = new | np.concatenate([[True], owner[1:] != owner[:-1]])
            group = np.flatnonzero(new)
            # group: its hash, a first word, and its items
            self.by_len[width] = (h[group], at[group], np.append(np.cumsum(keep)[group] - 1, keep.sum()), owner[keep])

    @property
    def nbytes(self) -> int:
        return len(self.buf) + sum(x.nbytes for x in (self.starts, self.ends, self.vocab, self.filter)) + sum(x.nbytes for t in self.by_len.values() for x in t)

    @staticmethod
    def hash_window(cols, step=_STEP) -> np.ndarray:
        h = np.zeros(len(cols[0]), np.uint64)
        for c in cols:
            h = (h ^ c) * step
        return h ^ (h >> np.uint64(31))


def _scan(data: np.ndarray, offs: np.ndarray, blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Start, end, row and hit of every word of some texts, and the items found in each text."""
    cls = _LUT[data]
    starts, ends, doc = spans(cls, offs)
    items: list[set[str]] = [set() for _ in range(len(offs) - 1)]
    hit = np.zeros(len(starts), bool)
    if len(starts):
        wh = run_hashes(cls, starts, ends)[0]
        for blk in blocks:
            win: Windows = blk if isinstance(blk, Windows) else blk.value
            if len(win.vocab):
                _mark(win, cls, starts, ends, doc, wh, hit, items)
            if not isinstance(blk, Windows) and len(blocks) > 1:
                blk.__dict__.pop("_value", None)  # one block in memory at a time
    return starts, ends, doc, hit, items


def _ranges(starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of runs of hit words."""
    at = np.flatnonzero(hit)
    return [(int(starts[r[0]]), int(ends[r[-1]])) for r in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)] if len(at) else []


def scan_text(data: np.ndarray, blocks: list, n: int = 10, size: int = CHUNK) -> tuple[int, int, set[str], list[tuple[int, int]]]:
    """Words, hit words, found items and hit byte ranges of one text of any length, ``size`` bytes at a time."""
    words = hits = 0
    found: set[str] = set()
    ranges: list[tuple[int, int]] = []
    carry = np.zeros(0, bool)
    for a, b in cuts(_WORD, data, size):
        # windows that begin here may end in the next n - 1 words
        e, ahead = b, 4096
        while n > 1 and e < len(data):
            e = min(b + ahead, len(data))
            if e < len(data):  # whole words only
                gap = np.flatnonzero(~_WORD[data[b:e]])
                e = b + int(gap[-1]) + 1 if len(gap) else b
            if e == len(data) or len(spans(_LUT[data[b:e]], np.array([0, e - b]))[0]) >= n - 1:
                break
            ahead *= 4
        starts, ends, _, hit, items = _scan(data[a:e], np.array([0, e - a]), blocks)
        mine = int(np.searchsorted(starts, b - a))
        hit[: len(carry)] |= carry[: len(hit)]
        carry = hit[mine:]
        words += mine
        hits += int(hit[:mine].sum())
        found |= items[0]
        for x, y in _ranges(starts[:mine] + a, ends[:mine] + a, hit[:mine]):
            if ranges and not _WORD[data[ranges[-1][1] : x]].any():
                x = ranges.pop()[0]
            ranges.append((x, y))
    return words, hits, found, ranges


def scan_bytes(data: np.ndarray, offs: np.ndarray, blocks: list, n: int = 10) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words, hit words and found items of each text."""
    rows = len(offs) - 1
    if rows == 1 and len(data) > CHUNK:
        w, h, items, _ = scan_text(data, blocks, n)
        return np.array([w]), np.array([h]), [items]
    _, _, doc, hit, items = _scan(data, offs, blocks)
    return np.bincount(doc, minlength=rows), np.bincount(doc[hit], minlength=rows), items


def _mark(win: Windows, cls, starts, ends, doc, wh, hit, items) -> None:
    maybe = np.flatnonzero(win.filter[(wh & np.uint64((1 << 20) - 1)).astype(np.int64)])
    pos = np.searchsorted(win.vocab, wh[maybe])
    known = maybe[win.vocab[np.minimum(pos, len(win.vocab) - 1)] == wh[maybe]]
    if not len(known):
        return
    # the run of known words of one document that each known word stands in
    brk = np.flatnonzero((np.diff(known) > 1) | (np.diff(doc[known]) > 0))
    run_end = known[np.append(brk, len(known) - 1)] + 1
    left = run_end[np.searchsorted(np.append(brk, len(known) - 1), np.arange(len(known)))] - known
    for size, (keys, at_word, lo, owner) in win.by_len.items():
        at = known[left >= size]
        if not len(at):
            continue
        h = win.hash_window([wh[at + k] for k in range(size)])
        p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        ok = keys[p] == h
        for i, g in zip(at[ok].tolist(), p[ok].tolist(), strict=True):
            words = b" ".join(cls[a:b].tobytes() for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True))
            key = keys[g]
            while g < len(keys) and keys[g] == key:  # windows whose first hashes clash stand side by side
                w = int(at_word[g])
                if win.buf[win.starts[w] : win.ends[w + size - 1]] == words:
                    hit[i : i + size] = True
                    items[doc[i]].update(win.names[k] for k in owner[lo[g] : lo[g + 1]].tolist())
                g += 1


def blocks_of(rows: Iterator[tuple[str, str | None]], n: int, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id, words) in blocks of at most ``block_bytes`` of words; a longer item goes in parts that overlap by n - 1 words."""
    held, room = [], block_bytes
    for item, text in rows:
        w = item_words(text)
        a = 0
        while a < len(w):
            z, used = a, 0
            while z < len(w) and (used < room or z < a + n):
                used += len(w[z]) + 1
                z += 1
            part = w[a:z] if a else w[:z]
            held.append((item, part))
            room -= used
            if room <= 0:
                yield held
                held, room = [], block_bytes
            if z == len(w):
                break
            a = z - n + 1
    if held:
        yield held


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES) -> list:
    """One broadcast of ``Windows`` for each block of benchmark text; the benchmark is read once, a partition at a time."""
    sc = benchmark.sparkSession.sparkContext
    b = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    return [sc.broadcast(Windows(items, n)) for items in blocks_of(((r.i, r.t) for r in b.toLocalIterator()), n, block_bytes)]


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings)."""
    ship(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, n=n, block_bytes=block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_rows(b.column(1))
            for lo, hi in row_chunks(offs, CHUNK):
                w, h, items = scan_bytes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], blocks, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(w, pa.int64()), pa.array(h, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["doc_id", "n_words", "n_hit", "n_items", "item_ids"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, n_items long, item_ids array<string>")


def clean_text(text: bytes, blocks: list, n: int = 10) -> tuple[bytes, float]:
    """A text without its hit spans, and the share of its words that were hit; repeated until no window is left."""
    share, first = 0.0, True
    while True:
        words, hits, _, ranges = scan_text(np.frombuffer(text, np.uint8), blocks, n)
        if first:
            share, first = (hits / words if words else 0.0), False
        if not hits:
            return text, share
        keep, at = [], 0
        for a, b in ranges:
            keep.append(text[at:a])
            at = b
        text = b"".join([*keep, text[at:]]).strip()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10, max_share: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out of the text (and ``n_chars`` is set anew);
    a document with more than ``max_share`` of its words hit, or with no text left, is removed."""
    ship(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, n=n, block_bytes=block_bytes)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_rows(b.column(at))
            for lo, hi in row_chunks(offs, CHUNK):
                part = b.slice(lo, hi - lo)
                _, h, _ = scan_bytes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], blocks, n)
                found = np.flatnonzero(h)
                if len(found):
                    texts, keep = part.column(at).to_pylist(), np.ones(hi - lo, bool)
                    for i in found.tolist():
                        t, share = clean_text(texts[i].encode(), blocks, n)
                        texts[i] = t.decode()
                        keep[i] = share <= max_share and bool(t)
                    cols = list(part.columns)
                    cols[at] = pa.array(texts, b.schema.field(at).type)
                    if "n_chars" in names and pa.types.is_integer(b.schema.field("n_chars").type):
                        c = names.index("n_chars")
                        old = cols[c].to_pylist()
                        for i in found.tolist():
                            old[i] = len(texts[i])
                        cols[c] = pa.array(old, b.schema.field(c).type)
                    part = pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep))
                yield part

    return docs.mapInArrow(frugal(run), docs.schema)


def digest(item_ids: list[str]) -> str:
    """What ``items_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()
