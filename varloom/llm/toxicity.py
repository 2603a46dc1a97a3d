"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are words (letters, digits and all non-ASCII bytes, A-Z lower-cased). A token's log-odds come from
hierarchical Dirichlet priors: the toxic share at a word is shrunk to that of its 6-byte prefix, that to
its 5-byte and 4-byte prefixes, and that to the base rate, with ``c`` pseudo-counts at each step, so unseen
words with a known stem still score. Each token scores its log-odds less ``drift``; the Ruzzo-Tompa linear
scan finds every maximal scoring segment of a text. Scores are calibrated by extreme-value theory: lambda
solves sum p_i exp(lambda s_i) = 1 over clean training tokens, K fits the clean documents' best segments to
a Gumbel law, and lambda S - ln(K n) of the best segment and of the sum of significant segments give
the probability through a logistic curve that is fitted on held-back halves of the training rows.

The model is fitted on a bounded sample of labelled training rows (``max_docs`` rows and ``max_bytes`` of
text by id hash); copies in it count once. Scoring reads whole texts and broadcasts only the fitted table
(bounded by the sample). Inputs of a score are the text alone.

Edge cases: null, empty and word-free texts score the base rate; with no labelled rows every
score is 0.1, so that a filter drops nothing unseen; labels other than 0/1 and null labels are ignored;
repeated label rows of one document: the largest label counts; repeated documents give repeated rows;
a null ``doc_id`` is hashed as the empty text and can't have a label; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import crc_fold, cuts, fit_in_task, frugal, lut, row_chunks, run_hashes, spans, text_rows, within
from varloom.session import ship

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LUT = lut(_WORD)
PREFIXES = (4, 5, 6)
CHUNK = 1 << 20
UNTAUGHT = math.log(0.1 / 0.9)  # log-odds of every text when no label is known
_BITS = 20
_MASK = np.uint64((1 << _BITS) - 1)


@dataclass
class Tokens:
    """Words of some texts with the hashes of their prefixes and of the words themselves."""

    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    levels: list[np.ndarray]  # one hash per prefix length, then the word's; 0 where the word is shorter

    @classmethod
    def of(cls, data: np.ndarray, offs: np.ndarray) -> Tokens:
        c = _LUT[data]
        starts, ends, doc = spans(c, offs)
        word, *stems = run_hashes(c, starts, ends, *(np.minimum(starts + p, ends) for p in PREFIXES))
        for k, (p, x) in enumerate(zip(PREFIXES, stems, strict=True)):
            x ^= np.uint64(k + 1)
            x[ends - starts < p] = 0
        return cls(doc, starts, ends, [*stems, word])


@dataclass
class Model:
    """Feature hashes with their scores, and the calibration."""

    base: float = 0.5
    drift: float = 0.5
    keys: list[np.ndarray] = field(default_factory=list)  # by level, sorted
    scores: list[np.ndarray] = field(default_factory=list)
    lam: float = 1.0
    log_k: float = 0.0
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)
    _seen: list[np.ndarray] | None = None

    def token_scores(self, t: Tokens) -> np.ndarray:
        """Score of each token: that of its longest known stem, else the background's."""
        out = np.full(len(t.doc), -self.drift)
        if not self.keys:
            return out
        if self._seen is None:
            self._seen = []
            for k in self.keys:
                f = np.zeros(1 << _BITS, bool)
                f[(k & _MASK).astype(np.int64)] = True
                self._seen.append(f)
        for keys, scores, seen, h in zip(self.keys, self.scores, self._seen, t.levels, strict=True):
            if not len(keys):
                continue
            at = np.flatnonzero(seen[(h & _MASK).astype(np.int64)])
            p = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            ok = keys[p] == h[at]
            out[at[ok]] = scores[p[ok]]
        return out

    def statistic(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """Extreme-value statistics of a text of n words: best segment, and sum over significant ones."""
        if not segments:
            return 0.0, 0.0
        cost = self.log_k + math.log(n)
        zs = [self.lam * x[2] - cost for x in segments]
        return max(max(zs), 0.0), math.log1p(sum(z for z in zs if z > 0))

    def probability(self, z: tuple[float, float]) -> float:
        a = self.coef[0] + self.coef[1] * z[0] + self.coef[2] * z[1]
        return 1 / (1 + math.exp(-min(max(a, -40.0), 40.0)))


def merge_segments(tokens: Iterator[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by the Ruzzo-Tompa scan over the positive tokens only.

    A token is (position, sum of scores before it, sum after it): runs of negative scores are skipped through the
    sums. The scan stays linear, as each segment is merged at most once.
    """
    found: list[list[float]] = []  # [start, end, left sum, right sum, last one with a smaller left sum]
    for p, before, after in tokens:
        cur = [p, p + 1, before, after]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= cur[3]:
                cur.append(j)
                found.append(cur)
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3]]
            del found[j:]
    return [(int(s[0]), int(s[1]), float(s[3] - s[2])) for s in found]


def segments_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """The maximal scoring segments of a sequence."""
    pos = np.flatnonzero(scores > 0)
    if not len(pos):
        return []
    cum = np.concatenate([[0.0], np.cumsum(scores)])
    return merge_segments(zip(pos.tolist(), cum[pos].tolist(), cum[pos + 1].tolist(), strict=True))


def doc_segments(model: Model, t: Tokens, rows: int) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(words, segments) of each text."""
    s = model.token_scores(t)
    cut = np.searchsorted(t.doc, np.arange(rows + 1))
    has = np.zeros(rows, bool)
    has[t.doc[s > 0]] = True
    for i in range(rows):
        a, b = int(cut[i]), int(cut[i + 1])
        yield b - a, (segments_of(s[a:b]) if has[i] else [])


def long_segments(model: Model, data: np.ndarray, size: int = CHUNK) -> tuple[int, list[tuple[int, int, float]], dict[int, tuple[int, int]]]:
    """Words and segments of one text, a megabyte at a time, and the byte range of each positive word."""
    n, total = 0, 0.0
    at: dict[int, tuple[int, int]] = {}

    def tokens() -> Iterator[tuple[int, float, float]]:
        nonlocal n, total
        for a, b in cuts(_WORD, data, size):
            t = Tokens.of(data[a:b], np.array([0, b - a]))
            s = model.token_scores(t)
            cum = total + np.concatenate([[0.0], np.cumsum(s)])
            for p in np.flatnonzero(s > 0).tolist():
                at[n + p] = a + int(t.starts[p]), a + int(t.ends[p])
                yield n + p, float(cum[p]), float(cum[p + 1])
            n, total = n + len(s), float(cum[-1])

    found = merge_segments(tokens())
    return n, found, at


def text_segments(model: Model, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float, int, int]]]]:
    """(words, segments with their byte range in ``data``) of each text of a batch."""
    for lo, hi in row_chunks(offs, CHUNK):
        base, part = int(offs[lo]), data[offs[lo] : offs[hi]]
        if hi - lo == 1 and len(part) > CHUNK:
            n, found, at = long_segments(model, part)
            yield n, [(a, z, s, base + at[a][0], base + at[z - 1][1]) for a, z, s in found]
            continue
        t = Tokens.of(part, offs[lo : hi + 1] - offs[lo])
        cut = np.searchsorted(t.doc, np.arange(hi - lo + 1)).tolist()
        for i, (n, found) in enumerate(doc_segments(model, t, hi - lo)):
            yield n, [(a, z, s, base + int(t.starts[cut[i] + a]), base + int(t.ends[cut[i] + z - 1])) for a, z, s in found]


# fitting
def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, end row, tokens) of bounded runs of texts: no array of the whole sample's tokens is held."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts[lo:hi]])]).astype(np.int64)
        yield lo, hi, Tokens.of(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offs)
        lo = hi


@dataclass
class _Pairs:
    """Each word of each document once, and two smallest word-triple hashes of each document."""

    doc: np.ndarray
    levels: list[np.ndarray]
    low: np.ndarray  # (documents, 2), 0 for documents without words


def _distinct(texts: list[bytes]) -> _Pairs:
    docs, levels, low = [], [[] for _ in range(len(PREFIXES) + 1)], np.zeros((len(texts), 2), np.uint64)
    for lo, hi, t in _chunks(texts):
        w = t.levels[-1]
        if not len(w):
            continue
        # hashed, as sorting pairs of numbers would take twice the memory
        _, first = np.unique(w * np.uint64(0x9E3779B97F4A7C15) + t.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)
        docs.append((t.doc[first] + lo).astype(np.int32))
        for k, x in enumerate(t.levels):
            levels[k].append(x[first])
        tri = w.copy()
        tri[:-1] = w[:-1] * np.uint64(3) + w[1:] * np.uint64(0x9E3779B97F4A7C15)
        full = np.unique(t.doc)
        for j, salt in enumerate((0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)):
            low[lo + full, j] = np.minimum.reduceat((tri ^ (tri >> np.uint64(31))) * np.uint64(salt), np.searchsorted(t.doc, full))
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return _Pairs(cat(docs, np.int32), [cat(x, np.uint64) for x in levels], low)


def _one_of_copies(low: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One document of each group with the same label and the same smallest word-triple hash (two hashes)."""
    keep = np.ones(len(y), bool)
    full = np.flatnonzero(low.any(1))
    for j in range(2):
        _, first = np.unique(low[full, j] * np.uint64(2) + y[full].astype(np.uint64), return_index=True)
        mine = np.ones(len(y), bool)
        mine[full] = False
        mine[full[first]] = True
        keep &= mine
    return keep


def _stems(t: _Pairs, y: np.ndarray, use: np.ndarray, c: float, drift: float, least: int, sure: float = 2.5) -> Model:
    base = float((y[use].sum() + 0.5) / (use.sum() + 1.0)) if use.any() else 0.5
    model = Model(base=base, drift=drift)
    at = np.flatnonzero(use[t.doc])
    doc = t.doc[at]
    toxic = y[doc] == 1
    r0 = (int(toxic.sum()) + 0.5) / (len(at) + 1.0)
    odds0 = math.log(r0 / (1 - r0))
    parent = np.full(len(at), r0)
    alive = np.zeros(len(at), bool)  # some shorter stem is kept
    for level in t.levels:
        h = level[at]
        some = np.flatnonzero(h)
        keys, inv = np.unique(h[some], return_inverse=True)
        if not len(keys):
            model.keys.append(keys)
            model.scores.append(np.zeros(0))
            continue
        # documents, not tokens, are counted: one text's repetitions are no evidence
        pair = np.unique(inv.astype(np.int64) * (len(y) + 1) + doc[some])
        k_of = pair // (len(y) + 1)
        n = np.bincount(k_of, minlength=len(keys)).astype(float)
        tox = np.bincount(k_of[y[pair % (len(y) + 1)] == 1], minlength=len(keys)).astype(float)
        up = np.zeros(len(keys))
        up[inv] = parent[some]
        r = (tox + c * up) / (n + c)
        # the score uses the lower posterior bound, so that chance finds in few documents don't score
        low = np.maximum(r - sure * np.sqrt(r * (1 - r) / (n + c + 1)), 1e-6)
        score = np.log(low / (1 - low)) - odds0 - drift
        under = np.zeros(len(keys), bool)
        under[inv] = alive[some]
        keep = ((tox >= least) & (score > 0)) | (under & (n >= 2))
        parent[some] = r[inv]
        alive[some] |= keep[inv]
        model.keys.append(keys[keep])
        model.scores.append(score[keep])
    return model


def _extreme_values(model: Model, texts: list[bytes], clean: np.ndarray) -> None:
    """lambda and K of the model from clean documents (Karlin-Altschul)."""
    top = max((float(x.max()) for x in model.scores if len(x)), default=1.0)
    seen: dict[float, int] = {round(max(top, 0.1), 3): 1}
    runs: list[tuple[float, int]] = []
    mine = [texts[i] for i in np.flatnonzero(clean).tolist()]
    for lo, hi, t in _chunks(mine):
        s = model.token_scores(t)
        for v, n in zip(*np.unique(np.round(s, 3), return_counts=True), strict=True):
            seen[float(v)] = seen.get(float(v), 0) + int(n)
        cut = np.searchsorted(t.doc, np.arange(hi - lo + 1))
        for i in np.unique(t.doc[s > 0]).tolist():
            a, b = int(cut[i]), int(cut[i + 1])
            runs.append((max(x[2] for x in segments_of(s[a:b])), b - a))
    vals = np.array(sorted(seen))
    p = np.array([seen[v] for v in vals.tolist()], float)
    p /= p.sum()
    lo, hi = 1e-3, 5.0
    if (p * vals).sum() < 0:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * vals, 500.0))).sum() < 1 else (lo, mid)
        model.lam = lo
    best = [model.lam * s - math.log(n) for s, n in runs]
    model.log_k = float(np.mean(best) - 0.5772) if len(best) >= 10 else math.log(0.1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Ridge logistic regression on two statistics whose weights must not be negative."""
    w = np.zeros(3)
    a = np.column_stack([np.ones(len(x)), x])
    use = np.array([True, True, True])
    for _ in range(3):
        w[:] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            g = a[:, use].T @ (p - y) + ridge * w[use]
            h = (a[:, use] * (p * (1 - p))[:, None]).T @ a[:, use] + ridge * np.eye(use.sum())
            d = np.linalg.solve(h, g)
            w[use] -= np.clip(d, -5, 5)
            if np.abs(d).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            break
        use &= np.array([True, *(w[1:] >= 0)])
    return tuple(float(v) for v in w)


def _statistics(model: Model, texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), 2))
    for lo, hi, t in _chunks(texts):
        out[lo:hi] = [model.statistic(seg, n) for n, seg in doc_segments(model, t, hi - lo)]
    return out


def fit_texts(texts: list[bytes], labels: np.ndarray, c: float = 5.0, drift: float = 0.5, least: int = 3) -> Model:
    """A model from training texts and 0/1 labels."""
    y = np.asarray(labels).astype(int)
    if len(y) == 0:
        return Model(coef=(UNTAUGHT, 0.0, 0.0))
    t = _distinct(texts)
    use = _one_of_copies(t.low, y)
    half = np.random.default_rng(7).permutation(len(y)) % 2 == 0
    stats = np.zeros((len(y), 2))
    for side in (half, ~half):
        m = _stems(t, y, use & side, c, drift, least)
        _extreme_values(m, texts, use & side & (y == 0))
        stats[~side] = _statistics(m, [texts[i] for i in np.flatnonzero(~side).tolist()])
    model = _stems(t, y, use, c, drift, least)
    _extreme_values(model, texts, use & (y == 0))
    # the rows that repeat calibrate once, like the rows that fitted the stems
    model.coef = _logistic(stats[use], y[use].astype(float))
    model._seen = None
    return model


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_docs: int = 8_000, max_bytes: int = 48 << 20) -> DataFrame:
    """(doc_id, text, y): at most about max_docs labelled training rows and max_bytes of their text, chosen by id hash."""
    y = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 5) != 0))
    y = y.select("doc_id", F.col(label_col).cast("int").alias("y"))
    grain = 1 << 30
    n = y.count()
    cut = grain if n <= max_docs else int(grain * max_docs / n)
    few = y.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(grain)) < cut).groupBy("doc_id").agg(F.max("y").alias("y"))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return within(text.join(F.broadcast(few), "doc_id").distinct(), max_bytes)


def fit(docs: DataFrame, labels: DataFrame, **sample) -> Model:
    ship(docs.sparkSession)

    def run(rows: list[tuple]) -> Model:
        return fit_texts([r[1] for r in rows], np.array([r[2] for r in rows]))

    return fit_in_task(training_sample(docs, labels, **sample), run) or fit_texts([], np.zeros(0))


# scoring
def _score(model: Model, arr: pa.Array) -> np.ndarray:
    return np.array([model.probability(model.statistic(seg, n)) for n, seg in text_segments(model, *text_rows(arr))], float)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every document."""
    ship(docs.sparkSession)
    b_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_score(b_model.value, b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, last_word, score, e_value, passage of every significant toxic segment (E-value below 1)."""
    ship(docs.sparkSession)
    b_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b_model.value
            data, offs = text_rows(b.column(1))
            rows, first, last, sc, ev, text = [], [], [], [], [], []
            for i, (n, seg) in enumerate(text_segments(m, data, offs)):
                for a, z, s, x, y in seg:
                    e = math.exp(min(m.log_k + math.log(n) - m.lam * s, 700.0))
                    if e < 1:
                        for held, v in zip((rows, first, last, sc, ev, text), (i, a, z - 1, s, e, data[x:y].tobytes().decode()), strict=True):
                            held.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(sc, pa.float64()), pa.array(ev, pa.float64()), pa.array(text, pa.string())], ["doc_id", "first_word", "last_word", "score", "e_value", "passage"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, first_word long, last_word long, score double, e_value double, passage string")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Documents whose score is below the threshold, with their columns as they are."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_score(model.value, b.column(at)) < threshold))

    return docs.mapInArrow(frugal(run), docs.schema)
