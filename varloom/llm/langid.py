"""Language ID by a byte-level convolutional network, trained and run in numpy.

Input is a window of ``WINDOW`` bytes. Bytes are embedded, filters of widths 2, 3 and 4 slide over them, each
filter is max-pooled over the window and rectified, and a softmax layer gives the language. Training is
by Adam on windows of a bounded sample of labelled rows (``max_docs`` rows and ``max_bytes`` of text, by id
hash); gradients pass through the pooled positions only. For prediction the convolution over byte embeddings
is tabulated per byte pair, exactly: width 4 is the sum of two pair lookups. A text of any length is cut into
consecutive windows, all of them are applied in batches, and their log-probabilities are averaged.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without any labelled training
row every text is ``und``; rows whose ``doc_id`` is null are predicted but teach nothing; with one language every text with a letter has it; null languages teach nothing;
repeated rows give repeated results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import crc_fold, fit_in_task, frugal, row_chunks, text_rows, within
from varloom.session import ship

WINDOW = 256
WIDTHS = (2, 3, 4)
PER_WIDTH = 8
EMBED = 8
FILTERS = len(WIDTHS) * PER_WIDTH
SPAN = max(WIDTHS)
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 20
_BATCH = 48  # windows at once in prediction: their filter maps stay in cache


def has_letter(text: str) -> bool:
    """Whether a character is a letter (a number such as one half is none)."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    langs: list[str]
    emb: np.ndarray  # (256, EMBED)
    conv: np.ndarray  # (SPAN, EMBED, FILTERS), zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray  # (FILTERS, languages)
    out_bias: np.ndarray
    _pairs: tuple[np.ndarray, np.ndarray] | None = None

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter sums of byte pairs at offsets 0-1 and 2-3, indexed by first + 256 * second."""
        if self._pairs is None:
            t = np.einsum("be,kef->kbf", self.emb, self.conv).astype(np.float32)
            join = lambda a, b: np.ascontiguousarray((t[a][None, :, :] + t[b][:, None, :]).reshape(65536, FILTERS))
            self._pairs = join(0, 1), join(2, 3)
        return self._pairs

    def window_logits(self, win: np.ndarray) -> np.ndarray:
        """Logits of windows (n, WINDOW + SPAN - 1) of bytes."""
        a, b = self.pairs()
        out = np.empty((len(win), FILTERS), np.float32)
        for i in range(0, len(win), _BATCH):
            w = win[i : i + _BATCH].astype(np.int32)
            two = w[:, :-1] + (w[:, 1:] << 8)
            z = a.take(two[:, :WINDOW], axis=0)
            z += b.take(two[:, 2 : WINDOW + 2], axis=0)
            n = WINDOW
            while n > 1:
                n //= 2
                z = np.maximum(z[:, :n], z[:, n : 2 * n])
            out[i : i + _BATCH] = z[:, 0]
        return np.maximum(out + self.bias, 0) @ self.out + self.out_bias


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All consecutive windows of each text, zero-padded at its end (with the bytes that follow a window, for
    filters that reach over its edge), and the row of each."""
    size = np.diff(offs)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    start = offs[row] + (np.arange(len(row)) - first[row]) * WINDOW
    idx = start[:, None] + np.arange(WINDOW + SPAN - 1)[None, :]
    padded = np.append(data, np.uint8(0))
    win = padded[np.minimum(idx, len(data))]
    win[idx >= offs[row + 1][:, None]] = 0
    return win, row


def _parts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and rows of some texts, of a long one a megabyte at a time."""
    if len(offs) > 2 or len(data) <= CHUNK:
        if len(data):
            yield windows_of(data, offs)
        return
    step = CHUNK // WINDOW * WINDOW
    for a in range(0, len(data), step):
        part = data[a : a + step + SPAN - 1]  # with the bytes that the last window's filters reach
        win, row = windows_of(part, np.array([0, len(part)]))
        k = -(-min(step, len(data) - a) // WINDOW)
        yield win[:k], row[:k]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_texts(texts: list[bytes], langs: list[str], epochs: int = 12, per_doc: int = 3, batch: int = 128, seed: int = 5) -> Model | None:
    """A network from training texts and their languages."""
    names = sorted({x for x in langs if x is not None})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    index = {x: i for i, x in enumerate(names)}
    xs, ys = [], []
    for t, lang in zip(texts, langs, strict=True):
        if lang is None or not t:
            continue
        d = np.frombuffer(t, np.uint8)
        win, _ = windows_of(d, np.array([0, len(d)]))
        pick = rng.permutation(len(win))[:per_doc]
        xs.append(win[pick])
        ys += [index[lang]] * len(pick)
    k = len(names)
    model = Model(names, rng.normal(0, 0.5, (256, EMBED)), np.zeros((SPAN, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, (FILTERS, k)), np.zeros(k))
    model.emb[0] = 0
    reach = np.repeat(WIDTHS, PER_WIDTH)
    mask = (np.arange(SPAN)[:, None] < reach[None, :])[:, None, :]
    model.conv[:] = rng.normal(0, 0.3, model.conv.shape) * mask
    if not xs:
        return model
    x, y = np.concatenate(xs), np.array(ys)
    # short texts are as common in use as they are here: part of the windows is blanked after some bytes
    short = rng.random(len(x)) < 0.25
    x = x.copy()
    x[(np.arange(x.shape[1])[None, :] >= rng.integers(12, 120, len(x))[:, None]) & short[:, None]] = 0
    params = [model.emb, model.conv, model.bias, model.out, model.out_bias]
    mom = [np.zeros_like(p) for p in params]
    var = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 0.01 * (0.2 if epoch >= epochs - 3 else 1.0)
        for i in range(0, len(order), batch):
            sel = order[i : i + batch]
            xb, yb, n = x[sel], y[sel], len(sel)
            t = np.einsum("be,kef->kbf", model.emb, model.conv).astype(np.float32)
            z = t[0][xb[:, :WINDOW]]
            for j in range(1, SPAN):
                z += t[j][xb[:, j : WINDOW + j]]
            at = z.argmax(1)  # (n, FILTERS)
            top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + model.bias
            hid = np.maximum(top, 0)
            g = _softmax(hid @ model.out + model.out_bias)
            g[np.arange(n), yb] -= 1
            g /= n
            gh = (g @ model.out.T) * (top > 0)
            ctx = xb[np.arange(n)[:, None, None], at[:, :, None] + np.arange(SPAN)[None, None, :]]  # (n, F, SPAN) bytes
            vec = model.emb[ctx]  # (n, F, SPAN, E)
            g_conv = np.einsum("nf,nfke->kef", gh, vec, optimize=True) * mask
            g_emb = np.zeros_like(model.emb)
            np.add.at(g_emb, ctx.reshape(-1), np.einsum("nf,kef->nfke", gh, model.conv).reshape(-1, EMBED))
            g_emb[0] = 0
            grads = [g_emb, g_conv, gh.sum(0), hid.T @ g + 1e-4 * model.out, g.sum(0)]
            step += 1
            for p, gr, m, v in zip(params, grads, mom, var, strict=True):
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    for name in ("bias", "out", "out_bias"):
        setattr(model, name, getattr(model, name).astype(np.float32))
    return model


def predict_rows(model: Model | None, arr: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a string array."""
    texts = arr.to_pylist()
    letter = np.array([bool(t) and has_letter(t) for t in texts], bool)
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    data, offs = text_rows(arr)
    score = np.zeros(len(texts))
    best = np.zeros(len(texts), np.int64)
    for lo, hi in row_chunks(offs, CHUNK):
        n = np.zeros(hi - lo)
        total = np.zeros((hi - lo, len(model.langs)))
        for win, row in _parts(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]):
            z = model.window_logits(win).astype(np.float64)
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            np.add.at(total, row, z)
            n += np.bincount(row, minlength=hi - lo)
        p = _softmax(total / np.maximum(n, 1)[:, None])
        best[lo:hi], score[lo:hi] = p.argmax(1), p.max(1)
    score[~letter] = 0.0
    return [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)], score


def training_sample(docs: DataFrame, max_docs: int = 4_000, max_bytes: int = 24 << 20) -> DataFrame:
    """(doc_id, text, lang): at most about max_docs labelled training rows and max_bytes of their text, chosen by id hash."""
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2))
    grain = 1 << 30
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(grain))
    n = ok.count()
    cut = grain if n <= max_docs else int(grain * max_docs / n)
    return within(ok.where(h < cut).select("doc_id", "text", "lang").distinct(), max_bytes)


def fit(docs: DataFrame, **sample) -> Model | None:
    ship(docs.sparkSession)

    def run(rows: list[tuple]) -> Model | None:
        return fit_texts([r[1] for r in rows], [r[2].decode() for r in rows])

    return fit_in_task(training_sample(docs, **sample), run)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict_rows(held.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: Model | None, langs: list[str] | None = None, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """Documents in one of ``langs`` (default: any learned language) with at least ``min_score``, columns as they are."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    wanted = None if langs is None else frozenset(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict_rows(held.value, b.column(at))
            yield b.filter(pa.array([x != UNKNOWN and (wanted is None or x in wanted) and s >= min_score for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
