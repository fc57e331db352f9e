"""Language identification by a convolutional network over bytes.

Texts are cut into fixed-length windows of UTF-8 bytes (the last one padded with zero bytes). For
each of several widths, a bank of filters slides over the window; each filter's largest value in the
window passes a rectifier, and a softmax layer turns these values into a probability for each
language. The network is trained with numpy on the driver, on a bounded sample of labelled rows, and
applied to every window of every text; a text's probabilities are the means over its windows,
weighted by their bytes.

Defined results: a null text, and one without a letter, is ``und`` with score 0; without any
labelled row every text is ``und``; rows with equal text have equal results; only the text is an
input. Rows are never dropped, whatever their ids; equal probabilities go to the language that comes
first by code point; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of the training sample: labelled rows in all, and windows that a row gives.
MAX_ROWS, WINDOWS_A_ROW = 6_000, 3
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SEED = 20_231


@dataclass
class Model:
    """``tables[i][j]``: for the i-th width, what a byte at offset j adds to each filter."""

    classes: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray


def windows(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows of each row's bytes, each window's row, and its count of real bytes."""
    n = np.diff(offs)
    per = (n + WINDOW - 1) // WINDOW
    row = np.repeat(np.arange(len(n)), per)
    first = np.repeat(np.cumsum(per) - per, per)
    start = offs[:-1][row] + (np.arange(len(row)) - first) * WINDOW
    used = np.minimum(offs[1:][row] - start, WINDOW)
    padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
    x = padded[start[:, None] + np.arange(WINDOW)]
    x[np.arange(WINDOW) >= used[:, None]] = 0
    return x, row, used


def _features(model: Model, x: np.ndarray, arg: bool = False):
    """Each filter's largest value in each window; with ``arg`` also where it stands."""
    span = WINDOW - max(WIDTHS) + 1
    best, at = [], []
    for t in model.tables:
        z = t[0][x[:, :span]]
        for j in range(1, len(t)):
            z += t[j][x[:, j : j + span]]
        if arg:
            a = z.argmax(axis=1)
            at.append(a)
            best.append(np.take_along_axis(z, a[:, None, :], axis=1)[:, 0])
        else:
            best.append(z.max(axis=1))
    h = np.concatenate(best, axis=1) + model.bias
    return (h, np.concatenate(at, axis=1)) if arg else h


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: list[str], epochs: int = 5, batch: int = 64, rate: float = 4e-3) -> Model:
    """Fit by Adam on the cross-entropy; the same rows in the same order give the same model."""
    rng = np.random.default_rng(_SEED)
    f, c = FILTERS * len(WIDTHS), len(classes)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params = [*tables, np.zeros(f, np.float32), rng.normal(0, 0.3, (f, c)).astype(np.float32), np.zeros(c, np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            xb, yb = x[order[s : s + batch]], y[order[s : s + batch]]
            model = Model(classes, params[: len(WIDTHS)], *params[len(WIDTHS) :])
            h, at = _features(model, xb, arg=True)
            r = np.maximum(h, 0)
            p = _softmax(r @ model.dense + model.offset)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            gh = (p @ model.dense.T) * (h > 0)
            grads = []
            for i, w in enumerate(WIDTHS):
                g, a = gh[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
                out = np.empty((w, 256, FILTERS), np.float32)
                for j in range(w):
                    cell = np.take_along_axis(xb, a + j, axis=1).astype(np.int64) * FILTERS + np.arange(FILTERS)
                    out[j] = np.bincount(cell.ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                grads.append(out)
            grads += [gh.sum(axis=0), r.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(classes, params[: len(WIDTHS)], *params[len(WIDTHS) :])


class Scorer:
    """A trained model with the tables of neighbouring bytes added up beforehand."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.pairs = [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65_536, -1) for j in range(0, len(t) - 1, 2)] for t in model.tables]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows, a few of them at a time to stay in the cache."""
        m, span, out = self.model, WINDOW - max(WIDTHS) + 1, []
        for s in range(0, len(x), 64):
            b = x[s : s + 64]
            pair = b[:, :-1].astype(np.int32) * 256 + b[:, 1:]
            best = []
            for t, tables in zip(m.tables, self.pairs):
                z = np.take(tables[0], pair[:, :span], axis=0)
                for j in range(1, len(tables)):
                    z += np.take(tables[j], pair[:, 2 * j : 2 * j + span], axis=0)
                if len(t) % 2:
                    j = len(t) - 1
                    z += np.take(t[j], b[:, j : j + span], axis=0)
                best.append(z.max(axis=1))
            out.append(_softmax(np.maximum(np.concatenate(best, axis=1) + m.bias, 0) @ m.dense + m.offset))
        return np.concatenate(out) if out else np.zeros((0, len(m.classes)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        from .common import text_bytes

        n, c = len(texts), len(self.model.classes)
        total, weight = np.zeros((n, max(c, 1))), np.zeros(n)
        if c:
            raw, offs = text_bytes(texts)
            x, row, used = windows(raw, offs)
            p = self.probabilities(x) * used[:, None]
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
            if len(row):
                total[row[starts]] = np.add.reduceat(p, starts, axis=0)
                weight[row[starts]] = np.add.reduceat(used, starts)
        mean = total / np.maximum(weight, 1)[:, None]
        best, score = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
        known = [bool(c and t and _LETTER.search(t)) for t in texts.to_pylist()]
        return [self.model.classes[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: one in three, by the CRC of the id's text."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Train on at most about ``max_rows`` labelled rows that are not held out, as many of each language.

    Which rows are taken hangs on a hash of id and text alone, so a rerun takes the same ones. A sample
    of ``max_rows`` rows can't hold more languages than rows: only of more than that, those with the
    most rows are learned. Each row gives up to ``WINDOWS_A_ROW`` windows spread over the whole text,
    and a shorter piece of one of them, so that short texts are met in training too. The driver gets
    these windows only.
    """
    rows = df.select(df[doc_id].alias("id"), df[text].alias("text"), df[lang].alias("lang")).where("text is not null and lang is not null").where(~held_out(F.col("id")))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    found = {r["lang"]: r["n"] for r in most.collect()}
    classes = sorted(found)
    if not classes:
        return Model([], [], *[np.zeros(0)] * 3)
    # A row a language, so no more than max_rows.
    shares = df.sparkSession.createDataFrame([(k, min(1.0, max_rows / len(classes) / found[k])) for k in classes], "lang string, share double")
    key = F.xxhash64("id", "text")
    taken = rows.join(F.broadcast(shares), "lang").where(F.pmod(key, F.lit(1_000_003)) < F.col("share") * 1_000_003).select(key.alias("key"), "text", "lang")

    def cuts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lang, win = [], [], []
            for k, t, name in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "lang"))):
                raw, rng = t.encode(), np.random.default_rng(k & 0xFFFFFFFF)
                starts = sorted({int(z) for z in rng.integers(0, max(1, len(raw) - WINDOW + 1), WINDOWS_A_ROW)})
                pieces = [raw[z : z + WINDOW] for z in starts]
                short = int(rng.integers(8, 100))
                at = int(rng.integers(0, max(1, len(raw) - short + 1)))
                for piece in [*pieces, raw[at : at + short]]:
                    key.append(k), lang.append(name), win.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(lang, pa.string()), pa.array(win, pa.binary())], ["key", "lang", "win"])

    # Windows are bounded, and so is their count: whole texts are never sorted or sent.
    cut_out = map_rows(taken, cuts, "key bigint, lang string, win binary").orderBy("key", "lang", "win").limit(2 * max_rows * (WINDOWS_A_ROW + 1))
    got = sorted((r["key"], r["lang"], bytes(r["win"])) for r in cut_out.collect())
    if not got:
        return Model([], [], *[np.zeros(0)] * 3)
    x = np.zeros((len(got), WINDOW), np.uint8)
    for i, (_, _, w) in enumerate(got):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    index = {k: i for i, k in enumerate(classes)}
    return train(x, np.array([index[k] for _, k, _ in got]), classes)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with ``lang_pred`` and ``score``; columns of these names are replaced.

    ``keep`` names the other columns that the result has (all, if None); long texts that nobody
    reads on need not travel back.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = df.select(keep).schema.add("lang_pred", "string").add("score", "double")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                pred, score = scorer.predict(part.column(text))
                cols = [*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score"])

    return map_rows(df.select(list(dict.fromkeys([*keep, text]))), run, schema)
