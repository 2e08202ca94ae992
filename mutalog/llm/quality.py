"""Quality classifier by positive-unlabelled learning.

Positives are the documents that labels trust; everything else is unlabelled
and may be either; labels of bad documents are not used. With class prior p the
risk of a scorer g is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

whose second term, the risk on negatives, is kept from going below zero. The
scorer is additive: each feature of the text is cut into bins, each bin has a
weight. It is fitted on bounded samples (POSITIVES and UNLABELLED rows, the
least hashes of their ids), then scores every whole text where it is read. The
prior comes from the same samples: the share of unlabelled rows above a cut of a
first scorer, over the share of positives above it, is the prior plus something
that is not negative, so the least ratio over the cuts estimates it.

Features come from the text alone: no id, source, language or label.

Defined results: null and empty texts are scored (all features 0); labels that
are null, and documents without an id, are not learnt from but scored; repeated
labels of a document count once, as the least; of documents that repeat an id
the least text may be learnt from; no positives at all: every score is the
prior, 0.5; a column of the caller named score goes on as score_input.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutalog.llm.shared import apart, in_batches

#: Rows of the two samples; their features (a few numbers a row) are all that reaches the driver.
POSITIVES, UNLABELLED = 8_000, 16_000
BINS, STEPS, RATE, DECAY = 24, 600, 0.05, 1e-3
THRESHOLD = 0.7
#: Share of trusted positives below the model's cut, and least share of positives above a cut that the prior is read from.
FEW, ABOVE = 0.003, 0.5
_SYMBOLS = np.array([chr(b) in "#$%&*+<=>@\\^_`{}~" for b in range(256)])
_MARKS = np.array([chr(b) in ".,;:?'\"()-" for b in range(256)])
_DIGITS = np.array([48 <= b < 58 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_LOWER = np.array([97 <= b < 123 for b in range(256)])
NAMES = ("length", "words", "upper", "symbols", "marks", "digits", "shouts", "bars", "lines", "beyond_ascii", "repeats", "variety", "word_length", "line_repeats", "marked_words", "density", "caps_words", "stops")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def features(text: str) -> list[float]:
    data = text.encode("utf-8")
    n = len(data)
    if not n:
        return [0.0] * len(NAMES)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    k = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x]
    upper, lower = int(seen[_UPPER].sum()), int(seen[_LOWER].sum())
    head = data[: 1 << 16] if n <= 1 << 16 else None
    # long texts are deflated in slices, so that the ratio doesn't depend on the length
    packed = len(zlib.compress(head, 1)) if head is not None else sum(len(zlib.compress(data[i : i + (1 << 16)], 1)) for i in range(0, n, 1 << 16))
    return [
        np.log1p(n),
        np.log1p(len(words)),
        upper / (upper + lower + 1),
        seen[_SYMBOLS].sum() / n,
        seen[_MARKS].sum() / n,
        seen[_DIGITS].sum() / n,
        seen[33] / k,
        seen[124] / k,
        len(lines) / k,
        seen[128:].sum() / n,
        sum(map(operator.eq, words, words[1:])) / k,
        len(set(words)) / k**0.75,
        sum(map(len, words)) / k,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(map(operator.methodcaller("endswith", (b"*", b"$", b"%", b"&", b"#", b"!")), words)) / k,
        packed / n,
        sum(map(bytes.isupper, words)) / k,
        seen[46] / k,
    ]


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    bias: float
    prior: float
    cut: float = THRESHOLD  # the score that all trusted positives but FEW reach, at most THRESHOLD

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j in range(x.shape[1]):
            out += self.weights[j][np.searchsorted(self.edges[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _cells(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The weight that each feature of each row takes, as an index: rows x features."""
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(x.shape[1])], 1)
    return bins + np.arange(x.shape[1]) * BINS


def _minimised(p: np.ndarray, u: np.ndarray, prior: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias with the least non-negative risk under the logistic loss, by Adam on all rows of p and u (cells) at once."""
    d = p.shape[1]
    w, b = np.zeros(d * BINS), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    slopes = lambda cells, on: np.bincount(cells.ravel(), np.repeat(on, d), len(w))
    for t in range(1, steps + 1):
        gp, gu = w[p].sum(1) + b, w[u].sum(1) + b
        negative = loss(-gu).mean() - prior * loss(-gp).mean()
        # slopes of the losses by g
        sign = 1.0 if negative >= 0 else -1.0  # below zero: walk back up
        on_u = sign * sigmoid(gu) / len(u)
        on_p = -sign * prior * sigmoid(gp) / len(p)
        if sign > 0:
            on_p -= prior * sigmoid(-gp) / len(p)
        grad = np.append(slopes(p, on_p) + slopes(u, on_u) + DECAY * w / 10, on_p.sum() + on_u.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled rows: the least ratio of shares above a cut, on the rows that a first scorer hasn't seen."""
    w, b = _minimised(p[::2], u[::2], 0.5, STEPS // 3)
    gp, gu = np.sort(w[p[1::2]].sum(1) + b), np.sort(w[u[1::2]].sum(1) + b)
    if not len(gp) or not len(gu):
        return 0.5
    cuts = np.unique(np.quantile(gp, np.linspace(0, 1 - ABOVE, 200)))
    above = lambda g: 1 - np.searchsorted(g, cuts) / len(g)
    return float(np.clip((above(gu) / above(gp)).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The model of the least non-negative risk; prior: the share of positives among the unlabelled, else estimated."""
    d = len(NAMES)
    if not len(positive) or not len(unlabelled):
        prior = 0.5 if prior is None else prior
        return Model(np.zeros((d, BINS - 1)), np.zeros((d, BINS)), float(np.log(prior / (1 - prior))), prior, 0.0)
    both = np.concatenate([positive, unlabelled])
    # cuts lie where either tail is thin as well: junk is rare
    at = np.concatenate([[0.002, 0.01, 0.03], np.linspace(0.06, 0.94, BINS - 7), [0.97, 0.99, 0.998]])
    edges = np.quantile(both, at, axis=0).T.copy()
    p, u = _cells(edges, positive), _cells(edges, unlabelled)
    prior = class_prior(p, u) if prior is None else prior
    w, b = _minimised(p, u, prior, STEPS)
    cut = 1 / (1 + np.exp(-np.clip(np.quantile(w[p].sum(1) + b, FEW), -30, 30)))
    return Model(edges, w.reshape(d, BINS), b, prior, float(min(cut, THRESHOLD)))


def _sampled(ids: DataFrame, n: int, id_col: str) -> DataFrame:
    return ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(n)


def _features_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Features of the sampled documents, ordered by a hash of the id: one row an id, so at most as many as the sample has."""
    texts = docs.select(id_col, text_col).join(F.broadcast(ids), id_col, "left_semi").groupBy(id_col).agg(F.min(text_col).alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t.as_py() or "") for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(made, pa.list_(pa.float64()))], ["at", "x"])

    rows = in_batches(texts.select(F.xxhash64(id_col, F.lit(11)).alias("at"), text_col), run, "at long, x array<double>").collect()
    rows.sort()
    return np.array([r.x for r in rows]).reshape(len(rows), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """labels: id and quality (1: trusted positive). Rows held out are neither counted nor sampled."""
    usable = labels.where(~held_out(id_col)).groupBy(id_col).agg(F.min("quality").alias("quality"))
    trusted = _sampled(usable.where("quality = 1"), POSITIVES, id_col)
    open_ = _sampled(docs.where(~held_out(id_col)), UNLABELLED, id_col)
    return fit(_features_of(docs, trusted, id_col, text_col), _features_of(docs, open_, id_col, text_col))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without its text, with score."""
    docs = apart(docs, "score")
    kept = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(f for f in docs.schema if f.name != text_col), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column(text_col)]).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(model.score(x))], schema.names)

    return in_batches(docs, run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of docs that the model takes for good, all their columns; threshold: else the model's cut, so that hardly any good text goes."""
    threshold = model.cut if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column(text_col)]).reshape(b.num_rows, len(NAMES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return in_batches(docs, run, docs.schema)
