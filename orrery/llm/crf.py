"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are its own and those of the lines beside it. Forward-backward gives each line's marginal chance of
being good; weighted by the lines' lengths, their mean is the document's quality.

The field is fitted on the lines of labelled documents, each of which takes its document's label: at most `most`
documents, those of the smallest hashed ids (a documented bound; half for either label). All documents are scored.

Defined results: lines are what line feeds part; a line without a word has no label. Null texts and texts without a
word have quality null, no labels, and are rejected; where no document is labelled, or all alike, nothing is learnt,
every quality and label is null, and only those texts are rejected. A document that is labelled twice counts as bad if
either label says so, and of texts of one labelled id the greatest is learnt from. A chance of one half counts as good.
Texts of any length, and of any number of lines, are taken whole. Repeated rows and ids each stand for themselves; other
columns aren't touched, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words
from ._shared import column, doc_columns, trim
from ._tokens import sliced

MOST, STEPS, ACCEPT = 3000, 150, 0.5
OTHER, LOWER, UPPER, DIGIT, GAP, STOP, SYMBOL = range(7)
KIND = np.zeros(256, np.uint8)
for _c in range(128):
    _x = chr(_c)
    KIND[_c] = LOWER if _x.islower() else UPPER if _x.isupper() else DIGIT if _x.isdigit() else GAP if _x.isspace() else STOP if _x in ".,;:'\"()-?" else SYMBOL
KIND[128:] = LOWER
KIND[0x80:0xC0] = OTHER  # bytes within a letter


@dataclass
class Field:
    """Weights of a line's features, chances of moving on, and how features are scaled."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def line_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line with a word: its document's place in texts, its length in characters, its own features."""
    buf, starts = _words.buffer([x.encode("utf-8", "replace") for x in texts])
    ws, we = _words.spans(buf)
    ends = np.flatnonzero(buf == 10)  # a line end closes every text
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    line_of = np.searchsorted(ends, ws)
    words = np.bincount(line_of, minlength=len(ends))
    # counts of each kind of character by line
    line_at = np.repeat(np.arange(len(ends)), ends - begins + 1)
    kinds = np.bincount(line_at * 7 + KIND[buf], minlength=7 * len(ends)).reshape(-1, 7).astype(float)
    length = kinds[:, 1:].sum(1) - 1  # without the line end
    h = _words.hashes(buf, ws, we) ^ _words.mixed(line_of.astype(np.uint64))
    distinct = np.bincount(line_of[np.unique(h, return_index=True)[1]], minlength=len(ends))
    same = np.flatnonzero((h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])) if len(h) else h
    again = np.bincount(line_of[same.astype(np.int64)], minlength=len(ends))
    long_words = np.bincount(line_of[we - ws > 20], minlength=len(ends))
    tail = KIND[buf[np.maximum(we - 1, 0)]] if len(we) else KIND[:0]
    symbol_tail = np.bincount(line_of[tail == SYMBOL], minlength=len(ends))
    keep = words > 0
    w, n = np.maximum(words, 1), np.maximum(length, 1)
    letters = np.maximum(kinds[:, LOWER] + kinds[:, UPPER], 1)
    x = np.stack(
        [
            np.log1p(length), np.log1p(words), length / w, kinds[:, UPPER] / letters, kinds[:, DIGIT] / n, kinds[:, SYMBOL] / n, kinds[:, STOP] / n, kinds[:, GAP] / n,
            1 - distinct / w, (1 - distinct / w) * np.log1p(words), again / w, long_words / w, symbol_tail / w,
            (kinds[:, SYMBOL] > 0).astype(float),
        ],
        1,
    )
    doc = np.searchsorted(starts, begins, "right") - 1
    return doc[keep], length[keep], x[keep]


def with_neighbours(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after in its document (else 0), whether there is one, and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    joint = doc[1:] == doc[:-1]
    before[1:][joint] = x[:-1][joint]
    after[:-1][joint] = x[1:][joint]
    one = np.ones((len(x), 1))
    has = np.concatenate([[False], joint]) if len(x) else np.zeros(0, bool)
    more = np.concatenate([joint, [False]]) if len(x) else np.zeros(0, bool)
    return np.concatenate([x, before, after, has[:, None], more[:, None], one], 1)


def padded(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling number of lines: each line's row and step, and at each step how many rows are left."""
    _, row, sizes = np.unique(doc, return_inverse=True, return_counts=True)
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first = np.cumsum(sizes) - sizes
    step = np.arange(len(doc)) - first[row]
    return rank[row], step, np.bincount(step) if len(doc) else np.zeros(0, int)


def marginals(score: np.ndarray, f: Field, place) -> tuple[np.ndarray, np.ndarray, float]:
    """Chances of good by line, expected moves (2 x 2), and the sum of log partition functions."""
    row, step, left = place
    if not len(row):
        return np.zeros(0), np.zeros((2, 2)), 0.0
    at = np.concatenate([[0], np.cumsum(left)])  # lines by step, then row
    slot = at[step] + row
    e = np.empty((len(row), 2))
    top = np.maximum(score, 0)
    e[slot, 0], e[slot, 1] = np.exp(-top), np.exp(score - top)
    m, start = np.exp(f.moves), np.exp(f.first)
    a, b, norm = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    for t, n in enumerate(left):
        s = slice(at[t], at[t] + n)
        a[s] = e[s] * (start if t == 0 else a[at[t - 1] : at[t - 1] + n] @ m)
        norm[s] = a[s].sum(1)
        a[s] /= norm[s, None]
    moves = np.zeros((2, 2))
    for t in range(len(left) - 2, -1, -1):
        n = left[t + 1]
        s, nxt = slice(at[t], at[t] + n), slice(at[t + 1], at[t + 1] + n)
        eb = e[nxt] * b[nxt] / norm[nxt, None]
        moves += (a[s].T @ eb) * m
        b[s] = eb @ m.T
    p = a * b
    p /= p.sum(1, keepdims=True)
    return p[slot, 1], moves, float(np.log(norm).sum() + top.sum())


def fit(texts: Sequence[str], good: Sequence[bool], steps: int = STEPS, penalty: float = 1e-3) -> Field | None:
    """By gradient ascent (Adam) on the mean log-likelihood of a line; None if the labels don't differ."""
    if len(set(good)) < 2:
        return None
    parts = [(i, line_features(texts[i:j])) for i, j in sliced(texts)]
    doc, x = np.concatenate([i + p[0] for i, p in parts]), np.concatenate([p[2] for _, p in parts])
    if not len(x):
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = with_neighbours(doc, (x - mean) / scale)
    y = np.asarray(good, float)[doc]
    place = padded(doc)
    joint = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][joint].astype(int), y[1:][joint].astype(int)), 1)
    begins = np.concatenate([[True], ~joint])
    d = z.shape[1]
    p = np.zeros(d + 6)
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, steps + 1):
        f = Field(p[:d], p[d : d + 4].reshape(2, 2), p[d + 4 :], mean, scale)
        q, moves, _ = marginals(z @ f.weights, f, place)
        g1 = np.array([(1 - y[begins]).sum() - (1 - q[begins]).sum(), y[begins].sum() - q[begins].sum()])
        g = np.concatenate([z.T @ (y - q), (seen - moves).ravel(), g1]) / len(y) - penalty * p
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        p = p + 0.1 * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-9)
    return Field(p[:d], p[d : d + 4].reshape(2, 2), p[d + 4 :], mean, scale)


def line_chances(texts: Sequence[str], f: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, length and chance of good of every line with a word."""
    doc, length, x = line_features(texts)
    z = with_neighbours(doc, (x - f.mean) / f.scale)
    return doc, length, marginals(z @ f.weights, f, padded(doc))[0]


def judged(texts: Sequence[str], f: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's quality (NaN without a word), and of every line with a word its text's place and whether it is good."""
    doc, length, p = line_chances(texts, f)
    weight = np.bincount(doc, length, len(texts))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight > 0, np.bincount(doc, length * p, len(texts)) / weight, np.nan), doc, p >= 0.5


def qualities(texts: Sequence[str], f: Field) -> np.ndarray:
    return judged(texts, f)[0]


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Field | None:
    """On at most `most` labelled documents, whatever the number of labels; their texts come to the driver."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).dropna().groupBy("doc_id").agg(F.min("q").alias("q"))
    order = F.xxhash64("doc_id")
    chosen = [r for q in ("q > 0", "q <= 0") for r in own.filter(q).orderBy(order, "doc_id").limit(most // 2).collect()]
    if not chosen:
        return None
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.q) for r in chosen], "doc_id long, q int")
    # at most `most` ids, so this side is always small
    rows = doc_columns(docs).filter("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max_by(F.struct("text", "q"), F.col("text")).alias("r"))
    got = rows.orderBy("doc_id").collect()
    return fit([r.r.text for r in got], [r.r.q > 0 for r in got])


def quality(text: Column, f: Field | None) -> Column:
    """Null for null texts, texts without words, and without a field."""
    if f is None:
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        texts = [x or "" for x in texts]
        out = [qualities(texts[a:b], f) for a, b in sliced(texts)]
        trim()
        return pd.Series(np.concatenate(out) if out else np.zeros(0)).astype(object).where(lambda s: s.notna(), None)

    return run(text)


def labelled(text: Column, f: Field | None) -> Column:
    """struct<quality, good_lines>: as quality(), with the label of every line that has a word, in order."""
    kind = "quality double, good_lines array<boolean>"
    if f is None:
        return F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        texts = [x or "" for x in texts]
        q, good = [np.zeros(0)], []
        for a, b in sliced(texts):
            own, doc, label = judged(texts[a:b], f)
            q.append(own)
            good += np.split(label, np.searchsorted(doc, np.arange(1, b - a)))
        trim()
        q = np.concatenate(q)
        return pd.DataFrame({"quality": pd.Series(q).astype(object).where(~np.isnan(q), None), "good_lines": pd.Series([x if len(x) else None for x in good], dtype=object)})

    return run(text)


def accepted(text: Column, q: Column, f: Field | None, accept: float = ACCEPT) -> Column:
    return F.coalesce(q >= accept, F.lit(False)) if f else F.coalesce(F.length(F.trim(text)) > 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, most: int = MOST) -> DataFrame:
    """doc_id, quality, accepted, good_lines (whether each line that has a word is good, in order)."""
    f = train(docs, labels, most)
    d = doc_columns(docs).select("doc_id", "text", labelled(F.col("text"), f).alias("l"))
    return d.select("doc_id", "l.quality", accepted(F.col("text"), F.col("l.quality"), f, accept).alias("accepted"), "l.good_lines")


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, most: int = MOST) -> DataFrame:
    """The rows of docs that are accepted, with all their columns as they are."""
    f, text = train(docs, labels, most), column(docs, "text").cast("string")
    return docs.filter(accepted(text, quality(text, f), f, accept))
