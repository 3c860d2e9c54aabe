"""Small linear classifiers over hashed word features.

Features are extracted where the texts are; only the sparse counts of a
bounded sample reach the driver, where a model of a few thousand weights is
fitted in numpy. The fitted model (one lookup table) is sent to the executors
to score every text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.llm.textops import U64, Block, mix64

BUCKETS = 1 << 20


@dataclass
class Sparse:
    """Counts of features: ``row``, ``col``, ``n`` of equal length; ``rows``
    texts."""
    row: np.ndarray
    col: np.ndarray
    n: np.ndarray
    rows: int

    def take(self, rows: np.ndarray) -> "Sparse":
        """The given rows (distinct numbers), renumbered from 0."""
        place = np.full(self.rows, -1, dtype=np.int32)
        place[rows] = np.arange(len(rows))
        at = place[self.row]
        keep = at >= 0
        return Sparse(at[keep], self.col[keep], self.n[keep], len(rows))

    def only(self, features: np.ndarray) -> "Sparse":
        """The same texts with the given features alone."""
        wanted = np.zeros(BUCKETS, dtype=bool)
        wanted[features] = True
        keep = wanted[self.col]
        return Sparse(self.row[keep], self.col[keep], self.n[keep], self.rows)


def counted(col: np.ndarray, row: np.ndarray, rows: int) -> Sparse:
    key, n = np.unique(row.astype(np.int64) * BUCKETS + col, return_counts=True)
    return Sparse(key // BUCKETS, key % BUCKETS, n, rows)


def word_features(block: Block, prefixes: tuple[int, ...], suffixes: tuple[int, ...] = (),
                  repeats: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text index) of each lower-cased word, of its beginnings and
    ends of the given byte lengths and, with ``repeats``, of its being equal
    to the word before it."""
    low = block.lower()
    start, end, text = low.words()
    whole = low.hash_spans(start, end)
    feats, owners = [whole], [text]
    for k in prefixes:
        has = end - start >= k
        feats.append(mix64(low.hash_spans(start[has], start[has] + k) + U64(k)))
        owners.append(text[has])
    for k in suffixes:
        has = end - start >= k
        feats.append(mix64(low.hash_spans(end[has] - k, end[has]) + U64(1000 + k)))
        owners.append(text[has])
    if repeats and len(text):
        same = np.r_[False, (whole[1:] == whole[:-1]) & (text[1:] == text[:-1])]
        feats.append(np.full(same.sum(), 77, dtype=U64))
        owners.append(text[same])
    return (np.concatenate(feats) % U64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def pack(s: Sparse) -> list[pa.Array]:
    """Two binary columns, features and counts, one row a text."""
    cut = np.searchsorted(s.row, np.arange(s.rows + 1)).tolist()
    col, n = s.col.astype(np.int32), np.minimum(s.n, 65535).astype(np.uint16)
    return [pa.array([col[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
            pa.array([n[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())]


def unpack(cols: pa.ChunkedArray, counts: pa.ChunkedArray) -> Sparse:
    col = [np.frombuffer(x.as_buffer(), np.int32) for x in cols]
    n = [np.frombuffer(x.as_buffer(), np.uint16) for x in counts]
    size = [len(x) for x in col]
    none = np.zeros(0, np.uint16)
    return Sparse(np.repeat(np.arange(len(size), dtype=np.int32), size),
                  np.concatenate([none.astype(np.int32), *col]), np.concatenate([none, *n]), len(size))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass(frozen=True)
class Linear:
    """``slot``: for each bucket its weight's number or -1."""
    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, s: Sparse) -> np.ndarray:
        at = self.slot[s.col]
        keep = at >= 0
        return self.bias + np.bincount(s.row[keep], weights=self.weights[at[keep]] * np.log1p(s.n[keep]),
                                       minlength=s.rows)

    def score_items(self, feats: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
        """Logits from uncounted items; features without a weight drop out
        before the counting."""
        at = self.slot[feats]
        keep = at >= 0
        key, n = np.unique(text[keep].astype(np.int64) * len(self.weights) + at[keep], return_counts=True)
        width = max(1, len(self.weights))
        return self.bias + np.bincount(key // width, weights=self.weights[key % width] * np.log1p(n), minlength=rows)


def chosen_features(s: Sparse, y: np.ndarray, most: int, least_texts: int = 4) -> np.ndarray:
    """The features whose presence depends on the class most, by chi-square."""
    total, pos = len(y), float(y.sum())
    if total == 0 or pos in (0.0, float(total)):
        return np.zeros(0, dtype=np.int64)
    have = np.bincount(s.col, minlength=BUCKETS).astype(float)
    hits = np.bincount(s.col[y[s.row] > 0], minlength=BUCKETS)
    cols = np.flatnonzero(have)
    have, hits = have[cols], hits[cols]
    expected = have * pos / total
    spread = np.maximum(expected * (1 - pos / total) * (1 - have / total), 1e-9)
    chi = np.where(have >= least_texts, (hits - expected) ** 2 / spread, 0.0)
    best = np.argsort(-chi, kind="stable")[:most]
    return cols[best[chi[best] > 0]]


def fit(s: Sparse, y: np.ndarray, *, weight: np.ndarray | None = None, features: np.ndarray | None = None,
        most: int = 4000, rounds: int = 200, step: float = 0.02, l2: float = 2e-3,
        pairs: Sparse | None = None, pair_values: np.ndarray | None = None, pair_penalty: float = 0.0) -> Linear:
    """Logistic regression on log(1 + count), by full-batch Adam.

    ``pairs`` / ``pair_values``: rows of feature differences whose squared
    score is penalised, ``pair_penalty`` times their mean. A sample of one
    class only, or none, gives a constant."""
    weight = np.ones(len(y)) if weight is None else weight
    features = chosen_features(s, y, most) if features is None else features
    k = len(features)
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    slot[features] = np.arange(k)
    mean = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    bias = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    if k == 0:
        return Linear(slot, np.zeros(0), bias)
    at = slot[s.col]
    keep = at >= 0
    row, col, v = s.row[keep], at[keep], np.log1p(s.n[keep])
    # features of like spread learn at like speed
    scale = np.maximum(np.sqrt(np.bincount(col, weights=v * v * weight[row], minlength=k) / max(1e-9, weight.sum())), 0.03)
    v = v / scale[col]
    if pairs is not None:
        pat = slot[pairs.col]
        keep = pat >= 0
        prow, pcol = pairs.row[keep], pat[keep]
        pv = pair_values[keep] / scale[pcol]
    w, m1, m2 = np.zeros(k), np.zeros(k), np.zeros(k)
    total = weight.sum()
    for r in range(1, rounds + 1):
        p = sigmoid(np.bincount(row, weights=w[col] * v, minlength=s.rows) + bias)
        g = (p - y) * weight / total
        grad = np.bincount(col, weights=g[row] * v, minlength=k) + l2 * w
        if pairs is not None and pairs.rows:
            change = np.bincount(prow, weights=w[pcol] * pv, minlength=pairs.rows)
            grad += 2 * pair_penalty / pairs.rows * np.bincount(pcol, weights=change[prow] * pv, minlength=k)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        w -= step * (m1 / (1 - 0.9 ** r)) / (np.sqrt(m2 / (1 - 0.99 ** r)) + 1e-9)
        bias -= 0.1 * g.sum()
    return Linear(slot, w / scale, bias)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(labels: DataFrame, id_col: str, target: str, per_class: dict[int, int]) -> DataFrame:
    """(_id, _y): at most ``per_class[y]`` labelled ids per class outside the
    held-out fold, those of least hash. Null ids and labels do not count; of
    several labels for an id the largest does."""
    own = (labels.where(F.col(id_col).isNotNull() & F.col(target).isin(*per_class) & (fold(F.col(id_col)) != 0))
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(target).cast("int").alias("_y")))
    parts = [own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in per_class.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
