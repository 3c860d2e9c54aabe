"""Vectorised byte-level text helpers for Arrow batches.

A batch of texts is cut into blocks of about ``BLOCK_BYTES`` UTF-8 bytes
and ``BLOCK_TEXTS`` texts at most
(one longer text is a block of its own), so working memory is bounded by
the block size or the longest single text, whatever the batch size. Inside
a block, words are found and hashed with array operations only.

Hashes are fixed functions of the bytes (no process seed), so a task that
is run again after an executor loss gives the same values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BLOCK_TEXTS = 4096
#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by
#: the Python worker at once.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1  # odd multiplier of the rolling polynomial
_PINV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"p": np.ones(1, U64), "i": np.ones(1, U64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element-wise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=U64)
    return _powers["p"], _powers["i"]


class Block:
    """Some consecutive texts: their UTF-8 bytes and ``offsets`` (length
    n_texts + 1), both numpy arrays starting at 0."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n_texts = len(offsets) - 1
        self._cum = None

    def lower(self) -> "Block":
        """The same texts with A-Z lower-cased (other code points stay)."""
        return Block(LOWER[self.data], self.offsets, self.first)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text index) of each word ``[^\\x20\\x09-\\x0D]+``."""
        n = len(self.data)
        if n == 0:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        solid = ~SPACE[self.data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:n]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | edge[1:n]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span; equal bytes, equal hash."""
        n = len(self.data)
        p, inv = _powers_upto(n + 1)
        if self._cum is None:
            cum = np.empty(n + 1, dtype=U64)
            cum[0] = 0
            np.cumsum((self.data.astype(U64) + U64(1)) * p[:n], out=cum[1:])
            self._cum = cum
        raw = (self._cum[end] - self._cum[start]) * inv[start]
        return mix64(raw ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))

    def code_points_before(self) -> np.ndarray:
        """Number of code points before each byte position (length n + 1)."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def per_text(self, text_index: np.ndarray) -> np.ndarray:
        """How many of the items fall in each text."""
        return np.bincount(text_index, minlength=self.n_texts).astype(np.int64)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset: col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def whole_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` as one struct. Beside it helper columns can have
    any name, whatever the table's columns are called; ``select("_row.*")``
    gives these back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the session's Arrow batches to ``BATCH_ROWS`` rows (a smaller
    setting stays); every operator that maps texts does so."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def blocks(col: pa.Array, limit: int = BLOCK_BYTES, most: int = BLOCK_TEXTS) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts."""
    data, offsets = text_buffers(col)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + most, n)
        yield Block(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], i)
        i = j


def shingle_hashes(word_hash: np.ndarray, word_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` consecutive words of one text, and its text
    index. A text with 1 .. k-1 words gives its whole sequence as one."""
    n = len(word_hash)
    m = U64(0xFF51AFD7ED558CCD)
    if n >= k:
        acc = word_hash[: n - k + 1].copy()
        for j in range(1, k):
            acc = acc * m + word_hash[j: n - k + 1 + j]
        inside = word_text[: n - k + 1] == word_text[k - 1:]
        full, full_text = mix64(acc[inside]), word_text[: n - k + 1][inside]
    else:
        full, full_text = np.zeros(0, U64), np.zeros(0, np.int64)
    if n == 0:
        return full, full_text
    first = np.flatnonzero(np.r_[True, word_text[1:] != word_text[:-1]])
    length = np.diff(np.r_[first, n])
    short, short_text = [], []
    for f, ln in zip(first[length < k].tolist(), length[length < k].tolist()):
        acc = word_hash[f]
        with np.errstate(over="ignore"):
            for j in range(1, ln):
                acc = acc * m + word_hash[f + j]
        short.append(acc ^ U64(ln * 0x9E3779B1))
        short_text.append(word_text[f])
    if not short:
        return full, full_text
    h = np.concatenate([full, mix64(np.array(short, dtype=U64))])
    t = np.concatenate([full_text, np.array(short_text, dtype=full_text.dtype)])
    order = np.argsort(t, kind="stable")
    return h[order], t[order]
