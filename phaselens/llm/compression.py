"""Quality rules from zstandard compression ratios.

The ratio compressed / raw bytes is taken for the whole document and for
each fixed chunk of it. Repetitive text compresses too well, random or
encoded text hardly at all. Short texts compress worse than long ones for
reasons that have nothing to do with quality, so each limit belongs to a
length band. Scripts of many letters, written in several bytes each, compress
worse than Latin ones at the same length, so the highest ratio of a text with
many bytes beyond ASCII comes from a table of its own.

Input cases: a null or empty text has no words, ratio 1.0 and fails the
base rules; a text shorter than the first band of the ratio rules (64 bytes) is
judged by the base rules alone; null ids, repeated rows and extra columns are
kept apart per row; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from phaselens.llm.textops import Block, blocks, shingle_hashes, small_batches

SYMBOLS = b"#*$%&|<>"
BEYOND_ASCII = bytes(range(128, 256))


@dataclass(frozen=True)
class CompressionRules:
    """``bands``: (least raw bytes, lowest ratio, highest ratio), ascending by
    length; a document is judged by the last band it reaches, and so is each
    of its chunks. A highest ratio lies between the densest clean text (spans
    of shuffled interface messages in Latin script) and base64, which takes
    about 0.75 + 46 / bytes, at the band's longer end; the bands are narrow
    where the two are close. ``wide_bands``: (least raw bytes, highest ratio)
    where more than ``wide_percent`` of the bytes are beyond ASCII: Chinese is
    as dense as random letters there up to about 4 KB. ``short_bands``
    come before ``bands``: clean text under 160 bytes hardly compresses
    itself, so only a lowest ratio is set there.
    ``max_bad_chunks``: share of raw bytes in chunks outside their band, above
    or below, from which a document fails. A last chunk of under a sixteenth
    of ``chunk_bytes`` is part of the one before."""
    level: int = 3
    chunk_bytes: int = 4096
    short_bands: tuple[tuple[int, float, float], ...] = (
        (64, 0.45, 1.15),
        (128, 0.40, 1.15),
        (160, 0.37, 1.04),
        (192, 0.33, 0.98),
        (224, 0.32, 0.912),
    )
    bands: tuple[tuple[int, float, float], ...] = (
        (256, 0.30, 0.905),
        (288, 0.30, 0.89),
        (320, 0.30, 0.875),
        (352, 0.30, 0.863),
        (384, 0.30, 0.845),
        (448, 0.30, 0.83),
        (512, 0.30, 0.81),
        (640, 0.30, 0.795),
        (768, 0.30, 0.77),
        (1024, 0.27, 0.74),
        (2048, 0.27, 0.68),
        (4096, 0.24, 0.61),
        (16384, 0.20, 0.55),
        (65536, 0.16, 0.53),
    )
    wide_bands: tuple[tuple[int, float], ...] = (
        (64, 1.15),
        (256, 1.02),
        (512, 0.97),
        (1024, 0.86),
        (2048, 0.78),
        (4096, 0.70),
        (16384, 0.62),
        (65536, 0.56),
    )
    wide_percent: int = 20
    max_bad_chunks: float = 0.2
    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30


def _band(rules: CompressionRules, raw: bytes) -> tuple[float, float] | None:
    size, found = len(raw), None
    for least, low, high in (*rules.short_bands, *rules.bands):
        if size >= least:
            found = (low, high)
    if found and 100 * (size - len(raw.translate(None, BEYOND_ASCII))) > rules.wide_percent * size:
        for least, high in rules.wide_bands:
            if size >= least:
                found = (found[0], high)
    return found


def compression_verdict(raw: bytes, rules: CompressionRules, compressor) -> tuple[float, float, float, bool, bool]:
    """(ratio, lowest and highest chunk ratio, repetitive, incompressible)."""
    if not raw:
        return 1.0, 1.0, 1.0, False, False
    whole = len(compressor.compress(raw)) / len(raw)
    limits = _band(rules, raw)
    low = limits is not None and whole < limits[0]
    high = limits is not None and whole > limits[1]
    if len(raw) <= rules.chunk_bytes:
        return whole, whole, whole, low, high
    ratios, low_bytes, high_bytes = [whole], 0, 0
    starts = list(range(0, len(raw), rules.chunk_bytes))
    if len(raw) - starts[-1] < rules.chunk_bytes // 16:
        starts.pop()
    for at, end in zip(starts, starts[1:] + [len(raw)]):
        chunk = raw[at:end]
        limits = _band(rules, chunk)
        if limits is None:
            continue
        r = len(compressor.compress(chunk)) / len(chunk)
        ratios.append(r)
        low_bytes += len(chunk) * (r < limits[0])
        high_bytes += len(chunk) * (r > limits[1])
    bad = low_bytes + high_bytes > rules.max_bad_chunks * len(raw)
    return whole, min(ratios), max(ratios), low or bad and low_bytes > 0, high or bad and high_bytes > 0


def base_counts(block: Block, window: int = 8) -> dict[str, np.ndarray]:
    """Counts per text: words, code points in words, symbols, lines equal to
    an earlier line (lines with a word only), and words that lie in a
    ``window``-word run found twice or more in the text."""
    start, end, text = block.words()
    cp = block.code_points_before()
    out = {"n_words": block.per_text(text)}
    out["word_chars"] = np.bincount(text, weights=cp[end] - cp[start], minlength=block.n_texts).astype(np.int64)
    is_symbol = np.zeros(256, dtype=np.int64)
    is_symbol[list(SYMBOLS)] = 1
    symbols = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(is_symbol[block.data], out=symbols[1:])
    out["n_symbols"] = symbols[block.offsets[1:]] - symbols[block.offsets[:-1]]
    out["n_dup_lines"] = _duplicate_lines(block, start)
    out["n_repeat_words"] = _repeated_words(block, start, end, text, window)
    return out


def _duplicate_lines(block: Block, word_start: np.ndarray) -> np.ndarray:
    n = len(block.data)
    if n == 0:
        return np.zeros(block.n_texts, dtype=np.int64)
    newline = np.flatnonzero(block.data == 0x0A)
    begin = np.unique(np.concatenate([block.offsets[:-1][np.diff(block.offsets) > 0], newline + 1]))
    begin = begin[begin < n]
    newline = np.append(newline, n)
    stop = np.minimum(newline[np.searchsorted(newline, begin, side="left")],
                      block.offsets[np.searchsorted(block.offsets, begin, side="right")])
    words = np.searchsorted(word_start, stop, side="left") - np.searchsorted(word_start, begin, side="left")
    begin, stop = begin[words > 0], stop[words > 0]
    text = np.searchsorted(block.offsets, begin, side="right") - 1
    h = block.hash_spans(begin, stop)
    distinct = np.unique(np.stack([text.astype(np.uint64), h], axis=1), axis=0)
    return block.per_text(text) - block.per_text(distinct[:, 0].astype(np.int64))


def _repeated_words(block: Block, start, end, text, window: int) -> np.ndarray:
    n = len(start)
    if n < window:
        return np.zeros(block.n_texts, dtype=np.int64)
    inside = text[: n - window + 1] == text[window - 1:]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(block.n_texts, dtype=np.int64)
    long_enough = block.per_text(text) >= window
    keep = long_enough[text]
    h, owner = shingle_hashes(block.hash_spans(start, end)[keep], text[keep], window)
    order = np.lexsort((h, owner))
    hs, os = h[order], owner[order]
    same = (hs[1:] == hs[:-1]) & (os[1:] == os[:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    return np.bincount(text, weights=np.cumsum(cover[:-1]) > 0, minlength=block.n_texts).astype(np.int64)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    rules: CompressionRules = CompressionRules()) -> DataFrame:
    """One row per input row: counts, ``base_failed``, the ratios, the two
    compression verdicts and ``kept``. A narrow map over two columns of the
    scan; nothing is shuffled."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = ([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in longs]
              + [T.StructField("base_failed", T.BooleanType())]
              + [T.StructField(c, T.DoubleType()) for c in ("ratio", "min_chunk_ratio", "max_chunk_ratio")]
              + [T.StructField(c, T.BooleanType()) for c in ("repetitive", "incompressible", "kept")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=rules.level)
        for batch in batches:
            for block in blocks(batch.column(1)):
                counts = base_counts(block, rules.repeat_window)
                failed = ((counts["n_words"] < rules.min_words)
                          | (100 * counts["n_repeat_words"] > rules.max_repeat_percent * counts["n_words"]))
                raw, off = block.data.tobytes(), block.offsets.tolist()
                verdicts = [compression_verdict(raw[a:b], rules, compressor) for a, b in zip(off, off[1:])]
                whole, least, most, low, high = (np.array(v) for v in zip(*verdicts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts)] + [pa.array(counts[c]) for c in longs]
                    + [pa.array(x) for x in (failed, whole, least, most, low, high, ~(failed | low | high))],
                    [f.name for f in fields])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, T.StructType(fields))
