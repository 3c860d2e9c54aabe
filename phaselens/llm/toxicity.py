"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over hashed words and word beginnings is fitted to a bounded
labelled sample. Labelled sentences that name groups are part of it: from every
labelled text sentences are cut as *carriers*, an identity term takes the place
of one of their words, and they keep the text's label (over the sample every
term is set into carriers of both classes). In each carrier, and in each
sentence of the texts that names a group itself, the terms are then swapped
for another group's of the same kind, and the squared change of the sentence's
score is penalised, so that naming a group, by itself, does not move a score.
:func:`counterfactual_gap` measures what is left of the change over carriers
of held-out texts. Every text is scored by a map over the scan.

Input cases: null and empty texts get the score of no evidence (the model's
constant) and carry nothing; null ids are held out from learning and scored; of
several rows with one labelled id one is learnt from (of least text hash), so
the sample is bounded in rows; a table without labels, or with labels of one
class only, gives a constant; repeated rows and extra columns are kept apart
per row; an empty table gives an empty result."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaselens.llm.learn import (BUCKETS, Linear, Sparse, chosen_features, counted, fit, fold, labelled_sample, pack,
                                 sigmoid, unpack, word_features)
from phaselens.llm.textops import blocks, small_batches

#: Words that name groups, by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("africans", "asians", "europeans", "americans"), ("african", "asian", "european", "american"),
    ("black", "white"), ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("immigrants", "natives"), ("refugees", "citizens"), ("old", "young"), ("disabled", "abled"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

PREFIXES = (4, 6, 8, 10)
_SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class ToxicityParams:
    """``max_toxic`` / ``max_clean``: labelled rows used for fitting at most.
    ``features``: chosen at most, and ``features_per_row`` a labelled row (a
    small sample can't tell many features apart); those of the identity terms
    come on top. ``carriers``: sentences a labelled text lends, of at most
    ``carrier_words`` words; ``carrier_weight``: of one, where a text has 1."""
    max_toxic: int = 2500
    max_clean: int = 5000
    features: int = 4000
    features_per_row: float = 1.2
    carriers: int = 3
    carrier_words: int = 30
    carrier_weight: float = 0.02
    pair_penalty: float = 4.0
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS


def swapper(terms: tuple[tuple[str, ...], ...]):
    """A function that replaces every identity term of a lower-cased sentence
    by the next of its kind; None if there is none."""
    after = {t: kind[(i + 1) % len(kind)] for kind in terms for i, t in enumerate(kind)}
    find = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, after), key=len, reverse=True)) + r")(?!\w)")

    def swap(sentence: str) -> str | None:
        out, n = find.subn(lambda m: after[m[0]], sentence.lower())
        return out if n else None

    return swap


def carriers(text: str, params: ToxicityParams) -> list[str]:
    """Sentences of the text with an identity term in the place of a word.
    Which sentence, word and term follows from a checksum of the text."""
    sentences = [w for w in (m[0].split() for m in _SENTENCE.finditer(text)) if len(w) >= 3]
    terms = [t for kind in params.terms for t in kind]
    out = []
    for i in range(params.carriers if sentences and terms else 0):
        h = zlib.crc32(f"{i} {text}".encode())
        words = sentences[h % len(sentences)]
        at = (h >> 8) % len(words)
        first = max(0, min(at - params.carrier_words // 2, len(words) - params.carrier_words))
        words = words[:at] + [terms[(h >> 16) % len(terms)]] + words[at + 1:]
        out.append(" ".join(words[first: first + params.carrier_words]))
    return out


def _features(texts: pa.Array) -> Iterator[tuple[int, Sparse]]:
    for block in blocks(texts):
        feats, owner = word_features(block, PREFIXES)
        yield block.first, counted(feats, owner, block.n_texts)


def counterfactual_pairs(text: str, swap) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, differences of log(1 + count)) between each sentence of the
    text that names a group and its swapped form."""
    out = []
    for m in _SENTENCE.finditer(text):
        other = swap(m[0])
        if other is None:
            continue
        values: dict[int, float] = {}
        for _, s in _features(pa.array([m[0], other])):
            for r, c, n in zip(s.row.tolist(), s.col.tolist(), np.log1p(s.n).tolist()):
                values[c] = values.get(c, 0.0) + (n if r == 0 else -n)
        kept = [(c, v) for c, v in sorted(values.items()) if v]
        out.append((np.array([c for c, _ in kept], np.int32), np.array([v for _, v in kept], np.float32)))
    return out


def _one_text_each(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_y, _text): one row per id of the bounded sample, however many rows
    share it."""
    rows = small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id")
    return rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_y", "_text")


@dataclass
class ToxicSample:
    """Counts of texts and then of carriers, labels and weights of both, and
    the feature differences of swapped sentences."""
    counts: Sparse
    y: np.ndarray
    weight: np.ndarray
    pairs: Sparse
    pair_values: np.ndarray


def toxicity_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    params: ToxicityParams = ToxicityParams()) -> ToxicSample:
    """What is learnt from: a bounded sample of the rows outside the held-out
    fold."""
    sample = labelled_sample(labels, id_col, "toxic", {1: params.max_toxic, 0: params.max_clean})
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("carrier", T.BooleanType()),
                           T.StructField("col", T.BinaryType()), T.StructField("n", T.BinaryType()),
                           T.StructField("pair_col", T.ArrayType(T.BinaryType())), T.StructField("pair_value", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = swapper(params.terms)
        for batch in batches:
            y, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lent = [(k, c) for k, t in zip(y, texts) for c in carriers(t or "", params)]
            for own, carrier, column in ((y, False, batch.column(1)), ([k for k, _ in lent], True, pa.array([c for _, c in lent], pa.string()))):
                for first, s in _features(column):
                    pairs = [counterfactual_pairs(t.as_py() or "", swap) for t in column.slice(first, s.rows)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[first: first + s.rows], pa.int32()), pa.array([carrier] * s.rows), *pack(s),
                         pa.array([[c.tobytes() for c, _ in p] for p in pairs], pa.list_(pa.binary())),
                         pa.array([[v.tobytes() for _, v in p] for p in pairs], pa.list_(pa.binary()))], schema.names)

    got = _one_text_each(docs, sample, id_col, text_col).mapInArrow(run, schema).toArrow()
    y = got["y"].to_numpy().astype(float) if got.num_rows else np.zeros(0)
    carrier = np.array(got["carrier"].to_pylist(), dtype=bool)
    cols = [np.frombuffer(c, np.int32) for row in got["pair_col"].to_pylist() for c in row]
    values = [np.frombuffer(v, np.float32) for row in got["pair_value"].to_pylist() for v in row]
    pairs = Sparse(np.repeat(np.arange(len(cols)), [len(c) for c in cols]),
                   np.concatenate([np.zeros(0, np.int64), *cols]), np.zeros(0), len(cols))
    return ToxicSample(unpack(got["col"], got["n"]), y, np.where(carrier, params.carrier_weight, 1.0), pairs,
                       np.concatenate([np.zeros(0), *values]))


def fit_sample(sample: ToxicSample, params: ToxicityParams = ToxicityParams()) -> Linear:
    """The model of a sample. Features are chosen on whole texts; those of the
    identity terms are always among them."""
    whole = np.flatnonzero(sample.weight == 1.0)
    most = min(params.features, int(params.features_per_row * len(whole)))
    chosen = chosen_features(sample.counts.take(whole), sample.y[whole], most)
    if len(chosen):
        named = [s.col for _, s in _features(pa.array([t for kind in params.terms for t in kind], pa.string()))]
        chosen = np.unique(np.concatenate([chosen, *named]))
    return fit(sample.counts, sample.y, weight=sample.weight, features=chosen, pairs=sample.pairs,
               pair_values=sample.pair_values, pair_penalty=params.pair_penalty)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 params: ToxicityParams = ToxicityParams()) -> Linear:
    """The model, from a bounded sample of the rows outside the held-out fold."""
    return fit_sample(toxicity_sample(docs, labels, id_col, text_col, params), params)


def counterfactual_gap(docs: DataFrame, labels: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text",
                       params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """One row: ``pairs`` and ``gap``, the mean change of the score when the
    identity terms of carriers of held-out labelled texts are swapped."""
    ids = (labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) == 0))
           .select(F.col(id_col).alias("_id")).distinct())
    rows = small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(ids, "_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = swapper(params.terms)
        for batch in batches:
            said = [c for t in batch.column(0).to_pylist() for c in carriers(t or "", params)]
            both = []
            for sentences in (said, [swap(c) or c for c in said]):
                both.append(np.concatenate([np.zeros(0), *[sigmoid(model.logits(s)) for _, s in _features(pa.array(sentences, pa.string()))]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.abs(both[0] - both[1]))], ["change"])

    return rows.select("text").mapInArrow(run, "change double").agg(F.count("change").alias("pairs"), F.avg("change").alias("gap"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                   params: ToxicityParams = ToxicityParams(), model: Linear | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1) and
    ``predicted`` (1 from 0.5 on). Only the text enters a score."""
    model = model or fit_toxicity(docs, labels, id_col, text_col, params)
    at = np.flatnonzero(model.slot >= 0).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((at, model.slot[at], model.weights, model.bias))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, weights, bias = shared.value
        slot = np.full(BUCKETS, -1, dtype=np.int32)
        slot[at] = number
        own = Linear(slot, weights, bias)
        for batch in batches:
            for block in blocks(batch.column(2)):
                score = sigmoid(own.score_items(*word_features(block, PREFIXES), block.n_texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts),
                     batch.column(1).slice(block.first, block.n_texts), pa.array(score),
                     pa.array((score >= 0.5).astype(np.int32))], schema.names)

    held = F.coalesce(fold(F.col(id_col)) == 0, F.lit(True))
    return small_batches(docs).select(F.col(id_col), held.alias("_held"), F.col(text_col)).mapInArrow(run, schema)
