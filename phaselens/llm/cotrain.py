"""Quality classifier by co-training.

Two classifiers see a page from two sides: one the text's words (their
beginnings and ends, and words repeated at once), the other the page's
metadata (source, language, declared length and the layout: lines, line and
word lengths, shares of byte classes). Both start from a bounded labelled
sample. In each round both score *all* documents outside the sample and the
held-out fold; either one labels those that it is surest of, as many of each
class as their share in the labelled sample asks for, and the *other* one
learns them. A task keeps the surest of its rows, so a round is one pass over
the table and returns ``grow`` rows a view, whatever the corpus size.
Afterwards each view's score is calibrated on labelled rows that it did not
learn, the calibrated log-odds of both views are combined on the same rows, and
a map over the scan scores every document.

Input cases: null and empty texts are scored by their metadata and the text
model's constant; a null source, language or length is a value of its own;
null ids are scored and never learnt from; of several rows with one labelled
id one is learnt from (of least hash), so the sample is bounded in rows, and of
equal documents one takes a pseudo-label; a table without labels, or with
labels of one class only, gives a constant; repeated rows and extra columns
are kept apart per row; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaselens.llm.learn import (BUCKETS, Linear, Sparse, chosen_features, counted, fit, fold, labelled_sample, pack,
                                 sigmoid, unpack, word_features)
from phaselens.llm.textops import SPACE, U64, Block, blocks, mix64, small_batches, whole_row

PREFIXES, SUFFIXES = (4, 6), (2, 3)


@dataclass(frozen=True)
class CoTraining:
    """``max_good`` / ``max_bad``: labelled rows used at most; ``grow``:
    pseudo-labels a round and view; ``sure``: least log-odds of one (9 to 1);
    ``reject_below``: documents with a lower score are rejected."""
    max_good: int = 3500
    max_bad: int = 2500
    rounds: int = 2
    grow: int = 300
    sure: float = 2.2
    features: int = 3000
    reject_below: float = 0.3


def layout(block: Block) -> np.ndarray:
    """Layout of each text, one row of numbers from 0 to 31 each: bins of its
    bytes, words, lines, bytes a line, bytes a word, and of the shares of white
    space, digits, capitals, punctuation and bytes beyond ASCII."""
    start, end, text = block.words()
    size = np.diff(block.offsets)
    sums = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][block.offsets])
    d = block.data
    words = block.per_text(text)
    lines = sums(d == 0x0A) + 1
    letter = ((d >= 97) & (d < 123)) | ((d >= 65) & (d < 91)) | (d >= 128)
    digit = (d >= 48) & (d < 58)
    log_bin = lambda x: np.floor(2 * np.log2(1 + x))
    share = lambda mask: np.floor(24 * np.sqrt(sums(mask) / np.maximum(size, 1)))
    fine = np.floor(2 * size / np.maximum(words, 1))
    cols = [log_bin(size), log_bin(words), log_bin(lines), log_bin(size / lines), np.minimum(fine, 31), share(SPACE[d]),
            share(digit), share((d >= 65) & (d < 91)), share(~letter & ~digit & ~SPACE[d]), share(d >= 128)]
    return np.minimum(np.stack(cols, axis=1), 31).astype(np.int64)


def metadata_features(block: Block, source: list, lang: list, length: list) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text index) of the metadata view, one feature a field, and
    pairs of layout fields."""
    lay = layout(block)
    named = [pd.util.hash_array(np.array([f"{k}={v}" for v in values], dtype=object)).astype(U64)
             for k, values in (("source", source), ("lang", lang))]
    declared = np.array([-1.0 if v is None else float(v) for v in length])
    named.append(np.where(declared < 0, 63, np.floor(2 * np.log2(1 + np.maximum(declared, 0)))).astype(U64) + U64(1 << 50))
    for j in range(lay.shape[1]):
        named.append(lay[:, j].astype(U64) + U64((j + 2) << 40))
    for j in (3, 4, 8):
        named.append((lay[:, j] * 32 + lay[:, 5]).astype(U64) + U64((j + 32) << 40))
    feats = np.stack([mix64(x) % U64(BUCKETS) for x in named], axis=1).astype(np.int64)
    return feats.ravel(), np.repeat(np.arange(block.n_texts), feats.shape[1])


def _both(block: Block, batch: pa.RecordBatch, at: tuple[int, int, int]):
    """The items of both views for the texts of a block."""
    own = [batch.column(i).slice(block.first, block.n_texts).to_pylist() for i in at]
    return word_features(block, PREFIXES, SUFFIXES, repeats=True), metadata_features(block, *own)


@dataclass(frozen=True)
class QualityModel:
    """Two views and the combination of their logits: ``mix`` = (weight of the
    text view, weight of the metadata view, constant)."""
    text: Linear
    meta: Linear
    calibration: tuple[tuple[float, float], tuple[float, float]]
    mix: tuple[float, float, float]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, calibrated text view, calibrated metadata view) from logits."""
        (a, b), (c, d) = self.calibration
        x, y = a * text + b, c * meta + d
        return sigmoid(self.mix[0] * x + self.mix[1] * y + self.mix[2]), sigmoid(x), sigmoid(y)


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Non-negative slopes and a constant that make sum(slope * z) + constant
    log-odds of ``y``; z is (rows, views). Newton steps with a small ridge."""
    x = np.column_stack([z, np.ones(len(z))])
    if len(y) == 0 or y.min() == y.max():
        return np.r_[np.full(z.shape[1], 1.0 / z.shape[1]), 0.0]
    w = np.r_[np.full(z.shape[1], 0.5), 0.0]
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w[:-1] = np.clip(w[:-1], 0.0, 20.0)
    return w


@dataclass(frozen=True)
class Pseudo:
    """A document that one view labels for the other: a key of the document,
    the learning view, the label, and that view's features and counts."""
    key: int
    student: int
    label: int
    col: np.ndarray
    n: np.ndarray


def _with(s: Sparse, more: list[Pseudo]) -> Sparse:
    """The texts of ``s`` and then those of the pseudo-labels."""
    size = [len(m.col) for m in more]
    return Sparse(np.concatenate([s.row, s.rows + np.repeat(np.arange(len(more)), size)]).astype(np.int64),
                  np.concatenate([s.col, *[m.col for m in more]]).astype(np.int64),
                  np.concatenate([s.n, *[m.n for m in more]]), s.rows + len(more))


def quotas(params: CoTraining, share: float) -> dict[int, int]:
    """Pseudo-labels of each class a round and view."""
    good = int(round(params.grow * share))
    return {1: good, 0: params.grow - good}


def co_train(views: tuple[Sparse, Sparse], y: np.ndarray, calibrate: np.ndarray, params: CoTraining,
             surest: Callable[[list[Linear], dict[int, int], dict[int, set[int]]], list[Pseudo]]) -> QualityModel:
    """Both views over the same labelled texts; ``calibrate`` marks those kept
    for calibration. ``surest(models, quotas, taken)`` gives a round's
    pseudo-labels; ``taken``: the keys that each view has learnt already."""
    learn = np.flatnonzero(~calibrate)
    target = y[learn].astype(float)
    chosen = [chosen_features(v.take(learn), target, params.features) for v in views]
    own = [v.only(c).take(learn) for v, c in zip(views, chosen)]
    learnt: list[list[Pseudo]] = [[], []]

    def model(k: int) -> Linear:
        labels = np.r_[target, [float(p.label) for p in learnt[k]]]
        # pseudo-labels weigh less than labels
        weight = np.r_[np.ones(len(target)), np.full(len(learnt[k]), 0.5)]
        return fit(_with(own[k], learnt[k]), labels, weight=weight, features=chosen[k], rounds=150)

    models = [model(0), model(1)]
    share = float(target.mean()) if len(target) else 0.5
    for _ in range(params.rounds if 0 < share < 1 else 0):
        for p in surest(models, quotas(params, share), {k: {p.key for p in learnt[k]} for k in (0, 1)}):
            learnt[p.student].append(p)
        models = [model(0), model(1)]
    held = np.flatnonzero(calibrate)
    z = np.column_stack([m.logits(v.take(held)) for m, v in zip(models, views)])
    target = y[held].astype(float)
    each = [platt(z[:, [k]], target) for k in (0, 1)]
    both = platt(np.column_stack([each[k][0] * z[:, k] + each[k][1] for k in (0, 1)]), target)
    return QualityModel(models[0], models[1], tuple((float(w[0]), float(w[1])) for w in each),
                        tuple(float(x) for x in both))


_COLUMNS = ("text", "source", "lang", "length")


def _rows(docs: DataFrame, names: tuple[str, str, str, str, str]) -> DataFrame:
    """id, text, source, lang, length and a key that equal documents share."""
    id_col, *rest = names
    return (small_batches(docs).select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for c, n in zip(rest, _COLUMNS)])
            .withColumn("key", F.xxhash64(*_COLUMNS)))


def surest_rows(rows: DataFrame, models: list[Linear], quota: dict[int, int], taken: dict[int, set[int]], sure: float) -> list[Pseudo]:
    """For either view, the documents of ``rows`` (text, source, lang, length,
    key) that the other view is surest of: those of the largest absolute
    log-odds, of equal ones those of least key. One pass; a task returns its
    own surest only."""
    packed = []
    for m in models:
        at = np.flatnonzero(m.slot >= 0).astype(np.int32)
        packed.append((at, m.slot[at], m.weights, m.bias))
    shared = rows.sparkSession.sparkContext.broadcast((packed, {k: np.array(sorted(v), np.int64) for k, v in taken.items()}))
    schema = "student int, label int, sureness double, key long, col binary, n binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = []
        for at, number, weights, bias in shared.value[0]:
            slot = np.full(BUCKETS, -1, dtype=np.int32)
            slot[at] = number
            views.append(Linear(slot, weights, bias))
        best: dict[tuple[int, int], dict[int, tuple]] = {(s, c): {} for s in (0, 1) for c in quota if quota[c]}
        floor = {k: sure for k in best}
        for batch in batches:
            key = batch.column(4).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(0)):
                items = _both(block, batch, (1, 2, 3))
                own = key[block.first: block.first + block.n_texts]
                z = [v.score_items(*i, block.n_texts) for v, i in zip(views, items)]
                for (student, label), kept in best.items():
                    sureness = z[1 - student] if label else -z[1 - student]
                    here = np.flatnonzero((sureness > sure) & (sureness >= floor[student, label]) & ~np.isin(own, shared.value[1][student]))
                    here = here[np.lexsort((own[here], -sureness[here]))][: quota[label]]
                    here = here[[int(k) not in kept for k in own[here].tolist()]] if len(here) else here
                    if not len(here):
                        continue
                    feats, owner = items[student]
                    mine = np.full(block.n_texts, -1)
                    mine[here] = np.arange(len(here))
                    keep = (mine[owner] >= 0) & (views[student].slot[feats] >= 0)
                    cols, ns = pack(counted(feats[keep], mine[owner[keep]], len(here)))
                    for i, c, n in zip(here.tolist(), cols.to_pylist(), ns.to_pylist()):
                        kept[int(own[i])] = (float(sureness[i]), c, n)
                    if len(kept) > quota[label]:
                        order = sorted(kept, key=lambda k: (-kept[k][0], k))[: quota[label]]
                        best[student, label] = {k: kept[k] for k in order}
                        floor[student, label] = kept[order[-1]][0]
        for (student, label), kept in best.items():
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([student] * len(kept), pa.int32()), pa.array([label] * len(kept), pa.int32()),
                     pa.array([v[0] for v in kept.values()]), pa.array(list(kept), pa.int64()),
                     pa.array([v[1] for v in kept.values()], pa.binary()), pa.array([v[2] for v in kept.values()], pa.binary())],
                    ["student", "label", "sureness", "key", "col", "n"])

    found = rows.select(*_COLUMNS, "key").mapInArrow(run, schema).dropDuplicates(["student", "label", "key"])
    place = Window.partitionBy("student", "label").orderBy(F.desc("sureness"), "key")
    most = F.when(F.col("label") == 1, quota[1]).otherwise(quota[0])
    first = found.withColumn("_i", F.row_number().over(place)).where(F.col("_i") <= most).orderBy("student", "label", "_i")
    return [Pseudo(r["key"], r["student"], r["label"], np.frombuffer(r["col"], np.int32), np.frombuffer(r["n"], np.uint16))
            for r in first.select("student", "label", "key", "col", "n").collect()]


def fit_quality(docs: DataFrame, labels: DataFrame, params: CoTraining = CoTraining(), id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                length_col: str = "n_chars") -> QualityModel:
    """The model: labels from a bounded sample of rows outside the held-out
    fold, pseudo-labels from all other rows outside it."""
    labelled = labelled_sample(labels, id_col, "quality", {1: params.max_good, 0: params.max_bad})
    sample = labelled.toArrow()  # bounded by max_good + max_bad ids
    sample = docs.sparkSession.createDataFrame(sample, labelled.schema)
    rows = _rows(docs, (id_col, text_col, source_col, lang_col, length_col))
    one = (rows.join(F.broadcast(sample.withColumnRenamed("_id", "id")), "id").groupBy("id")
           .agg(F.first("_y").alias("y"), F.min_by(F.struct(*_COLUMNS), "key").alias("_r")))
    calibrate = F.crc32(F.concat(F.lit("calibrate"), F.col("id").cast("string")).cast("binary")) % 4 == 0
    chosen = one.select("y", calibrate.alias("calibrate"), "_r.*")
    names = ["y", "calibrate", "text_col", "text_n", "meta_col", "meta_n"]
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("calibrate", T.BooleanType())]
                          + [T.StructField(n, T.BinaryType()) for n in names[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                packed = [x for v in _both(block, batch, (3, 4, 5)) for x in pack(counted(*v, block.n_texts))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(block.first, block.n_texts) for i in (0, 1)] + packed, names)

    got = chosen.mapInArrow(run, schema).toArrow()
    y = got["y"].to_numpy() if got.num_rows else np.zeros(0, int)
    held = np.array(got["calibrate"].to_pylist(), dtype=bool)
    views = unpack(got["text_col"], got["text_n"]), unpack(got["meta_col"], got["meta_n"])
    del got
    others = (rows.where(F.col("id").isNotNull() & (fold(F.col("id")) != 0))
              .join(F.broadcast(sample.select(F.col("_id").alias("id"))), "id", "left_anti"))
    return co_train(views, y, held, params, lambda models, quota, taken: surest_rows(others, models, quota, taken, params.sure))


def quality_scorer(spark, model: QualityModel, text: Column, source: Column, lang: Column, length: Column) -> Column:
    """A column (score, text_view, meta_view) for each row."""
    packed = []
    for view in (model.text, model.meta):
        at = np.flatnonzero(view.slot >= 0).astype(np.int32)
        packed.append((at, view.slot[at], view.weights, view.bias))
    shared = spark.sparkContext.broadcast((packed, model.calibration, model.mix))

    @F.pandas_udf("struct<score:double,text_view:double,meta_view:double>")
    def scored(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        views = []
        for at, number, weights, bias in shared.value[0]:
            slot = np.full(BUCKETS, -1, dtype=np.int32)
            slot[at] = number
            views.append(Linear(slot, weights, bias))
        own = QualityModel(*views, *shared.value[1:])
        for series in columns:
            batch = pa.RecordBatch.from_arrays([pa.array(s, from_pandas=True) for s in series], ["t", "s", "l", "n"])
            parts = []
            for block in blocks(batch.column(0)):
                z = [v.score_items(*items, block.n_texts) for v, items in zip(views, _both(block, batch, (1, 2, 3)))]
                parts.append(np.stack(own.scores(*z), axis=1))
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 3)),
                               columns=["score", "text_view", "meta_view"])

    return scored(text, source, lang, length)


def score_quality(docs: DataFrame, labels: DataFrame, *, params: CoTraining = CoTraining(),
                  model: QualityModel | None = None, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (chance of
    good quality), the calibrated score of either view, and ``kept``."""
    model = model or fit_quality(docs, labels, params, id_col, text_col, source_col, lang_col, length_col)
    scored = quality_scorer(docs.sparkSession, model, F.col(text_col), F.col(source_col), F.col(lang_col),
                            F.col(length_col))
    return (small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(True)).alias("held_out"),
                        scored.alias("_q"))
            .select("doc_id", "held_out", "_q.score", "_q.text_view", "_q.meta_view",
                    (F.col("_q.score") >= params.reject_below).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, *, params: CoTraining = CoTraining(), **columns) -> DataFrame:
    """The rows and columns of ``docs`` without the rejected documents."""
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang",
             "length_col": "n_chars"} | columns
    model = fit_quality(docs, labels, params, **names)
    scored = quality_scorer(docs.sparkSession, model, *(F.col(names[c]) for c in (
        "text_col", "source_col", "lang_col", "length_col")))
    return (small_batches(docs).select(whole_row(docs), scored.alias("_q"))
            .where(F.col("_q.score") >= params.reject_below).select("_row.*"))
