"""Whitening, top-k search and collocations against brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phaselens.llm import collocations, topk, whitening
from phaselens.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, component int, score double"


def odd_vectors(spark, seed=3, d=6):
    """Null ids and vectors, entries that are null or no number, other
    lengths, repeated rows and clashing column names."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((60, d)) @ np.diag(np.arange(1, d + 1)) / 4
    rows = [(i, [float(v) for v in x[i]], 1, 0.5) for i in range(60)]
    rows += [rows[50], rows[50], rows[0], (100, rows[50][1], 2, None), (None, rows[7][1], None, None), (61, None, 0, 0.0), (150, [], 0, 0.0),
             (200, [None] + [1.0] * (d - 1), 1, 1.0), (250, [float("nan")] * d, 1, 1.0), (300, [float("inf")] * d, 1, 1.0),
             (350, [1.0] * (d + 2), 1, 1.0), (351, [0.5] * (d + 2), 1, 1.0)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def whole_vectors(df, d=None):
    out = []
    for r in df.collect():
        v = r["embedding"]
        if v and all(x is not None and np.isfinite(x) for x in v) and (d is None or len(v) == d):
            out.append((r["vec_id"], np.array(v, dtype=np.float64)))
    return out


# ---------------------------------------------------------------- whitening

def check_whitening(df, got, k, d):
    rows = whole_vectors(df, d)
    n = len(rows)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    s = x.sum(axis=0)
    exact = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x], dtype=np.float64)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    z = centred @ u / np.sqrt(e)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    for j in range(k):
        mine = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], r["whitened"]) for r in got if r["component"] == j + 1)
        for sign in (1, -1):
            theirs = sorted((i is None, i or 0, dev, w) for (i, _), dev, w in zip(rows, exact, sign * z[:, j]))
            if np.allclose([m[3] for m in mine], [t[3] for t in theirs], atol=1e-9):
                break
        else:
            raise AssertionError(f"component {j + 1}")
        assert [m[:3] for m in mine] == [t[:3] for t in theirs]
        assert np.isclose(next(r["explained"] for r in got if r["component"] == j + 1), e[j] / np.trace(v), rtol=1e-10)
    error = {r["identity_error"] for r in got}
    assert len(error) == 1 and error.pop() < 1e-9


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(df, llm_queries.op11_chebyshev_whitening(spark, SF).collect(), 32, 64)


def test_whitening_of_odd_rows(spark):
    df = odd_vectors(spark)
    check_whitening(df, whitening.whiten(df).collect(), 6, 6)
    few = whitening.whiten(df, params=whitening.Whitening(components=2, guard=1)).collect()
    check_whitening(df, few, 2, 6)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 50")).count() == 0  # equal vectors: nothing to whiten
    assert whitening.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("name", ["flat", "steep", "clustered", "wide", "rank"])
def test_leading_pairs_of_hard_spectra(name):
    rng = np.random.default_rng(5)
    x = {"flat": rng.standard_normal((4000, 80)), "steep": rng.standard_normal((500, 90)) * 0.7 ** np.arange(90),
         "clustered": rng.standard_normal((600, 70)) * np.repeat([9.0, 3.0, 1.0], [2, 28, 40]),
         "wide": rng.standard_normal((300, 400)) * 0.99 ** np.arange(400),
         "rank": rng.standard_normal((200, 5)) @ rng.standard_normal((5, 64))}[name]
    c = x - x.mean(axis=0)
    v = c.T @ c / len(c)
    passes = []

    def apply(q):
        passes.append(1)
        return c.T @ (c @ q) / len(c)

    e, u, residual = whitening.leading_pairs(apply, x.shape[1], whitening.Whitening())
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:32], atol=1e-11 * e[0])
    assert np.abs(v @ u - u * e).max() < 1e-11 * e[0] and np.abs(u.T @ u - np.eye(32)).max() < 1e-12
    assert residual <= 1e-9 * e[0] and len(passes) < 200


def test_deviation_past_64_bits_is_null(spark):
    f = whitening._Fit(3_000_000_000, [3_000_000_000 * 1_000_000])
    got = f.deviation(np.array([[1_000_000], [1_000_001], [1_000_002]]))
    assert got.to_pylist() == [0, 9 * 10 ** 18, None]


# ------------------------------------------------------------------- search

def brute_search(rows, k, every):
    out = Counter()
    ints = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if i is not None]
    for a, (i, q) in enumerate(ints):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ints) if a != b and len(v) == len(q))
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1))
    return out


def found(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_search_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert found(llm_queries.op13_block_pruned_topk(spark, SF)) == brute_search(whole_vectors(df), 5, 50)


@pytest.mark.parametrize("params", [topk.Search(), topk.Search(block_rows=4, shard_blocks=3, chunk_queries=2),
                                    topk.Search(k=100, block_rows=8), topk.Search(k=1, every=1, block_rows=2)])
def test_search_of_odd_rows(spark, params):
    df = odd_vectors(spark)
    assert found(topk.search(df, params=params)) == brute_search(whole_vectors(df), params.k, params.every)
    assert topk.search(df.limit(0), params=params).count() == 0
    assert topk.search(df.where("vec_id = 1"), params=params).count() == 0


def test_search_prunes_blocks_and_keeps_ties(spark):
    """Groups far apart: a cell is sent and scores few blocks; a third of all
    vectors equal: ties go to the smaller ids."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    x = np.repeat(centres, 100, axis=0) + 0.02 * rng.standard_normal((2000, 16))
    x[rng.permutation(2000)[:700]] = centres[0]
    df = spark.createDataFrame([(int(i), [float(c) for c in x[i]]) for i in rng.permutation(2000)], "vec_id long, embedding array<float>")
    rows = whole_vectors(df)
    params = topk.Search(block_rows=25)
    assert found(topk.search(df, params=params)) == brute_search(rows, 5, 50)
    table = df.coalesce(1).select("vec_id", "embedding").mapInArrow(topk._blocks(params), topk.BLOCK)
    asked = table.where("queries > 0").mapInArrow(topk._queries(params), topk.QUERY).withColumn("chunk", F.lit(0)).withColumn("shard", F.lit(0))
    all_, queries = table.toArrow(), asked.toArrow()
    chunk, (high, low) = topk._Chunk(queries), topk._maxima(all_)
    walked = (chunk.bounds(slice(None), high, low) >= chunk.floor[:, None]).sum()
    assert walked < 0.35 * len(queries) * len(all_), (walked, len(queries), len(all_))


def test_search_of_large_numbers(spark):
    """Products beyond 2^53 are not taken in floats."""
    rows = [(0, [2.0 ** 20, 1.0, 3.0]), (1, [2.0 ** 20, 0.0, 0.0]), (2, [2.0 ** 20, 1.0, 0.0]), (3, [-2.0 ** 20, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk.search(df)) == brute_search(whole_vectors(df), 5, 50)


# ------------------------------------------------------------- collocations

def brute_collocations(rows, p):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, p.most_words + 1):
                counts.update((lang, tuple(w[i: i + k])) for i in range(len(w) - k + 1))
    chosen = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= p.least}
    out = []
    for lang in totals:
        own = {w: a for (g, w), a in chosen.items() if g == lang}
        around = Counter()
        for w, a in own.items():
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    if j - i < len(w):
                        around[w[i:j]] = max(around[w[i:j]], a)
        best = []
        for w, a in own.items():
            if 100 * around[w] >= p.inside_percent * a:
                continue
            cuts = [(p.scale * a // (counts[lang, w[:c]] + counts[lang, w[c:]]), c) for c in range(1, len(w))]
            score, c = min(cuts)
            best.append((-score, -a, " ".join(w).encode(), counts[lang, w[:c]], counts[lang, w[c:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], totals[lang], -x[0]) for i, x in enumerate(sorted(best)[: p.top], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_of_the_table(spark):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = mined(llm_queries.op12_trie_collocations(spark, SF))
    assert got == brute_collocations(rows, collocations.Phrases()) and got
    with duckdb.connect() as con:
        con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
        assert sorted(con.sql(collocations.ORACLE_SQL).fetchall()) == got


@pytest.mark.parametrize("params", [
    collocations.Phrases(least=2), collocations.Phrases(least=3, max_phrases=40, combine=16, bitmap_bits=8, top=7),
    collocations.Phrases(least=1, most_words=3)])
def test_collocations_of_odd_rows(spark, params):
    rng = np.random.default_rng(2)
    words = ["Der", "hund", "été", "ÉTÉ", "a", "b", "c-d", "x y", "名", "the"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 30)))) + str(rng.choice([".", " ,b a", "\nb\t\ta", "!?", ""])) for _ in range(80)]
    rows = [(t, str(rng.choice(["en", "de"])), 1) for t in texts]
    rows += [(None, "en", 2), ("", None, 3), ("a b a b", None, 4), ("a b a b", "und", 5), ("a b a b", "", 6), ("\n \t;", "fr", 7), (rows[0][0], rows[0][1], 1)]
    rows += [(" ".join(["the"] * 3000), "de", 8), ("a.b,c", "en", 9)]
    df = spark.createDataFrame(rows, "text string, lang string, rank int").repartition(4)
    expected = brute_collocations([r[:2] for r in rows], params)
    assert mined(collocations.collocations(df, params=params)) == expected
    assert collocations.collocations(df.limit(0), params=params).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_double_array_holds_exactly_its_phrases(seed):
    rng = np.random.default_rng(seed)
    top = [3, 40, 2000, 9][seed]
    rows = {tuple(rng.integers(1, top + 1, int(rng.integers(1, 5))).tolist()) for _ in range([30, 800, 4000, 3000][seed])}
    rows |= {(1, x) for x in range(1, top + 1)}
    words = np.array([list(r) + [0] * (4 - len(r)) for r in rows])
    trie = collocations.build_trie(words)
    probe = np.vstack([words, rng.integers(0, top + 2, (3000, 4))])
    ends = np.full(len(probe), -1)
    for i, r in enumerate(probe.tolist()):
        at = 0
        for c in r:
            if c == 0:
                break
            at = int(trie.advance(np.array([at]), np.array([c]))[0])
            if at < 0:
                break
        ends[i] = trie.phrase[at] if at > 0 else -1
    number = {tuple(w): i for i, w in enumerate(words.tolist())}
    for i, r in enumerate(probe.tolist()):
        cut = r[: r.index(0)] if 0 in r else r
        assert ends[i] == number.get(tuple(cut + [0] * (4 - len(cut))), -1)


# -------------------------------------------------- clashing helper columns

def test_row_returning_operators_allow_any_column_name(spark):
    """Columns named like the operators' own helper columns come back as they
    were."""
    from phaselens.llm import cotrain, minhash, mixing

    names = ["_row", "_id", "_md5", "_keep_id", "_keep_md5", "_q", "_leaf", "_key", "_worded", "_epoch", "domain", "budget", "digest", "root"]
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[i % 5:] + [f"own{i % 7}"]), "en", f"s{i % 3}", 9, *[f"{n}{i}" for n in names]) for i in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    given = {r["doc_id"]: tuple(r) for r in df.collect()}
    for out in (minhash.keep_one(df), mixing.mixed_rows(df), cotrain.keep_good(df, marks)):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(tuple(r) == given[r["doc_id"]] for r in got)
