"""Operators with shuffles or models against brute force: sharding, mixing,
near-duplicates, the classifiers, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phaselens.llm import bpe, cotrain, learn, minhash, mixing, pii, sharding, toxicity
from phaselens.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- sharding

def check_shards(rows, n, shards):
    assert len(rows) == n
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(sizes.get(s, 0) for s in range(shards)) == sorted(n // shards + (s < n % shards) for s in range(shards))
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


@pytest.mark.parametrize("shards,per", [(40, 20), (7, 50), (3, 10 ** 6)])
def test_shard_laws(spark, documents_table, shards, per):
    rows = sharding.shard_documents(documents_table, shards, rows_per_partition=per).collect()
    check_shards(rows, documents_table.count(), shards)
    text = {r["doc_id"]: r["text"] or "" for r in documents_table.collect()}
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        assert r["law"] == "rows" and r["grown_shard"] is None
    again = sharding.shard_documents(documents_table.repartition(5), shards, rows_per_partition=per).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_odd_rows(spark, odd_documents):
    check_shards(sharding.shard_documents(odd_documents, 4, rows_per_partition=3).collect(), odd_documents.count(), 4)
    check_shards(sharding.shard_documents(odd_documents.limit(2), 40).collect(), 2, 40)
    assert sharding.shard_documents(odd_documents.limit(0)).count() == 0


def test_equal_rows_spread_like_others(spark):
    """60,000 wholly equal rows, beside as many others."""
    same = spark.range(60000).selectExpr("cast(null as long) doc_id", "cast(null as string) text")
    df = same.unionByName(spark.range(30000).selectExpr("id doc_id", "concat('t', id) text")).repartition(6)
    out = sharding.shard_documents(df, 8, rows_per_partition=1000).cache()
    check_shards(out.select("shard", "slot").collect(), 90000, 8)
    sizes = sorted(r["count"] for r in out.where("doc_id is null").groupBy("source_partition").count().collect())
    assert len(sizes) > 50 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    per_shard = [r["count"] for r in out.where("doc_id is null").groupBy("shard").count().collect()]
    assert len(per_shard) == 8 and max(per_shard) < 1.1 * min(per_shard)


def test_texts_are_read_once(spark, documents_table):
    """The result reads the narrow table only."""
    plan = sharding.shard_documents(documents_table)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "_key" in plan


def test_hypergeometric_law(spark):
    """Draws over an even grid of uniforms give the exact probabilities."""
    from math import comb
    grid = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    for n, good, total in ((10, 6, 20), (3, 3, 5), (7, 30, 31), (0, 4, 9), (5, 0, 9), (6, 9, 9)):
        got = Counter(r[0] for r in grid.select(
            sharding.hypergeometric(F.lit(n), F.lit(good), F.lit(total), F.col("u"))).collect())
        for k in range(0, n + 1):
            p = comb(good, k) * comb(total - good, n - k) / comb(total, n) if n - k <= total - good else 0
            assert abs(got.get(k, 0) / 4000 - p) < 0.002, (n, good, total, k)


def test_every_order_is_as_likely(spark):
    """Where one document lands is uniform over shards and slots."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "doc_id long, text string")
    seen = Counter()
    for seed in range(60):
        for r in sharding.shard_documents(docs, 3, seed=seed * 10, rows_per_partition=4).collect():
            if r["doc_id"] in (0, 7):
                seen[(r["shard"], r["slot"])] += 1
    expected = 120 / 12
    assert len(seen) == 12 and sum((c - expected) ** 2 / expected for c in seen.values()) < 35


def test_sharding_plan_is_native(spark, documents_table):
    plan = sharding.shard_documents(documents_table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ mixing

def brute_fill(budget, children):
    """Water-filling by repeated sharing: children (name, cap, weight)."""
    out, left, open_ = {}, budget, list(children)
    while open_:
        total = sum(w for _, _, w in open_)
        full = [c for c in open_ if c[1] * total <= left * c[2]]
        if not full:
            return out | {n: left * w // total for n, _, w in open_}
        first = min(full, key=lambda c: (c[1] / c[2], c[0]))
        out[first[0]] = first[1]
        left -= first[1]
        open_.remove(first)
    return out


def test_budget_shares_shortages_among_siblings_first(spark):
    leaves = [("d0", "en", "a", 100, 5), ("d0", "en", "b", 5000, 9), ("d0", "fr", "a", 10, 2), ("d1", "en", "c", 300, 3),
              ("d1", "de", "x", 40, 2), ("d2", "es", "z", 900, 4), ("d2", "es", "y", 0, 1)]
    mix = mixing.Mix(max_epochs=2, budget_percent=90)
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long, n_docs long")
    got = {(r["domain"], r["lang"], r["source"]): r for r in mixing.plan_budget(df, mix).collect()}
    w = lambda level, k: mix.weights.get(level, {}).get(k, 1)
    cap = defaultdict(int)
    for d, l, s, supply, _ in leaves:
        for key in ((d,), (d, l), (d, l, s)):
            cap[key] += 2 * supply
    total = sum(x[3] for x in leaves) * 90 // 100
    top = brute_fill(total, [(d, cap[(d,)], w("domain", d)) for d in ("d0", "d1", "d2")])
    for d in top:
        mid = brute_fill(top[d], [(k[1], c, w("lang", k[1])) for k, c in cap.items() if len(k) == 2 and k[0] == d])
        for l in mid:
            low = brute_fill(mid[l], [(k[2], c, w("source", k[2])) for k, c in cap.items() if len(k) == 3 and k[:2] == (d, l)])
            for s, b in low.items():
                r = got[(d, l, s)]
                assert r["budget"] == b
                if r["supply"]:
                    assert (r["full_epochs"], r["rest"]) == divmod(b, r["supply"])


@pytest.mark.parametrize("per_range", [3, 8192])
def test_mixture_equals_sql_and_budget(spark, documents_table, per_range):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    expected = {r[0]: r[-1] for r in con.execute(mixing.ORACLE_SQL).fetchall()}
    mix = mixing.Mix(rows_per_range=per_range)
    rows = mixing.mix_documents(documents_table, mix=mix).collect()
    assert {r["doc_id"]: r["copies"] for r in rows} == expected
    out = Counter(r["doc_id"] for r in mixing.mixed_rows(documents_table, mix=mix).collect())
    assert out == Counter({k: v for k, v in expected.items() if v})


def test_mixing_odd_rows(spark, odd_documents):
    rows = mixing.mix_documents(odd_documents, mix=mixing.Mix(budget_percent=300)).collect()
    assert len(rows) == odd_documents.count()
    assert all(r["copies"] == 0 for r in rows if r["n_tokens"] == 0) and any(r["copies"] for r in rows)
    assert mixing.mixed_rows(odd_documents).columns == odd_documents.columns
    assert mixing.mix_documents(odd_documents.limit(0)).count() == 0
    assert mixing.mixed_rows(odd_documents.limit(0)).count() == 0


# --------------------------------------------------------- near-duplicates

def shingles(text, k=5):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) or (
        frozenset([tuple(words)]) if words else frozenset())


def brute_components(rows, percent):
    """Index of row -> root index; all pairs that share a shingle are tried."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and 100 * both >= percent * (len(a) + len(b) - both) and both:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], sets


def near_copies(n_groups=4, size=25, seed=3):
    """Groups of copies of one text with a few words changed, more or fewer."""
    rng = random.Random(seed)
    out = []
    for g in range(n_groups):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(160)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 6)}"
            out.append(" ".join(words))
    return out


def test_near_duplicates_equal_brute_force(spark, documents_table):
    texts = near_copies() + [r["text"] for r in documents_table.select("text").collect()]
    rows = list(enumerate(texts))
    roots, sets = brute_components(rows, 85)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, params=minhash.NearDup(percent=85)).collect()}
    assert len(got) == len(rows)
    for (i, _), r, s in zip(rows, roots, sets):
        assert got[i]["n_shingles"] == len(s)
        assert got[i]["component_id"] == least[r], i
        assert got[i]["kept"] == (least[r] == i)


def form_texts(n, seed=1):
    """Letters of one form: every fifth of 100 words has two choices."""
    rng = random.Random(seed)
    return [" ".join(f"word{i}{rng.choice('ab')}" if i % 5 == 0 else f"word{i}" for i in range(100)) for _ in range(n)]


def cells_of(spark, texts, p):
    """(members of cells with near sketches, links, sets), every class a
    component."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    classes = (minhash.signatures(df, "doc_id", "text", p).where("digest is not null").dropDuplicates(["digest"])
               .withColumnRenamed("n_shingles", "n").cache())
    shared = classes.select(F.explode("bands").alias("band"), "digest", F.col("digest").alias("root"))
    near = minhash.near_members(shared, classes, p).cache()
    sets = minhash._class_sets(df, "doc_id", "text", classes.select("digest", "doc_id", "text_md5"), p)
    return near.collect(), {(bytes(r["a"]), bytes(r["b"])) for r in minhash.cell_links(near, sets, p).collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_form_texts_give_rows_in_proportion(spark, percent):
    """Texts that share half of their shingles: what leaves the cells grows
    with the texts, not with their pairs, and links nothing wrongly."""
    for n in (500, 2000):
        near, links = cells_of(spark, form_texts(n), minhash.NearDup(percent=percent))
        assert len(near) <= 36 * n and len(links) < n


def test_near_copies_without_links_give_rows_in_proportion(spark):
    """Copies of one text, each changed in words of its own, that link with
    nothing: every sketch is near, and no pair leaves a cell."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(600):
        words = list(base)
        for at in rng.sample(range(200), 9):
            words[at] = f"own{k}x{at}"
        texts.append(" ".join(words))
    near, links = cells_of(spark, texts, minhash.NearDup(percent=85))
    assert len(near) <= 36 * len(texts) and not links


@pytest.mark.parametrize("params", [minhash.NearDup(percent=85), minhash.NearDup(percent=85, split_over=20, cell=8),
                                    minhash.NearDup(percent=85, cell=4), minhash.NearDup(percent=80, split_over=4)])
def test_cells_lose_no_link(spark, params):
    """The components of the links are those of all pairs, whatever the sizes
    of cells, and every link is one."""
    texts = sorted(set(near_copies(3, 20) + form_texts(60)))
    _, links = cells_of(spark, texts, params)
    rows = list(enumerate(texts))
    roots, sets = brute_components(rows, params.percent)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    of = {bytes(r["digest"]): r["doc_id"] for r in minhash.signatures(frame, "doc_id", "text", params).collect()}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        both = len(sets[of[a]] & sets[of[b]])
        assert 100 * both >= params.percent * len(sets[of[a]] | sets[of[b]])
        parent[find(of[a])] = find(of[b])
    assert links and len({(find(i), roots[i]) for i in range(len(texts))}) == len(set(roots)) == len({find(i) for i in range(len(texts))})


@pytest.mark.parametrize("similarity,shingles", [(0.85, 60), (0.85, 300), (0.80, 60), (0.80, 300)])
def test_recall_of_bands_and_sketch(similarity, shingles):
    """Measured on random sets just at the similarity: a common band, two
    common bands (as split buckets ask for), and sketches within the limit."""
    p = minhash.NearDup(percent=80)
    signer, rng = minhash.Signer(p), np.random.default_rng(int(100 * similarity) + shingles)
    band = two = near = 0
    for _ in range(300):
        common = int(np.ceil(2 * shingles * similarity / (1 + similarity)))
        x = rng.integers(0, 1 << 63, shingles, dtype=np.int64).astype(np.uint64)
        y = np.r_[x[:common], rng.integers(0, 1 << 63, shingles - common, dtype=np.int64).astype(np.uint64)]
        bands, sketch = signer.fold(np.stack([signer.samples(np.unique(x)), signer.samples(np.unique(y))]))
        same = int((bands[0] == bands[1]).sum())
        band, two = band + (same > 0), two + (same > 1)
        near += int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum()) <= p.near_bits
    assert band == near == 300 and two >= 299


def test_connected_components(spark):
    rng = random.Random(4)
    nodes = [bytes([i]) for i in range(120)]
    edges = [(nodes[i], nodes[i + 1]) for i in range(40)] + [(nodes[50], nodes[i]) for i in range(51, 80)]
    edges += [(rng.choice(nodes[80:]), rng.choice(nodes[80:])) for _ in range(25)]
    edges += edges[:5]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in minhash.connected_components(df).collect()}
    touched = {x for a, b in edges for x in (a, b) if a != b}
    assert got == {n: find(n) for n in touched}


def test_odd_sketch_estimates_similarity():
    p = minhash.NearDup(percent=85)
    signer = minhash.Signer(p)
    rng = np.random.default_rng(0)
    for similarity, low, high in ((0.95, 0, 60), (0.85, 20, 90), (0.5, 100, 256)):
        n = 2000
        common = int(2 * n * similarity / (1 + similarity))
        x = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        y = np.r_[x[:common], rng.integers(0, 1 << 63, n - common, dtype=np.int64).astype(np.uint64)]
        _, sketch = signer.fold(np.stack([signer.samples(np.unique(x)), signer.samples(np.unique(y))]))
        bits = int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum())
        assert low <= bits <= high


def test_texts_that_share_an_id_meet_their_own_class_only(spark):
    base = [[f"w{k}x{i}" for i in range(60)] for k in range(20)]
    texts = [" ".join(w) for b in base for w in (b, [*b, "more"])]
    df = spark.createDataFrame([(i, t) for t in texts for i in (None, 7)] + [(None, texts[0])],
                               "doc_id long, text string")
    p = minhash.NearDup(percent=85)
    classes = (minhash.signatures(df, "doc_id", "text", p).where("doc_id is null")
               .select("digest", "doc_id", "text_md5").distinct())
    met = minhash._class_sets(df, "doc_id", "text", classes, p).collect()
    assert len(met) == len(texts) == len({bytes(r["digest"]) for r in met})
    assert all(hashlib.blake2b(r["shingles"], digest_size=16).digest() == r["digest"] for r in met)
    got = minhash.near_duplicates(df.where("doc_id is null"), params=p).collect()
    assert len(got) == len(texts) + 1 and all(r["component_id"] is None for r in got)
    sig, found = minhash.class_components(df, "doc_id", "text", p)
    assert found.select("root").distinct().count() == 20 and found.count() == 40
    assert sorted(r["text"] for r in minhash.keep_one(df, params=p).collect()) == sorted(
        min((texts[2 * k], texts[2 * k + 1]), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for k in range(20))


def test_near_duplicates_odd_rows(spark, odd_documents):
    got = minhash.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_shingles"] == by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == 0
    assert by_id[1]["kept"] and by_id[2]["kept"]
    assert by_id[6]["component_id"] == 5 and not by_id[6]["kept"]
    assert by_id[8]["n_shingles"] == 1
    kept = minhash.keep_one(odd_documents.unionByName(odd_documents.where("doc_id = 5")))
    assert kept.columns == odd_documents.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == 1 and 6 not in ids and ids[1] == 1 and ids[2] == 1 and ids[8] == 1 and ids[4] == 1
    assert minhash.near_duplicates(odd_documents.limit(0)).count() == 0
    assert minhash.keep_one(odd_documents.limit(0)).count() == 0


# ------------------------------------------------------------- classifiers

@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def ranked_apart(scores, y):
    """Chance that a positive ranks above a negative."""
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n1 = y.sum()
    return (rank[y > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity_held_out_accuracy(spark, labelled, odd_documents):
    docs, labels = labelled
    scored = toxicity.score_toxicity(docs, labels).toPandas()
    assert len(scored) == docs.count()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    assert (scored.predicted == (scored.score >= 0.5)).all() and scored.score.between(0, 1).all()
    held = scored[scored.held_out].merge(labels.toPandas(), on="doc_id")
    assert ranked_apart(held.score.to_numpy(), held.toxic.to_numpy()) > 0.85
    odd = toxicity.score_toxicity(odd_documents, labels).collect()
    assert len(odd) == odd_documents.count()
    assert toxicity.score_toxicity(odd_documents.limit(0), labels).count() == 0
    nothing = toxicity.score_toxicity(odd_documents, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {nothing[0]["score"]}


def test_penalty_acts_on_carriers_of_the_documents(spark, labelled):
    """The texts name no group; sentences cut from them do. The penalty takes
    most of the change of swapped held-out carriers away."""
    docs, labels = labelled
    sample = toxicity.toxicity_sample(docs, labels)
    assert sample.pairs.rows > 100
    gap, weights = {}, {}
    for penalty in (0.0, 4.0):
        params = toxicity.ToxicityParams(pair_penalty=penalty)
        model = toxicity.fit_sample(sample, params)
        row = toxicity.counterfactual_gap(docs, labels, model, params=params).first()
        gap[penalty], weights[penalty] = row["gap"], model.weights
        assert row["pairs"] > 50
    assert gap[4.0] < 0.5 * gap[0.0] and np.abs(weights[0.0] - weights[4.0]).max() > 0.01


def test_carriers_hold_a_term_and_keep_their_length():
    params = toxicity.ToxicityParams(carriers=4, carrier_words=10)
    swap = toxicity.swapper(params.terms)
    text = "One two three four. " + " ".join(f"w{i}" for i in range(100)) + ". Short one."
    said = toxicity.carriers(text, params)
    assert len(said) == 4 and said == toxicity.carriers(text, params)
    assert all(swap(c) not in (None, c) and len(c.split()) <= 10 for c in said)
    assert toxicity.carriers("", params) == toxicity.carriers("a b. c", params) == []


def test_scores_equal_a_dense_fit(spark):
    """A plain dense gradient descent on the same sample gives the scores."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(words, 10) + (["idiot"] if i % 3 == 0 else [])) + ".") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    params = toxicity.ToxicityParams()
    s = toxicity.toxicity_sample(docs, marks, params=params)
    model = toxicity.fit_sample(s, params)
    cols = np.flatnonzero(model.slot >= 0)
    x = np.zeros((s.counts.rows, len(cols)))
    at = {c: j for j, c in enumerate(cols.tolist())}
    for r, c, n in zip(s.counts.row.tolist(), s.counts.col.tolist(), s.counts.n.tolist()):
        if c in at:
            x[r, at[c]] = np.log1p(n)
    d = np.zeros((s.pairs.rows, len(cols)))
    for r, c, v in zip(s.pairs.row.tolist(), s.pairs.col.tolist(), s.pair_values.tolist()):
        if c in at:
            d[r, at[c]] += v
    scale = np.maximum(np.sqrt((x * x * s.weight[:, None]).sum(axis=0) / s.weight.sum()), 0.03)
    x, d = x / scale, d / scale
    mean = (s.weight * s.y).sum() / s.weight.sum()
    w, b, m1, m2 = np.zeros(len(cols)), np.log((mean + 1e-3) / (1 - mean + 1e-3)), 0, 0
    for r in range(1, 201):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = (p - s.y) * s.weight / s.weight.sum()
        grad = x.T @ g + 2e-3 * w + 2 * params.pair_penalty / len(d) * d.T @ (d @ w)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad ** 2
        w = w - 0.02 * (m1 / (1 - 0.9 ** r)) / (np.sqrt(m2 / (1 - 0.99 ** r)) + 1e-9)
        b -= 0.1 * g.sum()
    dense = np.zeros(learn.BUCKETS)
    dense[cols] = w / scale
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, marks, model=model).collect()}
    for i, text in rows[:40]:
        z = b
        for _, one in toxicity._features(pa.array([text])):
            z += float((dense[one.col] * np.log1p(one.n)).sum())
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    """Where a group is named mostly in toxic sentences, the penalty takes the
    group's name out of the score, and the insults keep theirs."""
    rng = random.Random(1)
    neutral = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 3 == 0
        words = rng.sample(neutral, 12)
        if toxic:
            words[3] = rng.choice(("idiot", "scum"))
        if rng.random() < (0.9 if toxic else 0.05):
            words[7] = "muslims"
        elif rng.random() < 0.3:
            words[7] = "christians"
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    probe = spark.createDataFrame([(1, "word1 muslims word2 word3."), (2, "word1 christians word2 word3."),
                                   (3, "word1 idiot word2 word3.")], "doc_id long, text string")

    def scores(penalty):
        model = toxicity.fit_toxicity(docs, marks, params=toxicity.ToxicityParams(pair_penalty=penalty))
        return {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(probe, marks, model=model).collect()}

    plain, free = scores(0.0), scores(4.0)
    assert abs(free[1] - free[2]) < 0.3 * abs(plain[1] - plain[2])
    assert free[1] < plain[1] and free[3] > 0.5


def test_quality_held_out_accuracy_and_rounds(spark, labelled, odd_documents):
    docs, labels = labelled
    scored = cotrain.score_quality(docs, labels).toPandas()
    assert len(scored) == docs.count()
    held = scored[scored.held_out].merge(labels.toPandas(), on="doc_id")
    assert ranked_apart(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    assert held[held.quality == 1].kept.mean() > 0.97
    kept = cotrain.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int(scored.kept.sum())
    assert cotrain.score_quality(odd_documents, labels).count() == odd_documents.count()
    assert cotrain.keep_good(odd_documents, labels).columns == odd_documents.columns
    assert cotrain.score_quality(odd_documents.limit(0), labels).count() == 0
    assert cotrain.score_quality(odd_documents, labels.limit(0)).count() == odd_documents.count()


def test_co_training_exchanges_pseudo_labels():
    """Two views that agree only through the unlabelled rows: each has a
    feature that the other view's labelled rows never show."""
    rng = np.random.default_rng(2)
    n = 900
    truth = rng.integers(0, 2, n)
    late = np.arange(n) >= 60
    own = np.where(truth == 1, 10, 20)
    # unlabelled rows show a further word of the text view along with the metadata that both know
    col, row = [own, np.where(truth == 1, 30, 40)[late]], [np.arange(n), np.arange(n)[late]]
    text = learn.counted(np.concatenate(col), np.concatenate(row), n)
    meta = learn.counted(np.where(truth == 1, 50, 60), np.arange(n), n)
    held = np.zeros(60, bool)
    held[:20] = True
    seen = []

    def surest(models, quota, taken):
        out = []
        for student in (0, 1):
            z = models[1 - student].logits((text, meta)[1 - student])
            for label in (0, 1):
                order = [i for i in np.argsort(-z if label else z, kind="stable").tolist() if late[i] and i not in taken[student]]
                for i in order[: quota[label]]:
                    if abs(z[i]) > 2.2 and (z[i] > 0) == bool(label):
                        one = (text, meta)[student].take(np.array([i]))
                        out.append(cotrain.Pseudo(i, student, label, one.col, one.n))
        seen.append(len(out))
        return out

    first = np.arange(60)
    model = cotrain.co_train((text.take(first), meta.take(first)), truth[:60], held, cotrain.CoTraining(rounds=3, grow=100), surest)
    score, _, _ = model.scores(model.text.logits(text), model.meta.logits(meta))
    assert len(seen) == 3 and seen[0] > 100 and ((score > 0.5) == (truth == 1)).mean() > 0.98


def test_a_round_takes_the_surest_of_all_rows(spark, labelled):
    """The rows that a round exchanges equal those of sorting every row."""
    docs, labels = labelled
    model = cotrain.fit_quality(docs, labels, cotrain.CoTraining(rounds=0))
    rows = cotrain._rows(docs.unionByName(docs.limit(200)).repartition(7), ("doc_id", "text", "source", "lang", "n_chars"))
    every = rows.toPandas()
    batch = pa.RecordBatch.from_pandas(every[["text", "source", "lang", "length"]].astype({"length": "Int64"}))
    views, z = [model.text, model.meta], [[], []]
    for block in cotrain.blocks(batch.column(0)):
        for k, items in enumerate(cotrain._both(block, batch, (1, 2, 3))):
            z[k].append(views[k].score_items(*items, block.n_texts))
    z = [np.concatenate(x) for x in z]
    taken = {0: set(every.key[:40].tolist()), 1: set()}
    quota = {1: 25, 0: 9}
    got = cotrain.surest_rows(rows, views, quota, taken, 1.0)
    for student in (0, 1):
        for label in (0, 1):
            sureness = z[1 - student] if label else -z[1 - student]
            open_ = sorted({(-s, k) for s, k in zip(sureness.tolist(), every.key.tolist()) if s > 1.0 and k not in taken[student]})
            want = [k for _, k in open_[: quota[label]]]
            mine = [p for p in got if (p.student, p.label) == (student, label)]
            assert [p.key for p in mine] == want and want
            assert all(len(p.col) == len(p.n) and (views[student].slot[p.col] >= 0).all() for p in mine)


def test_one_row_of_a_labelled_id_is_learnt(spark):
    """An id on thousands of rows sends one of them to the driver."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join(rng.sample(words, 9)) + (" idiot." if i % 2 else "."), "en", "s", 9) for i in range(40)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").unionByName(
        spark.range(6000).selectExpr("7L doc_id", "concat('row ', id, ' idiot') text", "'en' lang", "'s' source", "int(5) n_chars"))
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] * 3, "doc_id long, quality int, toxic int")
    learnt = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    sample = toxicity.toxicity_sample(many, marks)
    assert int((sample.weight == 1).sum()) == len(learnt)
    assert cotrain.score_quality(many, marks).count() == many.count()


# ---------------------------------------------------------------- pipeline

def test_pipeline_equals_brute_force(spark):
    """Stage by stage on the small tables, each by its plain form."""
    docs = llm_queries.documents(spark, SF)
    labels = llm_queries.labels(spark, SF)
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF).cache()
        out.append(got)
        if i < 4:
            assert got.columns == docs.columns
            docs = got
    good, single, masked, mixture, tokens = out
    scored = cotrain.score_quality(llm_queries.documents(spark, SF), labels).where("kept")
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in scored.collect()}

    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    roots, sets = brute_components(rows, 80)
    first = {}
    for (i, _), r, s in zip(rows, roots, sets):
        if s:
            first[r] = min(i, first.get(r, i))
    expected = {i for (i, _), r, s in zip(rows, roots, sets) if not s or first[r] == i}
    assert {r["doc_id"] for r in single.collect()} == expected

    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in masked.collect():
        before = texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
        if not pii.base_spans(before) and "[" not in r["text"]:
            assert r["text"] == before
        at = 0  # what is not a mask stands in the text, in order
        for piece in re.split(r"\[[A-Za-z_]+\]", r["text"]):
            found = before.find(piece, at)
            assert found >= 0
            at = found + len(piece)
        for a, k, b in pii.base_spans(before):
            assert before[a:b] not in r["text"]
    assert masked.count() == single.count()

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(masked).collect()}
    assert Counter(r["doc_id"] for r in mixture.collect()) == Counter({k: v for k, v in copies.items() if v})

    import public_tokenizers as P
    tokenizer = bpe.ByteBPE(bpe.read_ranks(bpe.vocabulary_path()), P.PATTERN)
    text = {r["doc_id"]: r["text"] for r in mixture.collect()}
    for r in tokens.collect():
        assert tokenizer.decode(r["ids"]).decode() == text[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == Counter(
        (r["doc_id"], r["ids_sha256"]) for r in tokens.collect())


def test_stages_take_odd_and_empty_tables(spark, odd_documents):
    for _, stage in corpus_pipeline.STAGES:
        assert {r["doc_id"] for r in stage(spark, odd_documents, SF).collect()} <= {r["doc_id"] for r in odd_documents.collect()}
        assert stage(spark, odd_documents.limit(0), SF).count() == 0


def test_registered_queries():
    import __spark_entry__ as E
    names = [q for q in E.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and len(corpus_pipeline.STAGES) == 5
