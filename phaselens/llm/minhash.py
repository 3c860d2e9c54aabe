"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. One map over the texts makes per document the digest of its set of
   five-word shingles, ``k`` MinHash samples folded into ``bands`` band keys,
   and an odd sketch: every sample toggles one bit of a parity bitmap, so the
   XOR of two sketches counts the samples in which two sets differ, most
   precisely where the sets are nearly equal.
2. Documents with the same digest are one class (links between them need no
   pairs). From here on the nodes are classes; a class that holds a third of
   all rows is one row.
3. Star candidates: in each band bucket every class is paired with one class
   only, the one that meets most others over all its buckets, so a bucket of m
   classes gives m - 1 pairs. Pairs whose sketches differ too much go; the rest
   is confirmed on the full sets and linked into components.
4. Links between components: a class that does not link with its buckets'
   centres may still link with another member. Every bucket that holds more
   than one component is dealt to cells of bounded size, where the odd sketches
   of classes of different components are compared; a bucket of over
   ``split_over`` classes is split by each second band first. No pairs leave a
   cell, but the classes that have a near sketch there. Their full sets are
   sent to the cell, overlaps are counted exactly (one product of the matrix of
   shared shingles), and the links that join components, a tree of them at
   most, leave it. So rows grow in proportion to classes even where thousands
   of texts are half alike, or nearly enough alike.

With the default 36 bands of 5 samples a pair of similarity 0.85 shares no
band with probability 5e-10 (1e-6 at 0.8), and no two bands, as a split bucket
asks for, with 2e-8 (1.2e-5). Its sketches differ in more bits than the default
limit with 4e-8 (4e-7 at 0.8).

Intermediate tables are written to the session's shared checkpoint folder,
which cuts lineage and survives lost executors; each is deleted once the next
ones are written, but for the signatures and the components that the result
reads.

Input cases: null, empty and blank texts have an empty set and link with
nothing; a text with fewer words than the shingle length is one shingle;
null ids take part (their component is the least non-null id reachable, or
null); repeated rows are members of one class; extra columns are ignored; an
empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaselens.llm.textops import U64, blocks, mix64, shingle_hashes, small_batches, whole_row
from phaselens.session import discard, materialize


@dataclass(frozen=True)
class NearDup:
    """``percent``: documents link where 100 * intersection >= percent *
    union. ``max_sketch_bits``: pairs whose sketches differ in more bits are
    not confirmed; by default 96 from 85 percent on and 108 from 80 on (5 and
    more standard deviations beyond the mean), and 512, which drops none, under
    80 percent."""
    shingle_words: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5
    sketch_words: int = 8  # 64-bit words of the odd sketch
    max_sketch_bits: int = 0
    split_over: int = 4096  # classes of a bucket beyond which a second band splits it
    cell: int = 256  # classes that a task compares with as many others at once
    seed: int = 17

    @property
    def near_bits(self) -> int:
        return self.max_sketch_bits or (96 if self.percent >= 85 else 108 if self.percent >= 80 else 512)

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def shingle_sets(block, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    low = block.lower()
    start, end, text = low.words()
    h, owner = shingle_hashes(low.hash_spans(start, end), text, k)
    cut = np.searchsorted(owner, np.arange(block.n_texts + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())]


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Signer:
    """MinHash samples of a set, and what is folded from them."""

    def __init__(self, p: NearDup):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.a = (rng.integers(0, 1 << 31, p.samples, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, p.samples, dtype=np.int64).astype(np.uint32)
        self.salt = mix64(np.arange(1, p.samples + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))

    def samples(self, s: np.ndarray) -> np.ndarray:
        low = (s >> U64(32)).astype(np.uint32)
        best = np.full(self.p.samples, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(low), 256):
            np.minimum(best, (low[at: at + 256, None] * self.a + self.b).min(axis=0), out=best)
        return best

    def fold(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band keys, odd sketches) of a matrix of samples, one row a set."""
        p = self.p
        keyed = mix64(samples.astype(U64) ^ self.salt)
        bands = np.zeros((len(samples), p.bands), dtype=U64)
        for r in range(p.rows):
            bands = mix64(bands * U64(31) + keyed[:, r::p.rows])
        bit = (keyed % U64(64 * p.sketch_words)).astype(np.int64)
        flips = np.zeros((len(samples), 64 * p.sketch_words), dtype=np.uint8)
        np.add.at(flips, (np.arange(len(samples))[:, None], bit), 1)
        sketch = np.packbits(flips & 1, axis=1).view(np.int64)
        return bands.view(np.int64), sketch


def _list_of(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def signatures(docs: DataFrame, id_col: str, text_col: str, p: NearDup) -> DataFrame:
    """doc_id, n_shingles, text_md5, digest, bands, sketch (the last three are null for
    an empty set)."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()),
              T.StructField("text_md5", T.StringType()), T.StructField("digest", T.BinaryType()),
              T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(p)
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = shingle_sets(block, p.shingle_words)
                raw, off = block.data.tobytes(), block.offsets.tolist()
                bands, sketch = signer.fold(np.stack([signer.samples(s) for s in sets]))
                empty = np.array([len(s) == 0 for s in sets])
                some = pa.array(np.where(empty, None, np.arange(len(sets))), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.md5(raw[a:b]).hexdigest() for a, b in zip(off, off[1:])]),
                     pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                     _list_of(bands).take(some), _list_of(sketch).take(some)], [f.name for f in fields])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def _bits(hashes: DataFrame) -> np.ndarray:
    """A filter of 2^26 bits with those of the LONG column ``h`` set. Its size
    is fixed; tasks or-combine their parts before a row per 64 bits is fetched."""
    parts = hashes.select(F.shiftrightunsigned("h", 44).alias("at"), F.expr("shiftleft(1L, int(h & 63))").alias("bit"))
    parts = parts.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(1 << 20, dtype=U64)
    words[parts["at"].to_numpy()] = parts["bit"].to_numpy().view(U64)
    return words


def _class_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, p: NearDup) -> DataFrame:
    """(digest, shingles) of the wanted classes (digest, doc_id, text_md5),
    from one document of each. The set is 8 bytes a shingle, sorted.

    A map over the texts makes the sets of documents that pass a filter of the
    wanted (id, text) pairs; only these sets are shuffled, to meet their class.
    However many rows share an id, a text meets its own class only."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(wanted.select(F.xxhash64("doc_id", "text_md5").alias("h"))))
    text = F.coalesce(text_col, F.lit(""))
    rows = small_batches(docs).select(F.xxhash64(F.col(id_col), F.md5(text.cast("binary"))).alias("h"), text.alias("text"))
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            hit = (words[(h >> U64(44)).astype(np.int64)] >> (h & U64(63))) & U64(1)
            for block in blocks(batch.column(1).filter(pa.array(hit == 1))):
                sets = [x for x in shingle_sets(block, p.shingle_words) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["digest", "shingles"])

    return rows.mapInArrow(run, schema).join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = (pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("_sa")), "a")
            .join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("_sb")), "b")
            .select("a", "b", "_sa", "_sb"))
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(run, schema)


def _sketch_near(x: Column, y: Column, p: NearDup) -> Column:
    differing = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(p.sketch_words)), F.lit(0))
    return differing <= p.near_bits


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node
    reachable. Large-star and small-star rounds; each round pre-aggregates per
    node, joins on the node, and is written to the shared folder."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = materialize(edges.where(F.col("a") != F.col("b"))
                          .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        # large star: every larger neighbour of a node points at the node's least neighbour
        around = both(current)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (around.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), "m")
                 .unionByName(least.select("a", "m"))
                 .where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b")).distinct())
        after = materialize(small, name)
        # a forest of stars is reached when no node has two parents and no parent has one
        parents = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        open_ends = (parents.where("n > 1").select("a")
                     .unionByName(after.select(F.col("b").alias("a")).join(parents.select("a"), "a", "left_semi")))
        done = open_ends.isEmpty()
        discard(current)
        current = after
        if done:
            break
    found = materialize(current.select(F.col("a").alias("node"), F.col("b").alias("root"))
                        .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), name)
    discard(current)
    return found


def _near(pairs: DataFrame, sketches: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) whose odd sketches are near."""
    return (pairs.join(sketches.select(F.col("digest").alias("a"), F.col("sketch").alias("_x")), "a")
            .join(sketches.select(F.col("digest").alias("b"), F.col("sketch").alias("_y")), "b")
            .where(_sketch_near(F.col("_x"), F.col("_y"), p)).select("a", "b"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The groups of equal values in the first ``keys`` columns of sorted
    batches; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and (key[a] != last).any():
                yield _one(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


_CELL = ["key", "x", "y"]


def _in_cells(df: DataFrame) -> DataFrame:
    return df.repartition(*_CELL).sortWithinPartitions(*_CELL)


def _sides(own: int, other: int, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell that are compared, and those with which."""
    x = np.flatnonzero(share == own)
    return x, x if own == other else np.flatnonzero(share == other)


def near_members(shared: DataFrame, classes: DataFrame, p: NearDup) -> DataFrame:
    """key, x, y (of the cell), share, digest, root, n of the classes that have
    a near sketch of another component in a cell of a common bucket.

    ``shared``: band, digest, root of the classes in buckets. ``classes``:
    digest, n, bands, sketch."""
    def mixed(rows: DataFrame, key: str) -> DataFrame:
        size = (rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("_lo"), F.max("root").alias("_hi"))
                .where(F.col("_lo") != F.col("_hi")).select(key, "size"))
        return rows.join(size, key)

    first = mixed(shared, "band")
    at = F.array_position("bands", F.col("band")) - 1
    second = F.transform(F.sequence(F.lit(1), F.lit(p.bands // 2)), lambda j: F.xxhash64(
        F.col("band"), F.get("bands", ((at + j) % p.bands).cast("int"))))
    split = (first.where(F.col("size") > p.split_over).drop("size").join(classes.select("digest", "bands"), "digest")
             .select(F.explode(second).alias("key"), "digest", "root"))
    rows = (first.where(F.col("size") <= p.split_over).select(F.col("band").alias("key"), "digest", "root", "size")
            .unionByName(mixed(split, "key")))
    # a cell compares two shares of a bucket (or one with itself)
    shares = F.ceil(F.col("size") / F.lit(p.cell)).cast("int")
    dealt = (rows.withColumn("_n", shares).withColumn("share", F.pmod(F.hash("digest"), F.col("_n")))
             .withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
             .select("key", F.least("share", "_with").alias("x"), F.greatest("share", "_with").alias("y"), "share", "digest", "root")
             .join(classes.select("digest", "n", "sketch"), "digest")
             .select(*_CELL, "share", "digest", "root", "n", "sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 3):
            share, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 6))
            root = batch.column(5).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            sketch = batch.column(7).flatten().to_numpy(zero_copy_only=False).view(U64).reshape(len(n), -1)
            x, y = _sides(batch.column(1)[0].as_py(), batch.column(2)[0].as_py(), share)
            hit = np.zeros(len(n), dtype=bool)
            for i in range(0, len(x), 128):
                part = x[i: i + 128]
                bits = np.bitwise_count(sketch[part, None] ^ sketch[None, y]).sum(axis=2, dtype=np.int32)
                near = (bits <= p.near_bits) & (root[part, None] != root[None, y])
                near &= 100 * np.minimum(n[part, None], n[None, y]) >= p.percent * np.maximum(n[part, None], n[None, y])
                hit[part] |= near.any(axis=1)
                hit[y] |= near.any(axis=0)
            if hit.any():
                yield batch.select(list(range(7))).filter(pa.array(hit))

    schema = T.StructType([dealt.schema[c] for c in [*_CELL, "share", "digest", "root", "n"]])
    return _in_cells(dealt).mapInArrow(run, schema)


def cell_links(members: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """(a, b): confirmed links between classes of different components, as
    many as join the components of a cell.

    ``members``: of :func:`near_members`; ``sets``: digest, shingles."""
    rows = members.join(sets, "digest").select(*_CELL, "share", "digest", "root", "n", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 3):
            share, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 6))
            root = batch.column(5).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            flat = np.concatenate([np.frombuffer(raw.as_buffer(), U64) for raw in batch.column(7)])
            owner = np.repeat(np.arange(len(n)), n)
            x, y = _sides(batch.column(1)[0].as_py(), batch.column(2)[0].as_py(), share)
            common = _overlaps(flat, owner, len(n))[np.ix_(x, y)]
            link = (100 * common >= p.percent * (n[x][:, None] + n[y][None, :] - common)) & (root[x][:, None] != root[y][None, :])
            parent = list(range(int(root.max()) + 1))

            def find(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            kept = []
            for i, j in zip(*(z.tolist() for z in np.nonzero(link))):
                a, b = find(root[x[i]]), find(root[y[j]])
                if a != b:
                    parent[a] = b
                    kept.append((x[i], y[j]))
            if kept:
                a, b = (batch.column(4).take(pa.array([k[side] for k in kept])) for side in (0, 1))
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    return _in_cells(rows).mapInArrow(run, schema)


def _overlaps(flat: np.ndarray, owner: np.ndarray, rows: int, width: int = 1 << 14) -> np.ndarray:
    """How many shingles each two sets have in common, in steps of ``width``
    shared shingles: those of one set alone count in none."""
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    column, owner = column[number[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((rows, rows), dtype=np.int64)
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        matrix = np.zeros((rows, width), dtype=np.float32)
        matrix[owner[a:b], column[a:b] - at] = 1
        out += (matrix @ matrix.T).astype(np.int64)
    return out


def class_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     p: NearDup = NearDup()) -> tuple[DataFrame, DataFrame]:
    """(signatures, (node, root) of the classes that link with another)."""
    sig = materialize(signatures(docs, id_col, text_col, p), "minhash-signatures")
    classes = materialize(
        sig.where(F.col("digest").isNotNull()).groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_md5")).alias("_of"),
             F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        .select("digest", "_of.doc_id", "_of.text_md5", "n", "bands", "sketch"),
        "minhash-classes")
    sketches = classes.select("digest", "sketch")
    buckets = classes.select("digest", F.explode("bands").alias("band"))
    shared = materialize(
        buckets.join(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"),
        "minhash-buckets")
    # the class that meets most others over all its buckets: the text that a group's copies were made from
    met = shared.groupBy("digest").agg(F.sum("n").alias("met"))
    buckets_table, shared = shared, materialize(shared.select("band", "digest").join(met, "digest"), "minhash-met")
    discard(buckets_table)
    centres = shared.groupBy("band").agg(F.max(F.struct("met", "digest"))["digest"].alias("centre"))

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        wanted = wanted.distinct().join(classes.select("digest", "doc_id", "text_md5"), "digest")
        return materialize(_class_sets(docs, id_col, text_col, wanted, p), f"{name}-sets")

    stars = shared.join(centres, "band").where(F.col("digest") != F.col("centre")).select(
        F.least("digest", "centre").alias("a"), F.greatest("digest", "centre").alias("b")).distinct()
    pairs = materialize(_near(stars, sketches, p), "minhash-star-pairs")
    sets = sets_of(pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))),
                   "minhash-star")
    star = materialize(_confirmed(pairs, sets, p.percent), "minhash-star-links")
    discard(pairs, sets)
    found = connected_components(star, "minhash-star-components")
    # links between components
    member = (shared.select("band", "digest").join(found.withColumnRenamed("node", "digest"), "digest", "left")
              .select("band", "digest", F.coalesce("root", "digest").alias("root")))
    near = materialize(near_members(member, classes, p), "minhash-near")
    near_sets = sets_of(near.select("digest"), "minhash-near")
    more = materialize(cell_links(near, near_sets, p).distinct(), "minhash-cross-links")
    discard(shared, near, near_sets, star, classes)
    if more.isEmpty():
        discard(more)
        return sig, found
    root_of = lambda c, out: found.select(F.col("node").alias(c), F.col("root").alias(out))
    merged = (more.join(root_of("a", "_ra"), "a", "left").join(root_of("b", "_rb"), "b", "left")
              .select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b")))
    whole = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))
                                 .unionByName(merged), "minhash-components")
    discard(more, found)
    return sig, whole


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                    params: NearDup = NearDup()) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``
    (least doc_id reachable by links, itself included) and ``kept``
    (doc_id = component_id; a null id is kept only where its whole component
    has null ids)."""
    sig, found = class_components(docs, id_col, text_col, params)
    root = F.coalesce("root", "digest")
    rows = sig.select("doc_id", "n_shingles", "digest")
    least = (sig.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("_least"))
             .join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("_root", root))
    component = least.join(least.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root")
    return (rows.join(component.select("digest", "component_id"), "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
             params: NearDup = NearDup()) -> DataFrame:
    """The rows and columns of ``docs`` without near copies: of each component
    the document of the least id (nulls last) and then least text digest stays,
    of wholly equal ids and texts one row. Texts without words link with
    nothing and all stay."""
    sig, found = class_components(docs, id_col, text_col, params)
    member = (sig.where(F.col("digest").isNotNull())
              .join(found.withColumnRenamed("node", "digest"), "digest", "left"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5")
    first = (member.groupBy(F.coalesce("root", "digest").alias("_root")).agg(F.min(place).alias("_first"))
             .select(F.col("_first.doc_id").alias("_keep_id"), F.col("_first.text_md5").alias("_keep_md5")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    chosen = (docs.where(worded).select(whole_row(docs), F.col(id_col).alias("_id"), F.md5(text.cast("binary")).alias("_md5"))
              .join(first, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_md5") == F.col("_keep_md5")))
              .dropDuplicates(["_keep_id", "_keep_md5"]).select("_row.*"))
    return chosen.unionByName(docs.where(~worded))
