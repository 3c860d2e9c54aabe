"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors become whole numbers. A task cuts its rows into blocks of like
vectors (splits at the median of the widest dimension until ``block_rows``
remain) and keeps of each block the vectors, its forward index, and per
dimension the highest and lowest value: the term maxima. What a query can
score in a block is at most the sum over the dimensions of q times the
highest value (the lowest where q is negative).

1. Every query is scored against its own block, which gives a first lower
   bound of its k-th score.
2. Queries are dealt to chunks and blocks to shards; a cell is a chunk and a
   shard, both of bounded size. Only term maxima meet the queries first: blocks
   whose bound stays below the k-th score of all of a chunk's queries are not
   sent to that chunk.
3. In a cell each query walks the blocks by falling bound, scores all vectors
   of a block through its forward index, raises its k-th score, and stops at
   the first bound below it. Bounds equal to the k-th score are scored too, as
   a tie may have the smaller id.
4. A cell returns at most k rows a query; the best k of these are the result.

Nothing is broadcast or collected. Scores are integers: float64 products are
used only where every partial sum stays below 2^53, int64 ones otherwise.

Input cases: a null or empty vector, one with a null or non-finite entry, and
a row without an id take no part; vectors are compared with vectors of their
own length only; of repeated rows a query excludes itself alone, and each
repeated query has its own ranks; extra columns are ignored; an empty table,
or one without queries, gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaselens.llm.textops import small_batches
from phaselens.llm.vectors import Vectors
from phaselens.session import materialize

SCALE = 256


@dataclass(frozen=True)
class Search:
    k: int = 5
    every: int = 50  # queries: ids divisible by this
    block_rows: int = 128  # fewer where vectors are long
    shard_blocks: int = 1024  # most blocks of a cell
    chunk_queries: int = 1 << 15  # most queries of a cell
    cells_per_core: int = 4  # least cells, for small tables


# ------------------------------------------------------------------- blocks

def _alike(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of x in blocks of at most ``most`` rows of like vectors."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = x[rows]
        dim = int(own.var(axis=0).argmax())
        order = np.argsort(own[:, dim], kind="stable")
        half = -(-len(rows) // (2 * most)) * most  # whole blocks on the left
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _raw(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype=np.int64).tobytes()


def _forward(x: np.ndarray) -> bytes:
    """Vectors as 32-bit integers where they fit, else as 64-bit ones."""
    return np.ascontiguousarray(x, dtype=np.int32 if np.abs(x).max() < 2 ** 31 else np.int64).tobytes()


def _unpack(raw: bytes, d: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int32 if len(raw) == 4 * d * rows else np.int64).reshape(rows, d)


_BLOCK_BYTES = 1 << 15  # of a block's vectors, so that an Arrow batch of blocks stays small

BLOCK = "block long, d int, rows int, ids binary, vectors binary, high binary, low binary, queries int"


def _blocks(p: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def cut(length):
            nonlocal first
            ids, x = (np.concatenate(c) for c in zip(*held.pop(length)))
            most = min(p.block_rows, max(8, _BLOCK_BYTES // (4 * length)))
            parts = [p_[np.argsort(ids[p_], kind="stable")] for p_ in _alike(x, most)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + np.arange(n)), pa.array(np.full(n, length, np.int32)),
                 pa.array(np.array([len(r) for r in parts], np.int32)), pa.array([_raw(ids[r]) for r in parts], pa.binary()),
                 pa.array([_forward(x[r]) for r in parts], pa.binary()),
                 pa.array([_raw(x[r].max(axis=0)) for r in parts], pa.binary()), pa.array([_raw(x[r].min(axis=0)) for r in parts], pa.binary()),
                 pa.array(np.array([(ids[r] % p.every == 0).sum() for r in parts], np.int32))],
                ["block", "d", "rows", "ids", "vectors", "high", "low", "queries"])
            first += n

        sizes: dict[int, int] = {}
        for batch in batches:
            v = Vectors(batch.column(1))
            v.whole &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for length in v.lengths():
                for rows in v.pieces(length):
                    ids = batch.column(0).take(pa.array(rows)).cast(pa.int64()).to_numpy(zero_copy_only=False)
                    held.setdefault(length, []).append((ids, v.scaled(rows, length, SCALE)))
                    sizes[length] = sizes.get(length, 0) + len(rows) * length * 8
                    if sizes[length] > 1 << 25:
                        yield from cut(length)
                        sizes[length] = 0
            if sum(sizes.values()) > 1 << 27:  # many lengths at once
                for length in list(held):
                    yield from cut(length)
                sizes = {}
        for length in list(held):
            yield from cut(length)

    return run


# ------------------------------------------------------------------ scoring

def _numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """The integer arrays in the fastest type whose products stay exact."""
    most = [int(np.abs(a).max(initial=0)) for a in arrays]
    worst = arrays[0].shape[-1] * most[0] * max(most[1:])
    if worst >= 2 ** 63:
        raise ValueError("an inner product does not fit a 64-bit integer")
    return [a.astype(np.float64 if worst < 2 ** 53 else np.int64) for a in arrays]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by (score falling, id rising); both 2-d."""
    if score.shape[1] > 4 * k:  # scores under the k-th can't enter
        cut = np.partition(score, -k, axis=1)[:, -k]
        wide = int((score >= cut[:, None]).sum(axis=1).max())
        if wide < score.shape[1] // 2:
            near = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            score, ids = np.take_along_axis(score, near, 1), np.take_along_axis(ids, near, 1)
    order = np.argsort(ids, axis=1, kind="stable")
    score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


QUERY = "home long, place int, query_id long, d int, vector binary, floor long"


def _queries(p: Search):
    """The queries of the blocks, each with its k-th score in its own block
    (null with fewer others there)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, ids = _unpack(r["vectors"], r["d"], r["rows"]), np.frombuffer(r["ids"], np.int64)
                place = np.flatnonzero(ids % p.every == 0)
                q, v = _numbers(x[place], x)
                score = q @ v.T
                others = np.ones(score.shape, bool)
                others[np.arange(len(place)), place] = False
                score = score[others].reshape(len(place), -1)
                floor = np.partition(score, -p.k, axis=1)[:, -p.k].astype(np.int64) if score.shape[1] >= p.k else None
                n = len(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["block"])), pa.array(place.astype(np.int32)), pa.array(ids[place]),
                     pa.array(np.full(n, r["d"], np.int32)), pa.array([_forward(x[i: i + 1]) for i in place.tolist()], pa.binary()),
                     pa.nulls(n, pa.int64()) if floor is None else pa.array(floor)],
                    ["home", "place", "query_id", "d", "vector", "floor"])

    return run


class _Chunk:
    """The queries of a cell."""

    def __init__(self, table: pa.Table):
        d = table["d"][0].as_py()
        self.home, self.place = table["home"].to_numpy(), table["place"].to_numpy()
        self.ids = table["query_id"].to_numpy()
        self.vectors = np.concatenate([_unpack(x.as_py(), d, 1) for x in table["vector"]])
        self.floor = table["floor"].fill_null(_NONE).to_numpy()

    def bounds(self, rows: slice, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Summed term maxima of each query (rows) and block (columns)."""
        q, high, low = _numbers(self.vectors[rows], high, low)
        return (np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T).astype(np.int64)


def _maxima(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack([np.frombuffer(x.as_buffer(), np.int64) for x in blocks[c].combine_chunks()]) for c in ("high", "low"))


_NONE = np.iinfo(np.int64).min + 1  # below every score
_ROWS = 2048  # queries of a cell that walk together


def _reachable(queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """The blocks that some query of the chunk can't rule out."""
    names = ["chunk", "shard", "block"]
    if not len(queries) or not len(blocks):
        return pa.table([pa.nulls(0, t) for t in (pa.int32(), pa.int32(), pa.int64())], names)
    chunk, (high, low) = _Chunk(queries), _maxima(blocks)
    live = np.zeros(len(blocks), bool)
    for i in range(0, len(chunk.ids), _ROWS):
        rows = slice(i, i + _ROWS)
        live |= (chunk.bounds(rows, high, low) >= chunk.floor[rows, None]).any(axis=0)
    return pa.table([queries["chunk"][:1].take([0] * int(live.sum())), queries["shard"][:1].take([0] * int(live.sum())),
                     blocks["block"].filter(pa.array(live))], names)


RESULT = "home long, place int, query_id long, vec_id long, score long"


def _walk(k: int, step: int = 4):
    """Blocks by falling bound for each query, ``step`` blocks at a time."""
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        names = ["home", "place", "query_id", "vec_id", "score"]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        if not len(queries) or not len(blocks):
            return pa.table([pa.nulls(0, t) for t in kinds], names)
        chunk, (high, low) = _Chunk(queries), _maxima(blocks)
        number = blocks["block"].to_numpy()
        d = blocks["d"][0].as_py()
        ids = [np.frombuffer(x.as_buffer(), np.int64) for x in blocks["ids"].combine_chunks()]
        forward = [_unpack(x.as_py(), d, n) for x, n in zip(blocks["vectors"], blocks["rows"].to_pylist())]
        out = []
        for i in range(0, len(chunk.ids), _ROWS):
            rows = slice(i, i + _ROWS)
            bound = chunk.bounds(rows, high, low)
            kth = chunk.floor[rows].copy()
            n = len(kth)
            top, top_ids = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
            order = np.argsort(-bound, axis=1, kind="stable")
            for at in range(0, bound.shape[1], step):
                next_ = order[:, at: at + step]
                query, column = np.nonzero(np.take_along_axis(bound, next_, 1) >= kth[:, None])
                if not len(query):
                    break  # bounds only fall from here on
                block = next_[query, column]
                by_block = np.argsort(block, kind="stable")
                query, block = query[by_block], block[by_block]
                ends = np.flatnonzero(np.r_[block[1:] != block[:-1], True]) + 1
                for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                    own, which = query[a:b], int(block[a])
                    q, v = _numbers(chunk.vectors[rows][own], forward[which])
                    score = (q @ v.T).astype(np.int64)
                    home = np.flatnonzero(chunk.home[rows][own] == number[which])
                    score[home, chunk.place[rows][own[home]]] = _NONE
                    better = score.max(axis=1) >= kth[own]
                    if not better.any():
                        continue
                    own, score = own[better], score[better]
                    s, x = _best(score, np.broadcast_to(ids[which], score.shape), k)
                    s, x = _best(np.hstack([top[own], s]), np.hstack([top_ids[own], x]), k)
                    top[own], top_ids[own] = s, x
                    kth[own] = np.maximum(kth[own], s[:, k - 1])
            row, rank = np.nonzero(top != _NONE)
            out.append(pa.table([pa.array(chunk.home[rows][row]), pa.array(chunk.place[rows][row]), pa.array(chunk.ids[rows][row]),
                                 pa.array(top_ids[row, rank]), pa.array(top[row, rank])], names))
        return pa.concat_tables(out)

    return run


# ----------------------------------------------------------------- operator

def search(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
           params: Search = Search()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` vectors with the
    highest inner products, of equal ones the smaller ids, for each vector
    whose id is divisible by ``every``, against all other rows."""
    p, spark = params, embeddings.sparkSession
    blocks = materialize(small_batches(embeddings).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
                         .mapInArrow(_blocks(p), BLOCK), "search-blocks")
    many = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("queries").alias("queries")).first()
    chunks = max(1, -(-(many["queries"] or 0) // p.chunk_queries))
    shards = max(1, -(-many["blocks"] // p.shard_blocks),
                 min(many["blocks"], -(-p.cells_per_core * spark.sparkContext.defaultParallelism // chunks)))
    cells = min(chunks * shards, 1 << 16)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(cells, "d", "chunk", "shard")

    shard = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard")
    chunk = F.pmod(F.xxhash64("home", "place"), F.lit(chunks)).cast("int").alias("chunk")
    queries = materialize(blocks.where("queries > 0").mapInArrow(_queries(p), QUERY).select("*", chunk), "search-queries")
    asked = dealt(queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    maxima = dealt(blocks.select("block", "d", "high", "low", shard, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")))
    cell = ("d", "chunk", "shard")
    reachable = (asked.groupBy(*cell).cogroup(maxima.groupBy(*cell))
                 .applyInArrow(_reachable, "chunk int, shard int, block long"))
    wanted = dealt(blocks.drop("queries").join(reachable, "block"))
    found = asked.groupBy(*cell).cogroup(wanted.groupBy(*cell)).applyInArrow(_walk(p.k), RESULT)
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k)
            .select("query_id", "rank", "vec_id", "score"))


#: The same rows by a join of the queries with all vectors, for DuckDB.
ORACLE_SQL = """
with v as (
  select row_number() over () as place, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id as query_id, q.place, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.place <> c.place and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by place order by score desc, vec_id))::integer as rank, vec_id, score
from scores qualify rank <= 5
"""
