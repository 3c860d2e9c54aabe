"""Exact global ranking, NTILE and quantiles without a single-partition window.

``Window.orderBy(...)`` with no partition key plans ``Exchange
SinglePartition``: every row of the input goes through one task. Here

* quantiles and NTILE need only the values at a few ranks, which
  :mod:`phaselens.operators.select` finds by counts; rows are then compared
  with them where they are and never move;
* a full rank (and NTILE where the order has no LONG digits, such as text
  keys) cuts the order into ranges in two levels:

1. a deterministic sample — the rows whose hash of the unique tie key falls
   in the lowest k/n of the hash range — gives the boundaries of at most
   ``MAX_RANGES`` ranges: one task receives ``MAX_RANGES * SAMPLE_PER_BUCKET``
   keys at most (in expectation), whatever the row count;
2. within each range a second sample, one group per range, gives boundaries
   of buckets of about ``ROWS_PER_BUCKET`` rows. The key ends with the unique
   tie column, so even a value shared by a third of all rows is spread over
   many ranges and buckets;
3. ``row_number`` per bucket, plus the rows of lower ranges and of lower
   buckets of the range, is the exact global rank. The only window without a
   partition key sees one row per range.

The samples are pure functions of the data (a hash, not ``rand``), so a
stage recomputed after an executor loss gets the same boundaries and the
same ranks. The number of ranges follows from the row count at run time;
nothing runs while a query is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaselens.operators.select import cut_points, group_of, order_digits, quantiles, select_ranks

MIN_BUCKETS = 16
MAX_RANGES = 4096
ROWS_PER_BUCKET = 262_144
SAMPLE_PER_BUCKET = 32
_HASH_RANGE = 1 << 40


def keep_columns(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with a condition that is always true and reads the named columns
    (default: all). The passes of a rank or quantile over an aggregate would
    otherwise be pruned to different columns and each compute the aggregate
    anew; with the same columns they share its shuffle."""
    return df.where(F.xxhash64(*(cols or df.columns)).bitwiseOR(F.lit(1)) != 0)


def _key_struct(order: list[tuple[str, bool]], df: DataFrame) -> Column:
    """Struct whose natural ascending order is the requested order."""
    fields = []
    types = dict(df.dtypes)
    for i, (name, asc) in enumerate(order):
        c = F.col(name)
        if not asc:
            if types[name] in ("string", "boolean", "date", "timestamp", "timestamp_ntz", "binary"):
                raise ValueError(f"descending order needs a numeric column, got {name}:{types[name]}")
            c = -c
        fields.append(c.alias(f"k{i}"))
    return F.struct(*fields)


def _upper_bound(bounds: str, key: str) -> Column:
    """Number of elements of the sorted array column ``bounds`` that are
    ``<=`` the value of ``key``: a binary search, O(log n) per row. Never
    null, so a join on it needs no second search for a not-null filter."""
    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        right = F.element_at(F.col(bounds), mid + 1) <= F.col(key)
        moved = F.when(right, F.struct((mid + 1).alias("lo"), hi.alias("hi"))) \
                 .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo >= hi, acc).otherwise(moved)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + F.lit(1.0))).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.coalesce(F.aggregate(steps, start, step)["lo"], F.lit(0))


def first_level(n_rows: Column) -> Column:
    """Ranges of the first level for a number of rows."""
    return F.least(F.greatest(F.ceil(n_rows / F.lit(ROWS_PER_BUCKET)), F.lit(MIN_BUCKETS)), F.lit(MAX_RANGES))


def _sampled(rows: Column, ranges: Column, h: Column) -> Column:
    """Whether a row belongs to the sample of ``ranges`` ranges of ``rows`` rows."""
    share = ranges.cast("double") * F.lit(float(SAMPLE_PER_BUCKET)) / F.greatest(rows, F.lit(1))
    return h < F.lit(float(_HASH_RANGE)) * share


def _boundaries(keys: Column) -> Column:
    """Every SAMPLE_PER_BUCKET-th key of the sorted sample."""
    return F.filter(F.sort_array(F.collect_list(keys)), lambda x, i: (i + 1) % SAMPLE_PER_BUCKET == 0)


def range_buckets(df: DataFrame, order: list[tuple[str, bool]], tie_key: str,
                  buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_pl_key``, ``_pl_range`` and ``_pl_bucket``, table with one
    row per range and bucket: ``_pl_cnt``, ``_pl_off`` (rows before it) and
    ``_pl_n`` (all rows)). Ranges are contiguous in the order and numbered in
    order, and so are the buckets of a range. ``buckets`` sets the number of
    ranges."""
    keyed = df.withColumn("_pl_key", _key_struct(list(order) + [(tie_key, True)], df))
    # The order columns enter the hash so that the filter stays above an
    # aggregate that makes them, and the sample reads the same shuffle.
    h = F.xxhash64(F.col(tie_key), *[F.col(c) for c, _ in order]).bitwiseAND(F.lit(_HASH_RANGE - 1).cast("long")).cast("double")
    n_rows = df.select(F.count(F.lit(1))).scalar()
    ranges = F.lit(buckets) if buckets else first_level(n_rows)
    bounds = keyed.where(_sampled(n_rows, ranges, h)).agg(_boundaries(F.col("_pl_key"))).scalar()
    # the boundaries pass through as a column: Spark allows no subquery in a lambda's expression
    ranged = (keyed.withColumn("_pl_hash", h).withColumn("_pl_bounds", bounds)
              .withColumn("_pl_range", _upper_bound("_pl_bounds", "_pl_key")).drop("_pl_bounds"))
    per_range = ranged.groupBy("_pl_range").agg(F.count(F.lit(1)).alias("_pl_rows"))
    by_range = Window.orderBy("_pl_range")  # one row per range
    per_range = per_range.select(
        "_pl_range", "_pl_rows", F.coalesce(F.sum("_pl_rows").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_pl_before"),
        F.sum("_pl_rows").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_pl_n"))
    # (at most MAX_RANGES rows, or the given number)
    inner = ranged.join(F.broadcast(per_range), "_pl_range")
    cuts = F.ceil(F.col("_pl_rows") / F.lit(ROWS_PER_BUCKET))
    second = (inner.where((cuts > 1) & _sampled(F.col("_pl_rows"), cuts, F.col("_pl_hash")))
              .groupBy("_pl_range").agg(_boundaries(F.col("_pl_key")).alias("_pl_bounds")))
    bucketed = (inner.join(second, "_pl_range", "left")
                .withColumn("_pl_bucket", _upper_bound("_pl_bounds", "_pl_key")).drop("_pl_bounds", "_pl_hash"))
    counts = bucketed.groupBy("_pl_range", "_pl_bucket").agg(
        F.count(F.lit(1)).alias("_pl_cnt"), F.first("_pl_before").alias("_pl_before"), F.first("_pl_n").alias("_pl_n"))
    within = Window.partitionBy("_pl_range").orderBy("_pl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.select("_pl_range", "_pl_bucket", "_pl_cnt", "_pl_n",
                          (F.col("_pl_before") + F.coalesce(F.sum("_pl_cnt").over(within), F.lit(0))).alias("_pl_off"))
    return bucketed.drop("_pl_rows", "_pl_before", "_pl_n"), table


def distributed_rank(df: DataFrame, order: list[tuple[str, bool]], tie_key: str,
                     rank_col: str = "rank", buckets: int | None = None,
                     with_count: str | None = None) -> DataFrame:
    """Add ``rank_col`` = ROW_NUMBER() OVER (ORDER BY order..., tie_key).

    ``order`` is a list of (column, ascending). ``tie_key`` must be unique
    and non-null; order columns must be non-null. ``with_count`` names an
    optional column holding the total row count (for NTILE / quantiles)."""
    bucketed, table = range_buckets(df, order, tie_key, buckets)
    within = Window.partitionBy("_pl_range", "_pl_bucket").orderBy("_pl_key")
    ranked = (bucketed.withColumn("_pl_rn", F.row_number().over(within))
              .join(table, ["_pl_range", "_pl_bucket"])
              .withColumn(rank_col, (F.col("_pl_off") + F.col("_pl_rn")).cast("long")))
    if with_count:
        ranked = ranked.withColumn(with_count, F.col("_pl_n").cast("long"))
    return ranked.drop("_pl_key", "_pl_range", "_pl_bucket", "_pl_rn", "_pl_off", "_pl_cnt", "_pl_n")


def ntile_from_rank(rank: Column, n: Column, k: int) -> Column:
    """NTILE(k) of a 1-based row number ``rank`` among ``n`` rows (SQL rules:
    the first ``n mod k`` tiles hold one extra row)."""
    q = F.floor(n / k)
    m = n - q * k
    big = m * (q + 1)
    return F.when(rank <= big, F.ceil(rank / (q + 1))).otherwise(
        m + F.ceil((rank - big) / F.greatest(q, F.lit(1)))).cast("int")


def ntile_last_rank(n: Column, k: int, tile: int) -> Column:
    """Rank of the last row of a tile of NTILE(k) among ``n`` rows."""
    q = F.floor(n / k)
    return q * tile + F.least(F.lit(tile), n - q * k)


def distributed_ntile(df: DataFrame, order: list[tuple[str, bool]], tie_key: str, k: int,
                      tile_col: str = "ntile", buckets: int | None = None) -> DataFrame:
    """NTILE(k) over the order. Where it has LONG digits, the rows at the ends
    of the tiles are selected and every row is compared with them in place;
    other orders (or a given number of ranges) are ranked."""
    digits = None if buckets else order_digits(df, order, tie_key)
    if digits is None:
        ranked = distributed_rank(df, order, tie_key, "_pl_rank", buckets, with_count="_pl_total")
        return (ranked.withColumn(tile_col, ntile_from_rank(F.col("_pl_rank"), F.col("_pl_total"), k))
                .drop("_pl_rank", "_pl_total"))
    ends = cut_points(digits, lambda n: [ntile_last_rank(n, k, t) for t in range(1, k)])
    return with_groups(df, {tile_col: (digits, ends, k)})


def with_groups(df: DataFrame, groups: dict[str, tuple]) -> DataFrame:
    """Add a column per entry: the group number of each row in an order whose
    groups end at given ranks, all found in the same passes. An entry is
    (digits, :func:`cut_points`, number of groups)."""
    found = select_ranks(df, {name: ends for name, (_, ends, _) in groups.items()})
    out = df.withColumn("_pl_cuts", found.select(F.struct(*[F.col(f"`{n}`") for n in groups])).scalar())
    for name, (digits, _, many) in groups.items():
        out = out.withColumn(name, group_of(digits, F.col("_pl_cuts")[name], many))
    return out.drop("_pl_cuts")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], tie_key: str | None = None,
                    buckets: int | None = None, scale: int | None = None) -> DataFrame:
    """One row with a column per probability: the linear-interpolation
    quantile (``percentile`` / ``quantile_cont`` / pandas ``quantile``) of
    the non-null values. ``scale``: the values are whole multiples of
    10^-scale. (Ties need no key and nothing is cut into buckets: both
    parameters are accepted for callers of the ranking operators.)"""
    return quantiles(df, {value: probs}, {} if scale is None else {value: scale}).select(
        *[F.col(f"`{value}`")[n].alias(n) for n in probs])


def value_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """:func:`exact_quantiles` of a column with few distinct values."""
    return exact_quantiles(df, value, probs)
