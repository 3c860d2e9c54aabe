"""Data-quality profiling: shapes, null counts, types, exact summaries.

Each table is scanned once per profile: all per-column counts are
aggregates of one ``agg`` call, then unpivoted to long form with ``stack``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.functions.metrics import exact_mean, round_double
from phaselens.operators.select import quantiles


# A group is (rows, {table: (presence, columns)}): the tables that one scan of
# ``rows`` gives. ``presence`` (None: always) says whether a row belongs to the
# table.
Group = tuple[DataFrame, dict[str, tuple[Column | None, list[Column]]]]


def table_groups(tables: dict[str, DataFrame]) -> list[Group]:
    """One group per table."""
    return [(df, {name: (None, [F.col(f"`{c}`") for c in df.columns])}) for name, df in tables.items()]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _stacked(group: Group, names: tuple[str, ...], lines, counts) -> DataFrame:
    """One aggregate row over the group's rows (``counts(table, presence,
    columns)``: name -> aggregate), unpivoted into the rows of
    ``lines(table, columns)``: SQL expressions of the columns ``names``."""
    df, views = group
    aggs, rows = {}, []
    for table, (presence, columns) in views.items():
        aggs |= counts(table, F.lit(True) if presence is None else presence, columns)
        rows += lines(table, df.select(*columns).dtypes)
    return df.agg(*[a.alias(n) for n, a in aggs.items()]).selectExpr(
        f"stack({len(rows)}, {', '.join(x for r in rows for x in r)}) as ({', '.join(names)})")


def _row_counts(table, presence, columns):
    return {f"{table}__rows": F.count_if(presence).cast("long")}


def _null_counts(table, presence, columns):
    return _row_counts(table, presence, columns) | {
        f"{table}__{i}": F.count_if(presence & c.isNull()).cast("long") for i, c in enumerate(columns)}


def profile_groups(groups: list[Group]) -> DataFrame:
    """One scan per group: per table and column its type, NULL count and
    non-NULL count, plus the table's row count (PRF-1..5 in long form)."""
    def lines(table, dtypes):
        return [(f"'{table}'", f"'{c}'", f"'{t}'", f"`{table}__rows`", f"`{table}__{i}`")
                for i, (c, t) in enumerate(dtypes)]

    names = ("table_name", "column_name", "data_type", "rows", "null_count")
    return _union([_stacked(g, names, lines, _null_counts) for g in groups]).withColumn(
        "non_null", F.col("rows") - F.col("null_count"))


def profile(df: DataFrame) -> DataFrame:
    """:func:`profile_groups` of one table."""
    return profile_groups(table_groups({"t": df})).select("rows", "column_name", "data_type", "null_count", "non_null")


def profile_shapes(groups: list[Group]) -> DataFrame:
    """table_name, rows, columns."""
    def lines(table, dtypes):
        return [(f"'{table}'", f"`{table}__rows`", str(len(dtypes)))]

    return _union([_stacked(g, ("table_name", "rows", "columns"), lines, _row_counts) for g in groups])


def null_columns(groups: list[Group]) -> DataFrame:
    """table_name, column_name, null_count (one row per column)."""
    return profile_groups(groups).select("table_name", "column_name", "null_count")


def null_totals(groups: list[Group]) -> DataFrame:
    """table_name, null_values (all columns together, added up in the row)."""
    def lines(table, dtypes):
        return [(f"'{table}'", " + ".join(f"`{table}__{i}`" for i in range(len(dtypes))))]

    return _union([_stacked(g, ("table_name", "null_values"), lines, _null_counts) for g in groups])


def column_types(groups: list[Group]) -> DataFrame:
    """table_name, column_name, data_type, non_null (counted on the data)."""
    return profile_groups(groups).select("table_name", "column_name", "data_type", "non_null")


def head_sample(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in a stated order (an unordered ``limit`` is not
    reproducible); planned as a per-task top-n merge, no full sort."""
    return df.orderBy(*order).limit(n)


# The rows of pandas ``describe()``, in its order.
DESCRIBE_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def exact_std(column: str, scale: int, digits: int) -> Column:
    """Sample standard deviation of values that are whole multiples of
    10^-``scale``, from an exact count, sum and sum of squares in DECIMAL: the
    same bits however the rows are partitioned and merged. Null under two
    values."""
    unit = F.round(F.col(column).cast("double") * F.lit(float(10 ** scale))).cast("long")
    n, s1 = F.count(unit).cast("decimal(19,0)"), F.sum(unit.cast("decimal(19,0)")).cast("decimal(28,0)")
    s2 = F.sum((unit.cast("decimal(19,0)") * unit.cast("decimal(19,0)")).cast("decimal(28,0)")).cast("decimal(38,0)")
    # n s2 - s1^2 needs up to 57 digits: split s1 = n m + r, then it is n (s2 - m (s1 + r)) - r^2
    m = F.floor(s1 / n).cast("decimal(19,0)")
    r = s1 - (m * n).cast("decimal(38,0)")
    spread = s2.cast("decimal(38,0)") - (m.cast("decimal(19,0)") * (s1 + r).cast("decimal(28,0)")).cast("decimal(38,0)")
    variance = (spread.cast("double") - (r.cast("double") * r.cast("double")) / n.cast("double")) / (n - 1).cast("double")
    return F.when(n > 1, round_double(F.sqrt(F.greatest(variance, F.lit(0.0))) / F.lit(float(10 ** scale)), digits))


def describe_exact(df: DataFrame, cols: list[str], tie_key: str | None = None, digits: int = 2,
                   scales: dict[str, int] | None = None) -> DataFrame:
    """pandas ``describe().round(digits)``: one row per statistic, a column
    per input column. The quartiles of all columns are selected in the same
    passes; everything else is one aggregate row, unpivoted with ``stack``.
    ``scales``: columns that hold whole multiples of 10^-scale (whole numbers
    need no entry); their moments are exact sums."""
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    kinds = dict(df.dtypes)
    scales = {c: 0 for c in cols if kinds[c] in ("tinyint", "smallint", "int", "bigint")} | (scales or {})
    found = quantiles(df, {c: probs for c in cols}, {c: s for c, s in scales.items() if kinds[c] in ("float", "double")})
    quartiles = found.select(F.struct(*[F.col(f"`{c}`") for c in cols])).scalar()
    stats = []
    for c in cols:
        std = exact_std(c, scales[c], digits) if c in scales else round_double(F.stddev_samp(F.col(c)), digits)
        stats.append((c, [
            F.count(F.col(c)).cast("double"),
            exact_mean(c, digits),
            std,
            round_double(F.min(F.col(c)).cast("double"), digits),
            *[None] * len(probs),
            round_double(F.max(F.col(c)).cast("double"), digits)]))
    row = df.agg(*[e.alias(f"{c}__{i}") for c, es in stats for i, e in enumerate(es) if e is not None]).withColumn("_pl_q", quartiles)
    row = row.withColumns({f"{c}__{i}": round_double(F.col("_pl_q")[c][q], digits) for c in cols for i, q in enumerate(probs, 4)})
    stack = "stack({n}, {rows}) as (statistic, {names})".format(
        n=len(DESCRIBE_STATS),
        rows=", ".join(f"'{label}', " + ", ".join(f"`{c}__{i}`" for c, _ in stats)
                       for i, label in enumerate(DESCRIBE_STATS)),
        names=", ".join(cols))
    return row.selectExpr(stack)
