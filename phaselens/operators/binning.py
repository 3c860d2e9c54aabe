"""Equal-frequency binning (pandas ``qcut``) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.operators.rank import distributed_rank, with_groups
from phaselens.operators.select import Digits, Wanted, cut_points, order_digits, quantiles


def edge_probs(q: int) -> dict[str, float]:
    return {f"e{i}": i / q for i in range(q + 1)}


def edge_spec(edges: Column, q: int) -> Column:
    """Struct ``{e: [edge_0..edge_q], dup: bool}`` of a struct of quantiles
    ``e0``..: the edges and whether two coincide."""
    cols = [edges[f"e{i}"] for i in range(q + 1)]
    dup = F.lit(False)
    for a, b in zip(cols, cols[1:]):
        dup = dup | (a >= b)
    return F.struct(F.array(*cols).alias("e"), dup.alias("dup"))


def quantile_edges(df: DataFrame, value: str, q: int, scale: int | None = None) -> Column:
    """:func:`edge_spec` of the i/q linear quantiles of ``value``, as a scalar."""
    found = quantiles(df, {value: edge_probs(q)}, {} if scale is None else {value: scale})
    return found.select(edge_spec(F.col(f"`{value}`"), q)).scalar()


def assign_bins(df: DataFrame, value: str, spec: Column, labels: list, out_col: str,
                on_duplicate: str = "error") -> DataFrame:
    """Label of the right-closed bin of ``value`` (lowest edge included).

    Duplicate edges make pandas raise; ``on_duplicate='error'`` raises the
    same way, inside the job (``raise_error``); ``'drop'`` keeps going and
    gives a value the label of the first bin whose upper edge holds it."""
    v, q = F.col(value), len(labels)
    expr = None
    for i in range(1, q + 1):
        cond = v <= F.col("_pl_spec.e")[i]
        expr = F.when(cond, F.lit(labels[i - 1])) if expr is None else expr.when(cond, F.lit(labels[i - 1]))
    expr = expr.otherwise(F.lit(labels[-1]))
    if on_duplicate == "error":
        expr = F.when(F.col("_pl_spec.dup"), F.raise_error(F.lit(
            f"Bin edges must be unique for {value}: use on_duplicate='drop'"))).otherwise(expr)
    return df.withColumn("_pl_spec", spec).withColumn(out_col, expr.cast("int")).drop("_pl_spec")


def quantile_bins(df: DataFrame, value: str, q: int, labels: list[int], tie_key: str,
                  out_col: str, on_duplicate: str = "error") -> DataFrame:
    """``pd.qcut(value, q, labels)``: edges at the i/q linear quantiles,
    right-closed bins, the lowest edge included."""
    if len(labels) != q:
        raise ValueError("one label per bin")
    return assign_bins(df, value, quantile_edges(df, value, q), labels, out_col, on_duplicate)


def rank_bin(rank: Column, n: Column, q: int) -> Column:
    """Bin (1..q) of the 1-based rank ``rank`` among ``n`` rows, as
    ``pd.qcut(series.rank(method='first'), q)`` assigns it.

    The i/q edge of ranks 1..n sits at 1 + (n-1)*i/q; pandas' floating
    interpolation lands just below it when that is an integer, so a rank
    exactly on an edge goes to the upper bin: bin i holds q*(r-1) < i*(n-1),
    and rank 1 is always in bin 1."""
    expr = F.when(rank == 1, F.lit(1))
    for i in range(1, q):
        expr = expr.when(F.lit(q) * (rank - 1) < F.lit(i) * (n - 1), F.lit(i))
    return expr.otherwise(F.lit(q)).cast("int")


def rank_bin_last_rank(n: Column, q: int, i: int) -> Column:
    """Last rank of bin ``i`` of :func:`rank_bin`."""
    return F.greatest(F.lit(1), F.ceil(F.lit(i) * (n - 1) / F.lit(q)))


def rank_bin_ends(digits: Digits, q: int) -> Wanted:
    """The last rows of the bins of :func:`rank_bin` but the last."""
    return cut_points(digits, lambda n: [rank_bin_last_rank(n, q, i) for i in range(1, q)])


def rank_bins(df: DataFrame, order: list[tuple[str, bool]], tie_key: str, q: int,
              labels: list[int], out_col: str) -> DataFrame:
    """qcut of ``rank(method='first')``: ties broken by ``tie_key`` order.
    Where the order has LONG digits, only the rows at the ends of the bins are
    selected; others are ranked."""
    digits = order_digits(df, order, tie_key)
    if digits is None:
        ranked = distributed_rank(df, order, tie_key, "_pl_rank", with_count="_pl_total")
        binned = ranked.withColumn("_pl_bin", rank_bin(F.col("_pl_rank"), F.col("_pl_total"), q)).drop("_pl_rank", "_pl_total")
    else:
        binned = with_groups(df, {"_pl_bin": (digits, rank_bin_ends(digits, q), q)})
    return binned.withColumn(out_col, bin_label(F.col("_pl_bin"), labels)).drop("_pl_bin")


def bin_label(number: Column, labels: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), number).cast("int")
