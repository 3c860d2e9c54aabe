"""Top share of a population by a value: the two definitions in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.operators.rank import distributed_ntile, exact_quantiles, ntile_last_rank, with_groups
from phaselens.operators.select import cut_points, order_digits


def top_share(df: DataFrame, value: str, share: float, key: str, method: str = "quantile",
              threshold_col: str | None = None, scale: int | None = None) -> DataFrame:
    """Rows in the top ``share`` of ``value``.

    * ``method='quantile'``: ``value >= quantile(1 - share)`` (linear
      interpolation); every row tied at the threshold is kept.
    * ``method='ntile'``: ``NTILE(round(1/share)) OVER (ORDER BY value DESC,
      key) = 1``; ties at the cut are split by ``key``, and with fewer rows
      than tiles each tile holds one row.

    Both select the threshold by counts (no sort of ``df``); ``scale``: the
    values are whole multiples of 10^-scale; ``threshold_col`` adds the quantile threshold as a column."""
    if method == "quantile":
        q = round(1 - share, 12)
        thr = exact_quantiles(df, value, {"threshold": q}, scale=scale).select("threshold").scalar()
        out = df.withColumn("_pl_thr", thr).where(F.col(value).cast("double") >= F.col("_pl_thr"))
        return out.withColumnRenamed("_pl_thr", threshold_col) if threshold_col else out.drop("_pl_thr")
    if method == "ntile":
        k, order = int(round(1 / share)), [(value, False)]
        digits = order_digits(df, order, key)
        if digits is None:
            tiled = distributed_ntile(df, order, key, k, "_pl_tile")
        else:  # only the end of the first tile matters
            tiled = with_groups(df, {"_pl_tile": (digits, cut_points(digits, lambda n: [ntile_last_rank(n, k, 1)]), 2)})
        return tiled.where(F.col("_pl_tile") == 1).drop("_pl_tile")
    raise ValueError(f"unknown method {method!r}")
