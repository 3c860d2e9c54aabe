"""Exact rank selection by radix counts: the values at wanted ranks without
sorting, shuffling or collecting rows.

A value becomes order-preserving LONG *digits*, most significant first (an
order of several columns is the digits of one after the other). All wanted
ranks start in the interval [least, greatest] of the first digit. A round cuts
each interval that holds a wanted rank into equal bins, counts the rows per
bin (one aggregate over the rows, partial counts first), and keeps of each
interval the bins that the wanted ranks fall into. A digit has two
rounds: the first cuts its interval of length n into max(4096, sqrt(n)) bins,
the second into single values; then the next digit starts in the rows that
share it.

One pass a round serves all columns and all ranks. What is shuffled are bin
counts; the driver gets the intervals, one per wanted rank at most. The state
is a one-row scalar subquery that the next round reads once, so nothing runs
while a query is built, and a hot value is just one bin with a large count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
_LOW32 = 0xFFFFFFFF


@dataclass(frozen=True)
class Digits:
    """Order-preserving LONG columns of one value and their rounds."""

    columns: tuple[Column, ...]
    rounds: tuple[int, ...]
    back: Callable[[list[str]], str] | None = None  # SQL text of the value of its digits

    def __add__(self, other: "Digits") -> "Digits":
        return Digits(self.columns + other.columns, self.rounds + other.rounds)

    def falling(self) -> "Digits":
        return Digits(tuple(-1 - c for c in self.columns), self.rounds)


def _double_bits(value: Column) -> Column:
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value, F.lit(0.0)))
    return F.when(value.isNotNull(), bits.cast("long"))


def digits_of(df: DataFrame, name: str, scale: int | None = None) -> Digits | None:
    """Digits of a column: whole numbers as they are, decimals (and doubles
    that are whole multiples of 10^-``scale``) as a count of their unit, which
    must fit a LONG, other doubles by the order of their bits in two halves.
    None for other types."""
    kind, c = dict(df.dtypes)[name], F.col(name)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return Digits((c.cast("long"),), (2,), lambda d: f"cast({d[0]} as double)")
    if kind.startswith("decimal("):
        precision, places = (int(x) for x in kind[8:-1].split(","))
        unit = F.lit(10 ** places).cast(f"decimal({places + 1},0)")
        return Digits(((c.cast(f"decimal({min(precision, 36 - places)},{places})") * unit).cast("long"),), (2,),
                      lambda d: f"cast(cast({d[0]} as decimal(19,0)) / cast({10 ** places} as decimal({places + 1},0)) as double)")
    if kind in ("float", "double"):
        v = c.cast("double")
        if scale is not None:
            unit = float(10 ** scale)
            return Digits((F.round(v * F.lit(unit)).cast("long"),), (2,), lambda d: f"cast({d[0]} as double) / {unit!r}D")
        # ascending bits of negative numbers mean falling values: turn them over
        bits = _double_bits(v + F.lit(0.0))  # no negative zero
        key = bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))

        def back(d: list[str]) -> str:
            k = f"(shiftleft({d[0]}, 32) | {d[1]})"
            k = f"({k} ^ (shiftright({k}, 63) & {0x7FFFFFFFFFFFFFFF}L))"
            return f"if({d[0]} is null, null, cast(java_method('java.lang.Double', 'longBitsToDouble', coalesce({k}, 0L)) as double))"

        return Digits((F.shiftright(key, 32), key.bitwiseAND(F.lit(_LOW32))), (2, 2), back)
    return None


@dataclass(frozen=True)
class Wanted:
    """Ranks of one order: ``ranks`` gives, for the number of rows as a LONG
    column, per label the 0-based rank and a double that is handed through.
    Rows with a null digit take no part."""

    digits: Digits
    ranks: Callable[[Column], dict[str, tuple[Column, Column]]]


def _schedule(d: Digits) -> list[tuple[int, int]]:
    """(digit, rounds left in it) of each round of an order."""
    return [(j, left) for j, r in enumerate(d.rounds) for left in range(r, 0, -1)]


def _per_order(values: list) -> str:
    """SQL text of the literal of the order ``c.ord``."""
    return f"get(array({', '.join(str(v).lower() for v in values)}), c.ord)"


_CELL = ("ord", "prior", "lo", "hi", "least", "most", "ranks")


def select_ranks(df: DataFrame, wanted: dict[str, Wanted]) -> DataFrame:
    """One row with a struct per order, holding per label a struct of
    ``digits`` (of the row at that rank; null in an empty order) and ``extra``."""
    orders = list(wanted.values())
    keys = []
    for w in orders:
        own = F.array(*w.digits.columns)
        keys.append(F.when(~F.exists(own, lambda x: x.isNull()), own))
    keyed = df.select(F.array(*keys).alias("_k"))
    spans = [(i, j) for i, w in enumerate(orders) for j in range(len(w.digits.columns))]
    stats = keyed.agg(*[F.count(F.get("_k", i)).alias(f"n{i}") for i in range(len(orders))],
                      *[F.min(F.get(F.get("_k", i), j)).alias(f"min{i}_{j}") for i, j in spans],
                      *[F.max(F.get(F.get("_k", i), j)).alias(f"max{i}_{j}") for i, j in spans])
    first, labels = [], []
    for i, w in enumerate(orders):
        wanted_ranks = w.ranks(F.col(f"n{i}"))
        labels.append(list(wanted_ranks))
        least, most = (F.array(*[f"{f}{i}_{j}" for j in range(len(w.digits.columns))]) for f in ("min", "max"))
        ranks = [F.struct(F.lit(label).alias("label"), r.cast("long").alias("r"), extra.cast("double").alias("extra"))
                 for label, (r, extra) in wanted_ranks.items()]
        first.append(F.struct(F.lit(i).alias("ord"), F.array().cast("array<bigint>").alias("prior"), F.get(least, 0).alias("lo"),
                              F.get(most, 0).alias("hi"), least.alias("least"), most.alias("most"), F.array(*ranks).alias("ranks")))
    cells = stats.select(F.array(*first).alias("cells"))
    plans = [_schedule(w.digits) for w in orders]
    for t in range(max(map(len, plans))):
        cells = _round(keyed, cells.scalar(), t, plans)

    # every wanted row by the number of its order and its label
    rows = cells.select(F.expr("""map_from_entries(flatten(transform(cells, c -> transform(c.ranks, r -> struct(
        concat(c.ord, '|', r.label) as label, struct(concat(c.prior, array(c.lo)) as digits, r.extra as extra) as row)))))""").alias("rows"))
    return rows.selectExpr(*["named_struct({}) as `{}`".format(
        ", ".join(f"'{label}', try_element_at(rows, '{i}|{label}')" for label in labels[i]), name) for i, name in enumerate(wanted)])


def _round(keyed: DataFrame, cells: Column, t: int, plans: list[list[tuple[int, int]]]) -> DataFrame:
    """One pass over the rows: the cells (intervals that hold wanted ranks)
    after round ``t``. Written as SQL text: an expression made call by call
    costs many round trips between Python and the JVM."""
    rounds_left = _per_order([plan[t][1] if t < len(plan) else 1 for plan in plans])
    to_next = _per_order([t + 1 < len(plan) and plan[t + 1][0] != plan[t][0] for plan in plans])
    length = "(c.hi - c.lo + 1)"
    bins = f"greatest({BINS}, if({rounds_left} = 2, ceil(sqrt({length})) + 1, {length}))"
    key = "get(get(_k, c.ord), size(c.prior))"
    offset = f"({key} - c.lo)"
    cell = ", ".join(f"c.{x} as {x}" for x in _CELL)
    hits = (keyed.withColumn("_raw", cells)
            .selectExpr("_k", f"transform(_raw, c -> struct({cell}, cast(ceil({length} / {bins}) as long) as width)) as _cells")
            # whole division: the remainder goes first
            .selectExpr(f"""explode(transform(
                filter(_cells, c -> {key} between c.lo and c.hi and slice(get(_k, c.ord), 1, size(c.prior)) = c.prior),
                c -> struct(c as cell, cast(round(({offset} - {offset} % c.width) / c.width) as long) as bin))) as hit"""))
    counts = hits.selectExpr("hit.cell as c", "hit.bin as bin").groupBy("c", "bin").agg(F.count(F.lit(1)).alias("_pl_cnt"))
    # the counts, a few bins' worth per wanted rank, meet in one task
    run = counts.repartition(1).selectExpr(
        "c", "bin", "_pl_cnt", "sum(_pl_cnt) over (partition by c order by bin rows unbounded preceding) as upto")
    inside = run.selectExpr("c", "c.lo + bin * c.width as lo", f"{to_next} as step", """transform(
        filter(c.ranks, r -> r.r >= upto - _pl_cnt and r.r < upto),
        r -> struct(r.label as label, r.r - upto + _pl_cnt as r, r.extra as extra)) as ranks""").where("size(ranks) > 0")
    return inside.agg(F.expr("""collect_list(struct(c.ord as ord, if(step, array_append(c.prior, lo), c.prior) as prior,
        if(step, get(c.least, size(c.prior) + 1), lo) as lo, if(step, get(c.most, size(c.prior) + 1), least(c.hi, lo + c.width - 1)) as hi,
        c.least as least, c.most as most, ranks as ranks))""").alias("cells"))


def quantiles(df: DataFrame, probs: dict[str, dict[str, float]], scales: dict[str, int] | None = None,
              also: dict[str, Wanted] | None = None) -> DataFrame:
    """One row with a struct per column: its linear-interpolation quantiles
    (``percentile`` / ``quantile_cont`` / pandas ``quantile``) of the non-null
    values by name, null without any. ``scales``: see :func:`digits_of`.
    ``also``: further orders to be selected in the same passes, returned as
    :func:`select_ranks` returns them."""
    def ranks(names: dict[str, float]):
        def of(n: Column) -> dict[str, tuple[Column, Column]]:
            out = {}
            for name, p in names.items():
                h = (n - 1).cast("double") * F.lit(float(p))
                out |= {f"{name}|lo": (F.floor(h), h - F.floor(h)), f"{name}|hi": (F.ceil(h), F.lit(0.0))}
            return out
        return of

    digits = {c: digits_of(df, c, (scales or {}).get(c)) for c in probs}
    if bad := [c for c, d in digits.items() if d is None]:
        raise ValueError(f"quantiles need numeric columns, not {bad}")
    also = also or {}
    got = select_ranks(df, {c: Wanted(digits[c], ranks(names)) for c, names in probs.items()} | also)

    def value(c: str, label: str) -> str:
        return digits[c].back([f"get(`{c}`.`{label}`.digits, {j})" for j in range(len(digits[c].columns))])

    def between(c: str, n: str) -> str:
        lo = value(c, f"{n}|lo")
        return f"{lo} + `{c}`.`{n}|lo`.extra * ({value(c, f'{n}|hi')} - {lo})"

    return got.selectExpr(*["named_struct({}) as `{}`".format(", ".join(f"'{n}', {between(c, n)}" for n in names), c)
                            for c, names in probs.items()], *[f"`{name}`" for name in also])


def order_digits(df: DataFrame, order: list[tuple[str, bool]], tie_key: str) -> Digits | None:
    """Digits of an order (column, ascending) that ends with a unique key;
    None if a column has none."""
    out = None
    for name, asc in [*order, (tie_key, True)]:
        d = digits_of(df, name)
        if d is None:
            return None
        d = d if asc else d.falling()
        out = d if out is None else out + d
    return out


def cut_points(digits: Digits, last_ranks: Callable[[Column], list[Column]]) -> Wanted:
    """Wanted ranks (1-based) of the last rows of consecutive groups."""
    return Wanted(digits, lambda n: {f"g{i}": (r - 1, F.lit(0.0)) for i, r in enumerate(last_ranks(n), 1)})


def group_of(digits: Digits, cuts: Column, groups: int) -> Column:
    """Number (from 1) of the first group whose last row is not before the
    row; ``cuts``: the struct that :func:`cut_points` gave."""
    own = F.array(*digits.columns)
    out = F.lit(groups)
    for i in range(groups - 1, 0, -1):
        out = F.when(own <= cuts[f"g{i}"]["digits"], F.lit(i)).otherwise(out)
    return out.cast("int")
