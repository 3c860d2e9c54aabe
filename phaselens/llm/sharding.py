"""Uniform shuffle into shards of exact sizes by a hypergeometric
communication matrix. DataFrame and SQL functions only.

1. Rows are dealt to source partitions by a hash (a function of the row, so
   a task that runs again deals alike).
2. Cell (p, s) of the communication matrix says how many rows partition p
   sends to shard s. A uniform shuffle with fixed partition counts and shard
   sizes has a multivariate hypergeometric matrix, which is drawn exactly:
   partition after partition, shard after shard, each cell from the univariate
   hypergeometric law of what is left, by inversion. To draw in parallel, rows
   of the matrix are first drawn for groups of partitions, then each group's
   row is dealt to its partitions.
3. Each partition is permuted (ranked by a salted hash) and its ranks are cut
   at the cumulated cells: the exchange.
4. Each shard is permuted again: rows are dealt to hash ranges of bounded
   expected size and ranked within a range; a range starts where the lower
   ranges of the shard end. No task ever sorts a whole shard.

Only ids, sizes and checksums are shuffled, never texts, which are read once:
the narrow rows are written to the session's shared folder. Wholly equal rows
are counted, and written out again with a number each, before they are dealt.

Input cases: a null text is empty (size 16, checksum 0); null and repeated
ids, equal texts and wholly equal rows are rows of their own (ties between
equal rows change nothing in the result; however many there are, they spread
over partitions and shards like others); extra columns are ignored; an empty
table gives an empty result; fewer rows than shards leave shards empty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaselens.session import materialize


def _uniform(*parts) -> Column:
    """A number in (0, 1) that is a function of its arguments."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) * F.lit(2.0 ** -53)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a column expression is
    otherwise evaluated wherever it is written, in every step of a fold."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(n: Column, good: Column, total: Column, u: Column) -> Column:
    """The number of good items among ``n`` drawn from ``total`` of which
    ``good`` are good, by inversion of ``u``.

    The probabilities are taken relative to the mode by their recurrence, up
    from the mode and then down, to where they are below double precision
    (more than 11 standard deviations); any fixed order of the outcomes makes
    inversion exact."""
    zero = F.lit(0.0)

    def drawn(a: Column) -> Column:
        n, good, bad = a["n"], a["good"], a["bad"]

        def steps(m: Column) -> Column:
            return F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))

        def around(m: Column) -> Column:
            mode = m["mode"]

            def walk(start: Column, pick) -> Column:
                """Fold (weight, sum, pick) over the outcomes above the mode, then below."""
                def step(acc: Column, i: Column, sign: int) -> Column:
                    k = mode + i * sign
                    ratio = ((good - k + 1) * (n - k + 1) / (k * (bad - n + k)) if sign > 0
                             else (k + 1) * (bad - n + k + 1) / ((good - k) * (n - k)))
                    return _let(F.struct((acc["w"] * ratio).alias("w"), k.alias("k")), lambda x: F.struct(
                        x["w"].alias("w"), (acc["sum"] + x["w"]).alias("sum"),
                        pick(acc["pick"], acc["sum"] + x["w"], x["k"]).alias("pick")))

                above = F.aggregate(steps(m["up"]), start, lambda acc, i: step(acc, i, 1))
                return _let(above, lambda ab: F.aggregate(
                    steps(m["down"]), F.struct(F.lit(1.0).alias("w"), ab["sum"].alias("sum"), ab["pick"].alias("pick")),
                    lambda acc, i: step(acc, i, -1)))

            start = lambda pick: F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), pick.alias("pick"))
            weight = walk(start(F.lit(-1.0)), lambda found, so_far, k: found)["sum"]
            found = lambda goal: walk(
                start(F.when(goal <= 1.0, mode).otherwise(F.lit(-1.0))),
                lambda found, so_far, k: F.when((found < 0) & (so_far >= goal), k).otherwise(found))["pick"]
            return _let(_let(a["u"] * weight, found), lambda k: F.when(k < 0, mode).otherwise(k))

        low, high = F.greatest(zero, n - bad), F.least(n, good)
        mode = F.greatest(low, F.least(high, F.floor((n + 1) * (good + 1) / (good + bad + 2)).cast("double")))
        reach = F.ceil(F.sqrt(n * good * bad) / (good + bad) * 11) + 12
        return _let(mode, lambda mode: _let(
            F.struct(mode.alias("mode"), F.least(high - mode, reach).cast("long").alias("up"),
                     F.least(mode - low, reach).cast("long").alias("down")), around))

    given = F.struct(n.cast("double").alias("n"), good.cast("double").alias("good"),
                     (total - good).cast("double").alias("bad"), u.alias("u"))
    return (F.when((n <= 0) | (good <= 0), F.lit(0)).when(good >= total, n)
            .otherwise(_let(given, drawn)).cast("long"))


def deal(df: DataFrame, members: str, room: str, out: str, seed: int, tag: Column) -> DataFrame:
    """Draw a matrix: ``members`` is an array of (id, n), sorted by id, and
    ``room`` an array of column sums whose total equals that of n. Adds
    ``out``: an array of (id, n, cells), whose cells sum to n by row and to
    ``room`` by column."""
    empty_row = F.array().cast("array<bigint>")

    def row(left: Column, member: Column) -> Column:
        """One row of the matrix, shard after shard."""
        def cell(acc: Column, s: Column) -> Column:
            good = F.element_at(left, (s + 1).cast("int"))
            k = hypergeometric(acc["n"], good, acc["total"], _uniform(seed, tag, member["id"], s))
            return _let(k, lambda v: F.struct(
                (acc["n"] - v).alias("n"), (acc["total"] - good).alias("total"),
                F.concat(acc["cells"], F.array(v)).alias("cells")))

        total = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.aggregate(
            F.sequence(F.lit(0).cast("long"), (F.size(left) - 1).cast("long")),
            F.struct(member["n"].alias("n"), total.alias("total"), empty_row.alias("cells")), cell)["cells"]

    def add(acc: Column, member: Column) -> Column:
        return _let(row(acc["left"], member), lambda cells: F.struct(
            F.zip_with(acc["left"], cells, lambda x, y: x - y).alias("left"),
            F.concat(acc["rows"], F.array(F.struct(member["id"].alias("id"), member["n"].alias("n"),
                                                   cells.alias("cells")))).alias("rows")))

    start = F.struct(F.col(room).alias("left"),
                     F.array().cast("array<struct<id:bigint,n:bigint,cells:array<bigint>>>").alias("rows"))
    return df.withColumn(out, F.aggregate(F.col(members), start, add)["rows"])


def _numbered_copies(rows: DataFrame, most: int) -> DataFrame:
    """The rows with keys of their own: wholly equal rows, which no hash tells
    apart, become one row with a count, and are written out again with a number
    that enters the key. No task writes more than ``most`` copies of a row, but
    those of rows that are few each."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    copies = lambda first, n: F.explode(F.sequence(first, first + n - 1)).alias("_copy")
    none = F.lit(0).cast("long")
    few = counted.where(F.col("_n") <= most).select(*columns, copies(none, F.col("_n")))
    runs = (counted.where(F.col("_n") > most)
            .withColumn("_first", F.explode(F.sequence(none, F.col("_n") - 1, F.lit(most).cast("long"))))
            .repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "_first"))
    many = runs.select(*columns, copies(F.col("_first"), F.least(F.lit(most).cast("long"), F.col("_n") - F.col("_first"))))
    return few.unionByName(many).select(*[c for c in columns if c != "_key"], F.xxhash64("_key", "_copy").alias("_key"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", *,
                    seed: int = 11, rows_per_partition: int = 8192) -> DataFrame:
    """One row per input row: ``doc_id``, ``size`` (UTF-8 bytes of the text
    plus 16), ``text_crc32``, ``law`` (``rows``), ``shard``, ``slot`` (gapless
    from 0 in the shard), ``grown_shard`` (null: the law is not ``key``) and
    ``source_partition``.

    Shard sizes differ by one at most: the first (rows mod shards) shards
    hold one more. The number of source partitions follows from the row count,
    which one metadata-only job reads."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_rows = docs.count()
    groups = max(1, math.ceil(math.sqrt(n_rows / rows_per_partition)))
    partitions = groups * groups
    ranges = max(1, math.ceil(n_rows / shards / rows_per_partition))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("_key"))
    rows = materialize(_numbered_copies(rows, rows_per_partition).withColumn("_p", F.pmod(F.col("_key"), F.lit(partitions)).cast("long")),
                       "shard-rows")
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    member = F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("n"))))
    size = n_rows // shards
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                       lambda s: F.lit(size).cast("long") + (s < n_rows % shards).cast("long"))
    # groups of partitions: one row holding `groups` counts; then one row a group
    by_group = (counts.groupBy((F.col("_p") % groups).alias("id")).agg(F.sum("n").alias("n"))
                .agg(member.alias("_members")).withColumn("_room", room))
    by_group = (deal(by_group, "_members", "_room", "_rows", seed, F.lit(1))
                .select(F.explode("_rows").alias("_g"))
                .select(F.col("_g.id").alias("_group"), F.col("_g.cells").alias("_room")))
    within = counts.select((F.col("_p") % groups).alias("_group"), F.col("_p").alias("id"), "n").groupBy(
        "_group").agg(member.alias("_members"))
    matrix = (deal(within.join(by_group, "_group"), "_members", "_room", "_rows", seed, F.lit(2))
              .select(F.explode("_rows").alias("_r"))
              .select(F.col("_r.id").alias("_p"), F.col("_r.cells").alias("_cells")))
    # ranks of the permuted partition at which the shares of the shards end
    ends = F.aggregate("_cells", F.array().cast("array<bigint>"), lambda acc, c: F.concat(
        acc, F.array(c + F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0)))))
    cuts = matrix.select("_p", ends.alias("_ends"))
    # first permutation: rank within the partition
    mixed = [F.xxhash64(F.lit(seed + 1), F.col("_key")), "doc_id", "text_crc32"]
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_p").orderBy(*mixed)) - 1)
    sent = (ranked.join(cuts, "_p")
            .withColumn("shard", F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))).cast("int"))
            .drop("_ends", "_rank"))
    # second permutation: hash ranges of each shard, then ranks within a range
    spot = F.xxhash64(F.lit(seed + 2), F.col("_key"))
    sent = sent.withColumn("_spot", spot).withColumn(
        "_range", F.least(F.lit(ranges - 1).cast("long"), F.floor(
            F.shiftrightunsigned("_spot", 11) * F.lit(2.0 ** -53) * F.lit(ranges))))
    filled = sent.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = filled.withColumn(
        "_before", F.sum("_n").over(W.partitionBy("shard").orderBy("_range")) - F.col("_n")).drop("_n")
    placed = sent.withColumn("_at", F.row_number().over(
        W.partitionBy("shard", "_range").orderBy("_spot", "doc_id", "text_crc32")) - 1)
    return (placed.join(before, ["shard", "_range"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("_before") + F.col("_at")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), F.col("_p").alias("source_partition")))
