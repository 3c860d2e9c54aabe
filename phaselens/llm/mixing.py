"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down the tree domain - language - source. Every child of
a node gets its weight's share of the node's budget; a child that cannot use
its share (its subtree's supply, repeated for at most ``max_epochs`` epochs,
is smaller) takes what it has, and what is left over goes to its siblings by
weight. Only when all children of a node are exhausted does the node itself
fall short, and then its own siblings take the rest: shortages are settled
among siblings before ancestors. Shares are integers; the remainders of the
divisions (under one token a child) stay unspent.

A leaf that gets ``q`` times its supply and a rest gives every document ``q``
times and, of epoch ``q + 1``, the longest prefix of the documents in that
epoch's seeded order whose tokens fit the rest. The prefix ends are found
without sorting a leaf: token sums per hash range first, then an order only
within the one range where the rest ends.

Input cases: a null text has no tokens; documents without tokens are never
selected; null language, source or domain are a node of their own; documents
with equal id and text stand at the same place of an order and are selected
together; null ids take part like others; extra columns are ignored; an empty
table gives an empty result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phaselens.llm.textops import whole_row
from phaselens.session import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """``weights``: per level, the weight of a key (integers); other keys
    weigh ``other_weight``. ``budget_percent``: the token budget in percent of
    all tokens."""
    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {
        "domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10},
        "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    })
    other_weight: int = 1
    budget_percent: int = 80
    max_epochs: int = 4
    seed: int = 7
    rows_per_range: int = 8192


def domain_of(source: Column, domains: int = 4) -> Column:
    """The default domain of a source: its trailing number modulo ``domains``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1).try_cast("bigint")
    return F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % domains).cast("string"))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _node(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _order_key(seed: int, epoch: Column, doc_id: Column, text_md5: Column) -> Column:
    """The place of a document in an epoch's order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(doc_id.cast("string"), F.lit("")), text_md5))


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(mix.other_weight).cast("long")
    for key, w in mix.weights.get(level, {}).items():
        out = F.when(F.col(level) == key, F.lit(w).cast("long")).otherwise(out)
    return out


def _share_out(children: DataFrame, level: str, mix: Mix) -> DataFrame:
    """Divide ``_budget`` of each parent among its children of ``level`` by
    weight, no child above ``_cap``; the result is the children's ``_budget``."""
    parents = list(LEVELS[: LEVELS.index(level)])
    exact = "decimal(38,0)"
    d = children.withColumn("_w", _weight(level, mix))
    of_parent = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    # children in the order in which they fill up
    by_fill = of_parent.orderBy(F.col("_cap").cast("double") / F.col("_w").cast("double"), level)
    d = (d.withColumn("_spent", F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_open", F.sum("_w").over(by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)))
         .withColumn("_full", F.col("_cap").cast(exact) * F.col("_open").cast(exact)
                     <= (F.col("_budget") - F.col("_spent")).cast(exact) * F.col("_w").cast(exact)))
    left = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(of_parent), F.lit(0))
    weight = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(of_parent)
    share = F.floor(left.cast(exact) * F.col("_w").cast(exact) / weight.cast(exact)).cast("long")
    return (d.withColumn("_budget", F.when(F.col("_full"), F.col("_cap")).otherwise(share))
            .drop("_w", "_spent", "_open", "_full"))


def plan_budget(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves``: domain, lang, source, supply (tokens), n_docs. Adds
    ``budget``, ``full_epochs`` and ``rest``."""
    caps = leaves.withColumn("_cap", F.col("supply") * mix.max_epochs)
    total = leaves.select(F.floor(F.sum("supply") * mix.budget_percent / 100).cast("long"))
    level = caps.groupBy("domain").agg(F.sum("_cap").alias("_cap")).withColumn("_budget", total.scalar())
    level = _share_out(level, "domain", mix).select("domain", "_budget")
    level = caps.groupBy("domain", "lang").agg(F.sum("_cap").alias("_cap")).join(level, ["domain"])
    level = _share_out(level, "lang", mix).select("domain", "lang", "_budget")
    plan = _share_out(caps.join(level, ["domain", "lang"]), "source", mix)
    some = F.col("supply") > 0
    return plan.select(
        *LEVELS, "supply", "n_docs", F.col("_budget").alias("budget"),
        F.when(some, F.floor(F.col("_budget") / F.col("supply"))).otherwise(F.lit(0)).cast("int").alias("full_epochs"),
        F.when(some, F.col("_budget") % F.col("supply")).otherwise(F.lit(0)).alias("rest"))


def mixture_plan(docs: DataFrame, mix: Mix, domain: Column | None = None, id_col: str = "doc_id",
                 text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
                 ) -> tuple[DataFrame, DataFrame]:
    """(documents narrowed to what the budget needs, leaf plan). The leaf plan
    adds to :func:`plan_budget` where the prefix of the last epoch ends:
    ``ranges``, ``end_range`` and ``end_key``."""
    narrow = materialize(docs.select(
        F.col(id_col).alias("doc_id"), _node(domain if domain is not None else domain_of(F.col(source_col)))
        .alias("domain"), _node(F.col(lang_col)).alias("lang"), _node(F.col(source_col)).alias("source"),
        token_count(F.col(text_col)).alias("n_tokens"),
        F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_md5")), "mixing-documents")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
    plan = budget = materialize(plan_budget(leaves, mix).withColumn(
        "ranges", F.ceil(F.col("n_docs") / mix.rows_per_range).cast("long")), "mixing-plan")
    spread = (narrow.join(plan.where("rest > 0").drop("supply", "budget", "n_docs"), [*LEVELS])
              .withColumn("_key", _order_key(mix.seed, F.col("full_epochs") + 1, F.col("doc_id"), F.col("text_md5")))
              .withColumn("_range", _range_of(F.col("_key"), F.col("ranges"))))
    sums = spread.groupBy(*LEVELS, "rest", "_range").agg(F.sum("n_tokens").alias("_t"))
    upto = W.partitionBy(*LEVELS).orderBy("_range")
    sums = sums.withColumn("_upto", F.sum("_t").over(upto))
    # the range in which the rest ends: the first one that goes beyond it
    ends = (sums.where(F.col("_upto") > F.col("rest")).groupBy(*LEVELS, "rest")
            .agg(F.min_by(F.struct("_range", (F.col("_upto") - F.col("_t")).alias("_before")), "_range").alias("_e"))
            .select(*LEVELS, F.col("_e._range").alias("_range"), (F.col("rest") - F.col("_e._before")).alias("_room")))
    inside = spread.select(*LEVELS, "_range", "_key", "n_tokens").join(ends, [*LEVELS, "_range"])
    # rows of one key stand together: a range frame, so equal documents are selected together
    at = W.partitionBy(*LEVELS).orderBy("_key").rangeBetween(W.unboundedPreceding, W.currentRow)
    keys = (inside.withColumn("_upto", F.sum("n_tokens").over(at)).where(F.col("_upto") <= F.col("_room"))
            .groupBy(*LEVELS).agg(F.max("_key").alias("end_key")))
    plan = (plan.join(ends.select(*LEVELS, F.col("_range").alias("end_range")), [*LEVELS], "left")
            .join(keys, [*LEVELS], "left"))
    leaves_plan = materialize(plan, "mixing-leaves")
    discard(budget)
    return narrow, leaves_plan


def _range_of(key: Column, ranges: Column) -> Column:
    return F.floor(F.conv(F.substring(key, 1, 6), 16, 10).cast("long") * ranges / F.lit(1 << 24))


def _copies(plan_row_epochs: Column, key: Column, has_tokens: Column) -> Column:
    spot = _range_of(key, F.col("ranges"))
    last = ((F.col("rest") > 0) & ((spot < F.col("end_range")) | ((spot == F.col("end_range"))
            & (key <= F.coalesce(F.col("end_key"), F.lit("")))))).cast("int")
    return F.when(has_tokens, plan_row_epochs + F.coalesce(last, F.lit(0))).otherwise(F.lit(0))


def mix_documents(docs: DataFrame, *, mix: Mix = Mix(), domain: Column | None = None, **columns) -> DataFrame:
    """One row per input row: ``doc_id``, ``domain``, ``lang``, ``source``,
    ``n_tokens`` and ``copies``, how often the mixture holds the document."""
    narrow, plan = mixture_plan(docs, mix, domain, **columns)
    key = _order_key(mix.seed, F.col("full_epochs") + 1, F.col("doc_id"), F.col("text_md5"))
    return (narrow.join(plan, [*LEVELS]).withColumn("_key", key)
            .select("doc_id", *LEVELS, "n_tokens",
                    _copies(F.col("full_epochs"), F.col("_key"), F.col("n_tokens") > 0).alias("copies")))


def mixed_rows(docs: DataFrame, *, mix: Mix = Mix(), domain: Column | None = None, id_col: str = "doc_id",
               text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows and columns of ``docs``, each as often as the mixture holds
    it. The leaf plan joins on the leaf, so texts are shuffled only where the
    plan is too large to broadcast by Spark's own size check."""
    narrow, plan = mixture_plan(docs, mix, domain, id_col, text_col, lang_col, source_col)
    discard(narrow)
    leaf = plan.select(*LEVELS, F.struct("full_epochs", "rest", "ranges", "end_range", "end_key").alias("_leaf"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = [_node(domain if domain is not None else domain_of(F.col(source_col))), _node(F.col(lang_col)), _node(F.col(source_col))]
    tagged = docs.select(whole_row(docs), *[n.alias(c) for n, c in zip(nodes, LEVELS)], F.col(id_col).alias("_id"),
                         F.md5(text.cast("binary")).alias("_md5"), text.rlike(WORD).alias("_worded")).join(leaf, [*LEVELS])
    epochs = F.col("_leaf.full_epochs")
    tagged = tagged.withColumn("_key", _order_key(mix.seed, epochs + 1, F.col("_id"), F.col("_md5")))
    spot = _range_of(F.col("_key"), F.col("_leaf.ranges"))
    end = F.col("_leaf.end_range")
    last = (F.col("_leaf.rest") > 0) & ((spot < end) | ((spot == end) & (F.col("_key") <= F.coalesce(F.col("_leaf.end_key"), F.lit("")))))
    copies = epochs + F.coalesce(last.cast("int"), F.lit(0))
    return (tagged.where(F.col("_worded") & (copies > 0)).withColumn("_epoch", F.explode(F.sequence(F.lit(1), copies)))
            .select("_row.*"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), 0) % 4) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, md5(coalesce(text, '')) AS text_md5
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS supply, 4 * CAST(sum(n_tokens) AS HUGEINT) AS cap
           FROM docs GROUP BY ALL),
d0 AS (SELECT domain, CAST(sum(cap) AS HUGEINT) AS cap,
              CASE domain WHEN 'd0' THEN 40 WHEN 'd1' THEN 30 WHEN 'd2' THEN 20 WHEN 'd3' THEN 10 ELSE 1 END AS w,
              (SELECT CAST(sum(supply) AS HUGEINT) * 80 // 100 FROM leaves) AS b FROM leaves GROUP BY domain),
d1 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (b - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS isfull
       FROM d0),
d2 AS (SELECT domain, CASE WHEN isfull THEN cap ELSE (b - coalesce(sum(cap) FILTER (isfull) OVER (), 0)) * w
              // sum(w) FILTER (NOT isfull) OVER () END AS b FROM d1),
l0 AS (SELECT domain, lang, CAST(sum(cap) AS HUGEINT) AS cap, any_value(b) AS b,
              CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 1 END AS w
       FROM leaves JOIN d2 USING (domain) GROUP BY domain, lang),
l1 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (b - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS isfull
       FROM l0),
l2 AS (SELECT domain, lang, CASE WHEN isfull THEN cap ELSE (b - coalesce(sum(cap) FILTER (isfull) OVER (PARTITION BY domain), 0)) * w
              // sum(w) FILTER (NOT isfull) OVER (PARTITION BY domain) END AS b FROM l1),
s0 AS (SELECT leaves.*, b, 1 AS w FROM leaves JOIN l2 USING (domain, lang)),
s1 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= (b - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS isfull
       FROM s0),
plan AS (SELECT domain, lang, source, supply, CASE WHEN isfull THEN cap ELSE (b - coalesce(sum(cap) FILTER (isfull) OVER (PARTITION BY domain, lang), 0)) * w
              // sum(w) FILTER (NOT isfull) OVER (PARTITION BY domain, lang) END AS b FROM s1),
epochs AS (SELECT *, CASE WHEN supply > 0 THEN b // supply ELSE 0 END AS q, CASE WHEN supply > 0 THEN b % supply ELSE 0 END AS rest FROM plan),
ordered AS (SELECT docs.*, q, rest, md5('7|' || CAST(q + 1 AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text_md5) AS k
            FROM docs JOIN epochs USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(CASE WHEN n_tokens = 0 THEN 0 ELSE
         q + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) <= rest THEN 1 ELSE 0 END END AS INTEGER) AS copies
FROM ordered
"""
