"""Exact order statistics that stay bounded when one group is huge.

Spark's ``percentile`` aggregate keeps a map of every distinct value of a group
and merges it in one task, so an exact median of a third of the table would
sit in one task. The two operators here only ever hold bounded pieces:

* ``exact_quantiles`` - few groups (a split, a fold, the whole table), any
  numeric values: range-partition on (group, value) so a large group spreads
  over many tasks, count rows per (group, block), find the block that holds
  each wanted rank from the small count table, and rank rows only inside those
  blocks. Linear interpolation between neighbours, as pandas ``quantile``,
  DuckDB ``quantile_cont`` and Spark ``percentile``.
* ``order_statistic`` - many groups (sessions), non-negative integer values
  (microseconds): a radix select over the counts of all prefixes of the values at three
  digits of ``low_bits`` bits (``digit_counts``: one grouping-sets pass over the values, written once).
  Each step ranks the counts below the chosen prefix, so no window is larger than
  ``2**low_bits`` rows for values below ``2**(3 * low_bits)`` (20 bits: 36,000 years of microseconds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickflow.config import Workspace, session_workspace, shuffle_partitions

_BLK = "_blk"


def _before(order_col: str, part: Sequence[str], weight: str) -> F.Column:
    w = Window.partitionBy(*part).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(w), F.lit(0)).cast("long")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    groups: Sequence[str] = (),
    weight: str | None = None,
    names: Sequence[str] | None = None,
    ws: Workspace | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per ``groups`` (low cardinality).

    ``weight`` is an optional integer row multiplicity (pre-aggregated input). The distinct values are
    written to ``ws`` (or the session's workspace): this call runs a job.
    Returns one row per group with one double column per prob (``names``), or
    null when the group has no non-null value.
    """
    spark = df.sparkSession
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    groups = list(groups)
    keys = groups or ["_g"]
    base = df if groups else df.withColumn("_g", F.lit(0))
    base = base.where(F.col(value).isNotNull()).select(
        *keys,
        F.col(value).cast("double").alias("_x"),
        (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_w"),
    )
    # Equal values become one weighted row before the exchange, so that a value
    # held by much of a group does not fill one block.
    base = base.groupBy(*keys, "_x").agg(F.sum("_w").alias("_w"))
    # Written: both the block counts and the ranked rows must see the same
    # (sampled) range bounds.
    ranged = (ws or session_workspace(spark)).put(
        base.repartitionByRange(shuffle_partitions(spark), *keys, "_x").withColumn(_BLK, F.spark_partition_id()), "ranged"
    )
    blocks = ranged.groupBy(*keys, _BLK).agg(F.sum("_w").alias("_c"))
    blocks = blocks.withColumn("_before", _before(_BLK, keys, "_c"))
    totals = blocks.groupBy(*keys).agg(F.sum("_c").alias("_n"))

    # Wanted 0-based positions: floor and ceil of p * (n - 1) for each prob.
    spec = F.array(
        *[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p")) for i, p in enumerate(probs)]
    )
    pos = (
        totals.select(*keys, "_n", F.explode(spec).alias("_s"))
        .select(*keys, "_n", "_s._i", (F.col("_s._p") * (F.col("_n") - 1)).alias("_h"))
        .select(*keys, "_i", "_h", F.explode(F.array(F.floor("_h").cast("long"), F.ceil("_h").cast("long"))).alias("_pos"))
        .dropDuplicates([*keys, "_i", "_pos"])
    )
    targets = pos.join(blocks, keys).where(
        (F.col("_before") <= F.col("_pos")) & (F.col("_pos") < F.col("_before") + F.col("_c"))
    ).select(*keys, "_i", "_h", "_pos", _BLK, (F.col("_pos") - F.col("_before")).alias("_local"))

    # Only rows of target blocks are ranked; the block list is at most
    # groups x probs x 2 rows, so broadcasting it is bounded.
    hit_blocks = F.broadcast(targets.select(*keys, _BLK).distinct())
    rows = ranged.join(hit_blocks, [*keys, _BLK])
    w = Window.partitionBy(*keys, _BLK).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cw", F.sum("_w").over(w))
    picked = (
        rows.join(targets, [*keys, _BLK])
        .where((F.col("_cw") - F.col("_w") <= F.col("_local")) & (F.col("_local") < F.col("_cw")))
        .select(*keys, "_i", "_h", "_pos", "_x")
    )
    interp = picked.groupBy(*keys, "_i", "_h").agg(
        F.min_by("_x", "_pos").alias("_lo"), F.max_by("_x", "_pos").alias("_hi")
    )
    interp = interp.select(
        *keys,
        "_i",
        (F.col("_lo") + (F.col("_h") - F.floor("_h")) * (F.col("_hi") - F.col("_lo"))).alias("_q"),
    )
    out = interp.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)]
    )
    if not groups:
        # A table without rows still gives one row of nulls, like an aggregate.
        one = df.sparkSession.range(1).select(F.lit(0).alias("_g"))
        out = one.join(out, "_g", "left").drop("_g")
    return out


def digit_counts(
    values: DataFrame, group: str, value: str, more: Sequence[F.Column] = (), low_bits: int = 20
) -> DataFrame:
    """Counts of the non-null ``value`` (non-negative long) of every group by its prefixes: one grouping-sets pass.

    Columns: group, ``_level`` (3 for the group itself, then 2, 1, 0 for the value without 2, 1, 0 digits),
    ``_prefix``, ``_n`` and the ``more`` aggregates (over all rows of the group, at level 3).
    """
    prefixes = [f"_p{i}" for i in range(3)]
    rows = values.select("*", *[F.shiftright(F.col(value), i * low_bits).alias(p) for i, p in enumerate(prefixes)])
    sets = [[group, p] for p in prefixes] + [[group]]
    level = F.lit(3)
    for i, p in enumerate(prefixes):
        level = F.when(F.grouping(p) == 0, i).otherwise(level)
    counts = rows.groupingSets(sets, group, *prefixes).agg(level.alias("_level"), F.count(value).alias("_n"), *more)
    # the other prefixes are null at a level; values that are null count at level 3 only
    prefix = F.coalesce(*prefixes).alias("_prefix")
    names = [c for c in counts.columns if c not in (group, *prefixes, "_level", "_n")]
    return counts.select(group, "_level", prefix, "_n", *names).where("_level = 3 or _prefix is not null")


def order_statistic(
    counts: DataFrame, ranks: DataFrame, group: str, value: str, rank: str, low_bits: int = 20
) -> DataFrame:
    """Per group, the ``rank``-th smallest (0-based) of the values that ``digit_counts`` has counted.

    ``counts``: its result, written; ``ranks``: one row per group with the wanted rank. Returns (group, ``value``,
    n_le) where n_le counts values <= it.
    """
    pick = ranks.select(group, F.col(rank).cast("long").alias("_r"), F.lit(0).cast("long").alias("_lt"))
    keys = [group]
    for i in (2, 1, 0):
        # the values of the chosen prefix, counted by their next digit
        level = counts.where(F.col("_level") == i).select(group, "_prefix", "_n")
        if i < 2:
            level = level.withColumn("_above", F.shiftright("_prefix", low_bits))
            pick = pick.withColumnRenamed("_chosen", "_above")
            keys = [group, "_above"]
        level = level.join(pick, keys).withColumn("_b", _before("_prefix", keys, "_n"))
        level = level.where((F.col("_b") <= F.col("_r")) & (F.col("_r") < F.col("_b") + F.col("_n")))
        found = level
        pick = level.select(
            group, F.col("_prefix").alias("_chosen"), (F.col("_r") - F.col("_b")).alias("_r"), (F.col("_lt") + F.col("_b")).alias("_lt")
        )
    return found.select(group, F.col("_prefix").alias(value), (F.col("_lt") + F.col("_b") + F.col("_n")).alias("n_le"))
