"""Ordered per-session work (E1, E3-E6, A9): calendar fields, event order,
first/last event, inter-event gaps, category switches, gap statistics.

Order inside a session is (event_time, event_id): Spark has no file order, so
the event id breaks ties.

A window partitioned by the session alone would put a session holding a third
of the table into one task. Instead every session is cut into *blocks* of time: whole
hours, and an hour that holds many events of one session (counted beforehand) into as many equal
parts as it needs. Blocks are a function of the row, so one hash exchange on (session, block) brings the
events together and nothing has to be written. Windows run per (session, block); the last row of each
block (one row per block, mostly one block per session) carries the offset and the last event to the
next block, which fixes its first row. Everything stays in native expressions; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickflow.config import Workspace, session_workspace
from clickflow.functions.stats import digit_counts, order_statistic
from clickflow.schema import SESSION

_BLK = "_blk"
HOUR = 3_600_000_000  # microseconds
#: Events of one block at most, if they are spread over their hour.
BLOCK_ROWS = 250_000
#: Only hours with more than this part of all events are cut: the list of them has fewer rows than this.
HEAVY_HOURS = 200_000
HOUR_MARKS = 1 << 16
PARTS = 1 << 20  # of one hour at most
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(col: str = "event_time") -> Column:
    """Wall-clock microseconds since epoch, with no time-zone shift."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, {col})")


def event_calendar(events: DataFrame) -> DataFrame:
    """Hour, day_of_week (Monday = 0), month, day, is_weekend."""
    dow = F.weekday("event_time")
    return events.select(
        "*",
        F.hour("event_time").alias("hour"),
        dow.alias("day_of_week"),
        F.month("event_time").alias("month"),
        F.dayofmonth("event_time").alias("day"),
        (dow >= 5).cast("int").alias("is_weekend"),
    )


def heavy_hours(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """session, ``_hour``, ``_parts``: the hours in which a session has more than ``block_rows`` events and more than one in
    ``HEAVY_HOURS`` of all events, and into how many parts they are cut. Fewer than ``HEAVY_HOURS`` rows."""
    many = F.greatest(F.lit(block_rows), F.col("_total") / HEAVY_HOURS)
    # Nearly every event has an hour of its own, so the hours are first counted by a small hash, which shuffles
    # ``HOUR_MARKS`` rows a task; only hours whose hash has enough events are counted themselves.
    marked = rows.select(SESSION, "_hour", F.pmod(F.xxhash64(SESSION, "_hour"), F.lit(HOUR_MARKS)).alias("_mark"))
    marks = marked.groupBy("_mark").agg(F.count(F.lit(1)).alias("_c"))
    total = marks.agg(F.sum("_c").alias("_total"))
    near = marks.crossJoin(F.broadcast(total)).where(F.col("_c") > many).select("_mark", "_total")
    counts = marked.join(F.broadcast(near), "_mark").groupBy(SESSION, "_hour", "_total").agg(F.count(F.lit(1)).alias("_c"))
    heavy = counts.where(F.col("_c") > many)
    parts = F.least(F.ceil(F.col("_c") / block_rows), F.lit(PARTS)).cast("long")
    return heavy.select(SESSION, "_hour", parts.alias("_parts"))


def ordered_events(events: DataFrame, extra: tuple[str, ...] = ("category_id",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each event with its order in the session and its predecessor.

    Output: session, event_id, ``_t`` (µs), ``extra`` columns, ``event_order`` (1-based), ``_prev_t`` and
    ``_prev_<c>`` for each extra column, and ``_has_prev``. Events without a time come first, in a block of
    their own. Events of one microsecond always share a block.
    """
    base = events.where(F.col(SESSION).isNotNull()).select(SESSION, "event_id", micros().alias("_t"), *extra)
    rows = base.withColumn("_hour", F.expr(f"(_t - pmod(_t, {HOUR}L)) div {HOUR}L"))
    cut = rows.join(F.broadcast(heavy_hours(rows, block_rows)), [SESSION, "_hour"], "left")
    part = F.expr(f"(pmod(_t, {HOUR}L) * coalesce(_parts, 1L)) div {HOUR}L")
    block = F.coalesce(F.col("_hour") * PARTS + part, F.lit(-(1 << 62)))
    cut = cut.select(SESSION, "event_id", "_t", *extra, block.alias(_BLK))
    w = Window.partitionBy(SESSION, _BLK).orderBy("_t", "event_id")
    win = cut.select(
        "*",
        F.row_number().over(w).alias("_rn"),
        F.lag("_t").over(w).alias("_lt"),
        *[F.lag(c).over(w).alias(f"_l_{c}") for c in extra],
        F.lead(F.lit(True)).over(w).isNull().alias("_last"),
    )
    # The last row of every block has the block's size and what the next block's first row needs.
    last = win.where("_last").select(SESSION, _BLK, "_rn", "_t", *extra)
    bw = Window.partitionBy(SESSION).orderBy(_BLK)
    fix = last.select(
        SESSION,
        _BLK,
        F.coalesce(F.sum("_rn").over(bw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.lag(_BLK).over(bw).isNotNull().alias("_pb"),
        F.lag("_t").over(bw).alias("_pbt"),
        *[F.lag(c).over(bw).alias(f"_pb_{c}") for c in extra],
    )
    j = win.join(fix, [SESSION, _BLK])
    first = F.col("_rn") == 1
    return j.select(
        SESSION,
        "event_id",
        "_t",
        *extra,
        (F.col("_off") + F.col("_rn")).alias("event_order"),
        F.when(first, F.col("_pbt")).otherwise(F.col("_lt")).alias("_prev_t"),
        *[F.when(first, F.col(f"_pb_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"_prev_{c}") for c in extra],
        (~first | F.col("_pb")).alias("_has_prev"),
    )


# Integer codes of the event vocabulary (any other non-null type is 4).
TYPE_CODES = {"VIEW": 0, "ADD_CART": 1, "REMOVE_CART": 2, "BUY": 3}


def type_code(col: Column) -> Column:
    """Event type as a small int (fixed-width aggregate buffers)."""
    expr = None
    for name, code in TYPE_CODES.items():
        expr = F.when(col == name, code) if expr is None else expr.when(col == name, code)
    return F.when(col.isNull(), F.lit(None).cast("int")).otherwise(expr.otherwise(4)).cast("int")


def _differs(a: str, b: str) -> Column:
    """pandas ``a != b``: true when either side is null (NaN != NaN)."""
    return ~F.coalesce(F.col(a) == F.col(b), F.lit(False))


def event_order(events: DataFrame) -> DataFrame:
    """1-based position of each event in its session."""
    return ordered_events(events, ()).select(SESSION, "event_id", F.col("event_order").cast("int"))


def inter_event_gaps(events: DataFrame) -> DataFrame:
    """E5: seconds since the previous event of the session (first event: none)."""
    o = ordered_events(events, ())
    return o.where("_has_prev").select(
        SESSION, "event_id", ((F.col("_t") - F.col("_prev_t")) / 1e6).alias("gap_seconds")
    )


def category_switches(events: DataFrame) -> DataFrame:
    """Per session, neighbours whose category differs (null != null)."""
    o = ordered_events(events, ("category_id",))
    sw = F.when(F.col("_has_prev") & _differs("category_id", "_prev_category_id"), 1).otherwise(0)
    return o.groupBy(SESSION).agg(F.sum(sw).cast("long").alias("category_switch_count"))


def type_place() -> Column:
    """One fixed-width number that orders events by (time, id) and ends in the type's code: its minimum and maximum
    over a group are the first and last event with a type, in a hash aggregate. Null without a type or time."""
    wide = "decimal(38,0)"
    place = micros().cast("decimal(18,0)").cast(wide) * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.coalesce("event_id", F.lit(0)).cast(wide)
    packed = (place.cast(wide) * F.lit(8).cast("decimal(1,0)")).cast(wide) + type_code(F.col("event_type")).cast(wide)
    return F.when(F.col("event_type").isNotNull(), packed.cast(wide))


def placed_code(place: str) -> Column:
    """The type's code of a ``type_place``."""
    return F.pmod(F.col(place), F.lit(8).cast("decimal(38,0)")).cast("int")


def first_last_event(events: DataFrame) -> DataFrame:
    """First and last non-null event type by (time, id), a hash aggregate combined
    map-side. A type outside the vocabulary is returned as OTHER."""
    agg = events.where(F.col(SESSION).isNotNull()).groupBy(SESSION).agg(
        F.min(type_place()).alias("_first"), F.max(type_place()).alias("_last")
    )
    names = F.array(*map(F.lit, [*sorted(TYPE_CODES, key=TYPE_CODES.get), "OTHER"]))
    return agg.select(
        SESSION,
        F.get(names, placed_code("_first")).alias("first_event_type"),
        F.get(names, placed_code("_last")).alias("last_event_type"),
    )


GAP_COLUMNS = (
    "avg_time_between_events",
    "std_time_between_events",
    "min_time_between_events",
    "max_time_between_events",
    "total_pause_time",
    "long_pauses_count",
)


def sequence_stats(events: DataFrame, ws: Workspace | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A9 + E6 per session: gap mean, sample std, min, max, sum, the number of
    gaps above the session's own linear 75 % quantile, and category switches.
    Sessions of one event get zeros (std of one gap is null, filled later).

    The quantile is exact: with lo = floor(0.75 (m - 1)) the interpolated value
    lies between the lo-th and next order statistic, so "gap > q75" equals
    "gap > lo-th smallest gap"; that order statistic comes from a bounded
    radix select on integer microseconds.

    The events are read once: one grouping-sets pass counts the gaps by their prefixes and
    aggregates the sessions, and is written to ``ws`` (or the session's workspace), by level. This
    call runs that job.
    """
    o = ordered_events(events, ("category_id",), block_rows)
    gap = F.when(F.col("_has_prev"), F.col("_t") - F.col("_prev_t"))
    sw = F.when(F.col("_has_prev") & _differs("category_id", "_prev_category_id"), 1).otherwise(0)
    # Mean, min, max and sum on integer microseconds (exact), then to seconds.
    g = F.col("_g")
    more = [
        (F.avg(g) / 1e6).alias("avg_time_between_events"),
        F.stddev_samp(g / 1e6).alias("std_time_between_events"),
        (F.min(g) / 1e6).alias("min_time_between_events"),
        (F.max(g) / 1e6).alias("max_time_between_events"),
        (F.sum(g) / 1e6).alias("total_pause_time"),
        F.sum("_sw").cast("long").alias("category_switch_count"),
    ]
    counts = digit_counts(o.select(SESSION, gap.alias("_g"), sw.alias("_sw")), SESSION, "_g", more)
    counts = (ws or session_workspace(events.sparkSession)).put(counts, "gaps", ("_level",))
    stats = counts.where("_level = 3").withColumnRenamed("_n", "_m")
    ranks = stats.where(F.col("_m") > 0).select(SESSION, F.floor((F.col("_m") - 1) * F.lit(0.75)).cast("long").alias("_k"))
    q = order_statistic(counts, ranks, SESSION, "_g", "_k")
    out = stats.join(q.select(SESSION, "n_le"), SESSION, "left")
    zero = F.lit(0.0)
    has = F.col("_m") > 0
    return out.select(
        SESSION,
        *[F.when(has, F.col(c)).otherwise(zero).alias(c) for c in GAP_COLUMNS[:5]],
        F.when(has, F.col("_m") - F.col("n_le")).otherwise(F.lit(0)).cast("long").alias("long_pauses_count"),
        "category_switch_count",
    )
