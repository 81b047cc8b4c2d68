"""Session features (A1-A11, D1-D17, B1-B2): one wide row per session.

Plan: up to three per-session tables joined on the session key, then projections. Which of them a
call builds follows from the columns it is asked for (``SOURCES``).

* ``session_aggregates`` - one grouped aggregate over the events (counts,
  calendar min/max/mean/std, per-type counts, first/last type, presence
  flags, lowest and highest label). Only algebraic aggregates (distinct months and days as bit
  sets, first and last type as one packed number), so it is a codegen hash aggregate, combined
  map-side: a hot session costs one partial row per task. Aggregates that no asked column needs are
  pruned by the optimizer.
* ``value_counts`` - per (session, product), (session, category),
  (session, user) and (session, event type): one grouping-sets aggregate (one
  Expand, one exchange), reduced per session to distinct counts, top count
  and null presence; only for the value columns that are needed.
* ``sequence_stats`` - ordered work over blocks of time (see ``sequence``).

Dataset statistics (activity quantiles, equal-width bin ranges) are computed
per split over the chosen sessions; that table has one row per split, so the
broadcast is bounded by the number of splits. Where they are needed the session table is read twice, so
it is written once to the run's workspace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.config import Workspace, session_workspace
from clickflow.functions.expr import c, equal_width_bin, finite_or_zero, flag, hour_bin, ratio
from clickflow.operators.sequence import GAP_COLUMNS, TYPE_CODES, event_calendar, micros, placed_code, sequence_stats, type_place
from clickflow.operators.triage import MODEL, session_class, triage_aggregates
from clickflow.schema import EVENT_TYPES, LABEL, SESSION

BASE_COLUMNS = (
    "product_id_nunique",
    "product_id_count",
    "category_id_nunique",
    "category_id_count",
    "event_type_count",
    "user_id_nunique",
    "hour_min",
    "hour_max",
    "hour_mean",
    "hour_std",
    "day_of_week_min",
    "day_of_week_max",
    "day_of_week_mean",
    "month_nunique",
    "day_nunique",
    "event_order_max",
)


def type_columns(event_types: Sequence[str] = EVENT_TYPES) -> list[str]:
    """Count columns are ordered by name, as a crosstab orders them."""
    return sorted(event_types)


def session_aggregates(
    events: DataFrame, event_types: Sequence[str] = EVENT_TYPES, with_label: bool = False
) -> DataFrame:
    """The main per-session aggregate; ``with_label`` adds the ``LABEL_COLUMNS``."""
    ev = event_calendar(events.where(F.col(SESSION).isNotNull()))
    et = F.col("event_type")
    # Split as a code (0 train, 1 test): a fixed-width buffer keeps this a
    # hash aggregate (a string min would force a sort-based one).
    split_code = F.when(F.col("split") == "train", 0).when(F.col("split") == "test", 1).otherwise(2)
    return ev.groupBy(SESSION).agg(
        F.min(split_code).alias("_split_code"),
        F.min(micros()).alias("_t_min"),
        F.max(micros()).alias("_t_max"),
        F.count("product_id").alias("product_id_count"),
        F.count("category_id").alias("category_id_count"),
        F.count("event_type").alias("event_type_count"),
        F.min("hour").alias("hour_min"),
        F.max("hour").alias("hour_max"),
        F.avg("hour").alias("hour_mean"),
        F.stddev_samp("hour").alias("hour_std"),
        F.min("day_of_week").alias("day_of_week_min"),
        F.max("day_of_week").alias("day_of_week_max"),
        F.avg("day_of_week").alias("day_of_week_mean"),
        # Distinct months / days as a bit set: exact, small domains, and a plain
        # (codegen) hash aggregate instead of collect_set's object aggregate.
        F.expr("cast(bit_count(bit_or(shiftleft(1, month))) as bigint)").alias("month_nunique"),
        F.expr("cast(bit_count(bit_or(shiftleft(1L, day))) as bigint)").alias("day_nunique"),
        F.count(F.lit(1)).alias("event_order_max"),
        *[F.count_if(et == t).alias(t) for t in type_columns(event_types)],
        F.bool_or(et == "VIEW").alias("_has_view"),
        F.bool_or(et == "ADD_CART").alias("_has_cart"),
        F.bool_or(et == "BUY").alias("_has_buy"),
        # First and last non-null event type.
        F.min(type_place()).alias("_first_place"),
        F.max(type_place()).alias("_last_place"),
        # One label for most sessions; the others are known by these.
        *(label_aggregates() if with_label else ()),
        # T10 in the same aggregate: the session class needs no second pass.
        *triage_aggregates(),
    )


def label_aggregates() -> list[F.Column]:
    """Lowest and highest label of a session's train rows, and how many have one or none."""
    train = F.col("split") == "train"
    label = F.when(train, F.col(LABEL))
    return [
        F.min(label).alias("_label_min"),
        F.max(label).alias("_label_max"),
        F.count(label).alias("_labels"),
        F.count_if(train & F.col(LABEL).isNull()).alias("_no_labels"),
    ]


def value_counts(
    events: DataFrame, columns: Sequence[str] = ("product_id", "category_id", "user_id", "event_type")
) -> DataFrame:
    """A6-A7 inputs: per session and column, distinct non-null values, count
    of the most frequent non-null value, and whether a null occurs."""
    cols = list(columns)
    ev = events.where(F.col(SESSION).isNotNull()).select(SESSION, *cols)
    gs = ev.groupingSets([[SESSION, x] for x in cols], SESSION, *cols).agg(
        F.count(F.lit(1)).alias("_n"), *[F.grouping(x).alias(f"_gr_{x}") for x in cols]
    )
    aggs = []
    for x in cols:
        mine = F.col(f"_gr_{x}") == 0
        val = mine & F.col(x).isNotNull()
        aggs += [
            F.count_if(val).alias(f"{x}_nunique"),
            F.coalesce(F.max(F.when(val, F.col("_n"))), F.lit(0)).alias(f"_{x}_top"),
            F.max((mine & F.col(x).isNull()).cast("int")).alias(f"_{x}_hasnull"),
        ]
    return gs.groupBy(SESSION).agg(*aggs)


VALUE_COLUMNS = ("product_id", "category_id", "user_id", "event_type")
SEQUENCE, STATISTICS = "sequence", "statistics"


def session_core(
    events: DataFrame,
    event_types: Sequence[str] = EVENT_TYPES,
    sources: set[str] | None = None,
    ws: Workspace | None = None,
    with_label: bool = False,
) -> DataFrame:
    """Per-session table with every column that needs no dataset statistic. ``sources`` (default: all) names
    the value columns to count and whether the ordered events are needed."""
    sources = {*VALUE_COLUMNS, SEQUENCE} if sources is None else sources
    agg = session_aggregates(events, event_types, with_label)
    split = F.when(F.col("_split_code") == 0, "train").when(F.col("_split_code") == 1, "test")
    core = agg.withColumns(
        {
            "_split": split,
            "_class": session_class(),
            "_first_code": placed_code("_first_place"),
            "_last_code": placed_code("_last_place"),
        }
    )
    counted = [x for x in VALUE_COLUMNS if x in sources]
    if counted:
        vc = value_counts(events, counted)
        if "event_type" in counted:  # A8: the set size counts null as one more type
            vc = vc.withColumn("event_type_diversity", (F.col("event_type_nunique") + F.col("_event_type_hasnull")).cast("long"))
        core = core.join(vc, SESSION, "left")
    if SEQUENCE in sources:
        core = core.join(sequence_stats(events, ws), SESSION, "left")
    return core


def _activity_stats(core: DataFrame) -> DataFrame:
    """Per split, linear quantiles of the event count (exact; the
    percentile map holds one entry per distinct count value, a small domain)
    and min/max of event count and duration for the equal-width bins."""
    minutes = (c("_t_max") - c("_t_min")) / 1e6 / 60
    return core.groupBy("_split").agg(
        F.percentile("event_type_count", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.9))).alias("_q"),
        F.min("event_type_count").alias("_ec_min"),
        F.max("event_type_count").alias("_ec_max"),
        F.min(minutes).alias("_dm_min"),
        F.max(minutes).alias("_dm_max"),
    )


def activity_quantiles(core: DataFrame) -> DataFrame:
    """A10 as a table: split, q25, q75, q90 of the per-session event count."""
    s = _activity_stats(core)
    return s.select(
        F.col("_split").alias("split"),
        F.col("_q")[0].alias("q25"),
        F.col("_q")[1].alias("q75"),
        F.col("_q")[2].alias("q90"),
    )


def sources_of(columns: Sequence[str] | None, event_types: Sequence[str] = EVENT_TYPES) -> set[str]:
    """What the asked features are made of beyond the main aggregate: value columns to count, ``SEQUENCE`` (the
    ordered events) and ``STATISTICS`` (of the whole table)."""
    if columns is None:
        return {*VALUE_COLUMNS, SEQUENCE, STATISTICS}
    unknown = set(columns) - {*FEATURE_SOURCES, *event_types, *(f"{t}_{k}" for t in event_types for k in ("ratio", "per_minute", "per_product"))}
    if unknown:
        raise ValueError(f"unknown features: {', '.join(sorted(unknown))}")
    found: set[str] = set()
    for name in columns:
        found |= FEATURE_SOURCES.get(name, {"product_id"} if name.endswith("_per_product") else set())
    return found


def session_features(
    events: DataFrame,
    sessions: DataFrame | None = None,
    event_types: Sequence[str] = EVENT_TYPES,
    keep_split: bool = True,
    model_only: bool = False,
    columns: Sequence[str] | None = None,
    ws: Workspace | None = None,
    with_label: bool = False,
    statistics: str = "split",
) -> DataFrame:
    """``user_session`` (+ ``split``) and 112 features per session, or those of ``columns``.

    ``sessions``: optional one-column table of session ids to keep;
    ``model_only``: keep the model sessions of triage (classified inside the
    same aggregate). Statistics are computed over the kept sessions only, per
    split, as the reference computes them per input frame (``statistics="train"``: those of train for all rows,
    so that no test row takes part in them). Without ``model_only`` a session that stands in
    both splits is one row of train. ``with_label`` adds the ``LABEL_COLUMNS`` that ``attach_label`` reads.

    Features that need ordered events or dataset statistics write a table to ``ws`` (or the session's
    workspace) when this is called; the others only plan.
    """
    if statistics not in ("split", "train"):
        raise ValueError(f"statistics are those of 'split' or 'train', not {statistics!r}")
    sources = sources_of(columns, event_types)
    ws = ws or (session_workspace(events.sparkSession) if sources & {SEQUENCE, STATISTICS} else None)
    core = session_core(events, event_types, sources, ws, with_label)
    if model_only:
        # Triage class from the same aggregate: keep the modelled sessions.
        core = core.where(F.col("_class") == MODEL)
    if sessions is not None:
        core = core.join(sessions.select(SESSION), SESSION, "left_semi")
    if STATISTICS in sources:
        core = ws.put(core, "sessions")
        stats = _activity_stats(core)
        if statistics == "train":
            stats = stats.where("_split = 'train'").drop("_split")
            core = core.join(F.broadcast(stats), F.lit(True), "left")  # one row, or none
        else:
            core = core.join(F.broadcast(stats), "_split", "left")
    wanted = None if columns is None else list(columns)
    return _project(core, event_types, keep_split, wanted, LABEL_COLUMNS if with_label else ())


#: What ``session_features(with_label=True)`` adds for ``attach_label``.
LABEL_COLUMNS = ("_label_min", "_label_max", "_labels", "_no_labels")


class _Columns(dict):
    """Columns of the session table by name; one that was not built is null (no asked feature is made of it)."""

    def __init__(self, df: DataFrame):
        super().__init__({name: c(name) for name in df.columns})

    def __call__(self, name: str) -> F.Column:
        return self.get(name, F.lit(None).cast("double"))


def _project(
    t: DataFrame, event_types: Sequence[str], keep_split: bool, wanted: list[str] | None = None, more: Sequence[str] = ()
) -> DataFrame:
    """The features in output order (``wanted``: these in their own order) and the columns of ``more``."""
    c = _Columns(t)
    types = type_columns(event_types)
    n = c("event_type_count")
    pn = c("product_id_nunique")
    cn = c("category_id_nunique")
    rows = c("event_order_max")
    secs = (c("_t_max") - c("_t_min")) / 1e6
    mins = secs / 60
    hrs = secs / 3600
    start = c("hour_min")
    prod_top_ratio = c("_product_id_top").cast("double") / rows
    cat_top_ratio = c("_category_id_top").cast("double") / rows
    zero_if_missing = lambda name: F.coalesce(c(name), F.lit(0))
    cnt = {ty: c(ty) for ty in types}
    view, cart, remove, buy = (cnt.get(k, F.lit(0)) for k in ("VIEW", "ADD_CART", "REMOVE_CART", "BUY"))
    first, last = c("_first_code"), c("_last_code")
    codes = TYPE_CODES
    has_view, has_cart, has_buy = (F.coalesce(c(k), F.lit(False)) for k in ("_has_view", "_has_cart", "_has_buy"))

    cols = []
    for x in BASE_COLUMNS:
        cols.append((F.coalesce(c(x), F.lit(0.0)) if x == "hour_std" else c(x)).alias(x))
    cols += [cnt[ty].alias(ty) for ty in types]
    cols += [
        # Unique ratio counts null as a value; top count does not.
        ((pn + zero_if_missing("_product_id_hasnull")).cast("double") / rows).alias("product_unique_ratio"),
        c("_product_id_top").alias("most_viewed_product_count"),
        prod_top_ratio.alias("most_viewed_product_ratio"),
        ((cn + zero_if_missing("_category_id_hasnull")).cast("double") / rows).alias("category_unique_ratio"),
        c("_category_id_top").alias("most_viewed_category_count"),
        cat_top_ratio.alias("most_viewed_category_ratio"),
        zero_if_missing("category_switch_count").alias("category_switch_count"),
        # D1-D4
        secs.alias("session_duration_seconds"),
        mins.alias("session_duration_minutes"),
        hrs.alias("session_duration_hours"),
        start.alias("session_start_hour"),
        c("hour_max").alias("session_end_hour"),
        (c("hour_max") - start).alias("session_hour_span"),
        c("hour_mean").alias("avg_session_hour"),
        flag((start >= 6) & (start < 12)).alias("is_morning"),
        flag((start >= 12) & (start < 18)).alias("is_afternoon"),
        flag((start >= 18) & (start < 22)).alias("is_evening"),
        flag((start >= 22) | (start < 6)).alias("is_night"),
        flag(c("day_of_week_min") >= 5).alias("starts_weekend"),
        flag(c("day_of_week_max") >= 5).alias("ends_weekend"),
        flag((c("day_of_week_min") < 5) & (c("day_of_week_max") >= 5)).alias("crosses_weekend"),
        # D5
        flag(F.coalesce(first == codes["VIEW"], F.lit(False))).alias("first_event_is_view"),
        flag(F.coalesce(first == codes["ADD_CART"], F.lit(False))).alias("first_event_is_cart"),
        flag(F.coalesce(first == codes["BUY"], F.lit(False))).alias("first_event_is_buy"),
        flag(F.coalesce(last == codes["VIEW"], F.lit(False))).alias("last_event_is_view"),
        flag(F.coalesce(last == codes["BUY"], F.lit(False))).alias("last_event_is_buy"),
        flag(F.coalesce(last == codes["ADD_CART"], F.lit(False))).alias("last_event_is_cart"),
        flag(F.coalesce((first == codes["VIEW"]) & (last == codes["BUY"]), F.lit(False))).alias("view_to_buy_direct"),
        flag(has_view & has_cart & has_buy).alias("view_cart_buy_funnel"),
        flag(has_view & has_buy).alias("has_view_and_buy"),
        flag(has_cart & has_buy).alias("has_cart_and_buy"),
        c("event_type_diversity").alias("event_type_diversity"),
        # A9
        *[F.coalesce(c(x), F.lit(0.0)).alias(x) for x in GAP_COLUMNS[:5]],
        zero_if_missing("long_pauses_count").alias("long_pauses_count"),
    ]
    # D6
    for ty in types:
        cols += [
            ratio(cnt[ty], n).alias(f"{ty}_ratio"),
            ratio(cnt[ty], mins).alias(f"{ty}_per_minute"),
            ratio(cnt[ty], pn).alias(f"{ty}_per_product"),
        ]
    q25, q75, q90 = (F.get(c["_q"], F.lit(i)) if "_q" in c else c("_q") for i in range(3))
    cols += [
        # D7
        ratio(cart, view).alias("cart_conversion_rate"),
        ratio(buy, cart).alias("purchase_conversion_rate"),
        ratio(buy, view).alias("direct_purchase_rate"),
        ratio(remove, cart).alias("cart_abandonment_rate"),
        # D8
        ratio(n, mins).alias("events_per_minute"),
        ratio(n, hrs).alias("events_per_hour"),
        ratio(pn, mins).alias("products_per_minute"),
        ratio(cn, mins).alias("categories_per_minute"),
        # D9
        flag(mins < 5).alias("is_short_session"),
        flag((mins >= 5) & (mins <= 30)).alias("is_medium_session"),
        flag(mins > 30).alias("is_long_session"),
        flag(mins > 60).alias("is_very_long_session"),
        # D10
        flag(n > q75).alias("is_high_activity"),
        flag(n < q25).alias("is_low_activity"),
        flag(n > q90).alias("is_very_high_activity"),
        # D11-D13
        ratio(pn, n).alias("product_diversity_index"),
        ratio(cn, n).alias("category_diversity_index"),
        ratio(pn * cn, n).alias("exploration_index"),
        ratio(pn, mins).alias("session_efficiency"),
        ratio(n, pn).alias("browsing_intensity"),
        (prod_top_ratio * cat_top_ratio).alias("focus_score"),
        ratio(buy + cart, view).alias("purchase_intent_score"),
        (pn + cn).alias("exploration_breadth"),
        ratio(n, pn + cn).alias("exploration_depth"),
    ]
    # D14
    for name, x in (
        ("event_type_count", n),
        ("session_duration_minutes", mins),
        ("product_id_nunique", pn),
        ("category_id_nunique", cn),
    ):
        cols += [F.log1p(x.cast("double")).alias(f"{name}_log"), F.sqrt(x.cast("double")).alias(f"{name}_sqrt")]
    for name, x in (("event_type_count", n), ("session_duration_minutes", mins), ("product_id_nunique", pn)):
        cols.append((x.cast("double") * x.cast("double")).alias(f"{name}_squared"))
    cols += [
        # B1-B2
        equal_width_bin(n.cast("double"), c("_ec_min").cast("double"), c("_ec_max").cast("double")).alias(
            "event_count_bin"
        ),
        equal_width_bin(mins, c("_dm_min"), c("_dm_max")).alias("duration_bin"),
        F.coalesce(hour_bin(start), F.lit(0)).alias("hour_bin"),
        # D15
        (mins * n.cast("double")).alias("duration_x_events"),
        (pn * cn).alias("products_x_categories"),
        (start.cast("double") * mins).alias("hour_x_duration"),
        (view * buy).alias("view_buy_interaction"),
    ]
    names = _output_names(types)
    chosen = dict(zip(names, cols, strict=True))
    keys = [c(SESSION)] + ([c("_split").alias("split")] if keep_split else [])
    out = t.select(*keys, *[chosen[n] for n in (names if wanted is None else wanted)], *more)
    # D16
    return finite_or_zero(out, keep=(SESSION, "split", *more))


FEATURE_GROUPS = {
    "session_base_agg": list(BASE_COLUMNS),
    "event_type_crosstab": type_columns(),
    "product_concentration": ["product_unique_ratio", "most_viewed_product_count", "most_viewed_product_ratio"],
    "category_concentration": [
        "category_unique_ratio",
        "most_viewed_category_count",
        "most_viewed_category_ratio",
        "category_switch_count",
    ],
    "session_duration": ["session_duration_seconds", "session_duration_minutes", "session_duration_hours"],
    "session_hours": ["session_start_hour", "session_end_hour", "session_hour_span", "avg_session_hour"],
    "time_of_day_flags": ["is_morning", "is_afternoon", "is_evening", "is_night"],
    "weekend_flags": ["starts_weekend", "ends_weekend", "crosses_weekend"],
    "sequence_flags": [
        "first_event_is_view",
        "first_event_is_cart",
        "first_event_is_buy",
        "last_event_is_view",
        "last_event_is_buy",
        "last_event_is_cart",
        "view_to_buy_direct",
        "view_cart_buy_funnel",
        "has_view_and_buy",
        "has_cart_and_buy",
        "event_type_diversity",
    ],
    "session_gap_stats": [
        "avg_time_between_events",
        "std_time_between_events",
        "min_time_between_events",
        "max_time_between_events",
        "total_pause_time",
        "long_pauses_count",
    ],
    "event_type_rates": [f"{t}_{k}" for t in type_columns() for k in ("ratio", "per_minute", "per_product")],
    "conversion_rates": [
        "cart_conversion_rate",
        "purchase_conversion_rate",
        "direct_purchase_rate",
        "cart_abandonment_rate",
    ],
    "activity_rates": ["events_per_minute", "events_per_hour", "products_per_minute", "categories_per_minute"],
    "session_size_flags": ["is_short_session", "is_medium_session", "is_long_session", "is_very_long_session"],
    "activity_flags": ["is_high_activity", "is_low_activity", "is_very_high_activity"],
    "diversity_indices": ["product_diversity_index", "category_diversity_index", "exploration_index"],
    "efficiency_indices": ["session_efficiency", "browsing_intensity", "focus_score"],
    "intent_and_breadth": ["purchase_intent_score", "exploration_breadth", "exploration_depth"],
    "log_sqrt_square": [
        "event_type_count_log",
        "event_type_count_sqrt",
        "session_duration_minutes_log",
        "session_duration_minutes_sqrt",
        "product_id_nunique_log",
        "product_id_nunique_sqrt",
        "category_id_nunique_log",
        "category_id_nunique_sqrt",
        "event_type_count_squared",
        "session_duration_minutes_squared",
        "product_id_nunique_squared",
    ],
    "equal_width_bins": ["event_count_bin", "duration_bin"],
    "hour_bin": ["hour_bin"],
    "interactions": ["duration_x_events", "products_x_categories", "hour_x_duration", "view_buy_interaction"],
}


def _output_names(types: Sequence[str]) -> list[str]:
    """Names in the order in which ``_project`` lists its columns."""
    rates = [f"{t}_{k}" for t in types for k in ("ratio", "per_minute", "per_product")]
    out = []
    for group, cols in FEATURE_GROUPS.items():
        out += list(types) if group == "event_type_crosstab" else rates if group == "event_type_rates" else cols
    return out


def feature_names() -> list[str]:
    """The 112 feature names in output order."""
    return _output_names(type_columns())


def _feature_sources() -> dict[str, set[str]]:
    """For every feature outside the crosstab what it is made of beyond the main aggregate."""
    out: dict[str, set[str]] = {name: set() for cols in FEATURE_GROUPS.values() for name in cols}
    for name in out:
        for value in VALUE_COLUMNS:
            if name.startswith(f"{value}_nunique"):
                out[name].add(value)
    product = [*FEATURE_GROUPS["product_concentration"], "products_per_minute", "product_diversity_index", "session_efficiency", "browsing_intensity"]
    product += [f"{t}_per_product" for t in type_columns()]
    category = [*FEATURE_GROUPS["category_concentration"][:3], "categories_per_minute", "category_diversity_index"]
    both = ["exploration_index", "focus_score", "exploration_breadth", "exploration_depth", "products_x_categories"]
    for names, value in ((product + both, "product_id"), (category + both, "category_id"), (["event_type_diversity"], "event_type")):
        for name in names:
            out[name].add(value)
    for name in (*FEATURE_GROUPS["session_gap_stats"], "category_switch_count"):
        out[name].add(SEQUENCE)
    for name in (*FEATURE_GROUPS["activity_flags"], *FEATURE_GROUPS["equal_width_bins"]):
        out[name].add(STATISTICS)
    return out


FEATURE_SOURCES = _feature_sources()
