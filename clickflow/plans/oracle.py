"""DuckDB text of every checked query: the independent side of the correctness
gate. Written directly in SQL over the raw ``events`` view (no Spark code is
reused), with the same column names and types as the Spark queries. Doubles
are rounded to 6 places on both sides (``ROUND``) so that summation order does
not decide the comparison.
"""

from __future__ import annotations

from clickflow.operators.features import BASE_COLUMNS, FEATURE_GROUPS, feature_names, type_columns
from clickflow.sources.events import CLICKSTREAM_SQL

EV_COLS = "event_id, event_time, event_type, product_id, category_id, user_id, user_session, session_value, split"

TRIAGE_SQL = """
tri_agg as (
  select user_session,
         max(case when split = 'train' then 1 else 0 end) as in_train,
         max(case when split = 'test' then 1 else 0 end) as in_test,
         coalesce(min(user_id) filter (where split = 'train') <> max(user_id) filter (where split = 'train'), false) as tr_anom,
         coalesce(min(user_id) filter (where split = 'test') <> max(user_id) filter (where split = 'test'), false) as te_anom
  from clk where user_session is not null group by user_session),
tri as (
  select user_session, cast(in_train as integer) as in_train, cast(in_test as integer) as in_test,
         cast(tr_anom as integer) as anomalous_train, cast(te_anom as integer) as anomalous_test,
         case when tr_anom or te_anom then 'anomalous'
              when in_train = 1 and in_test = 1 then 'common' else 'model' end as session_class
  from tri_agg),
anom_ids as (select user_session from tri where session_class = 'anomalous'),
clean as (select * from clk where user_session is null or user_session not in (select user_session from anom_ids)),
mev as (select * from clk where user_session is null
        or user_session in (select user_session from tri where session_class = 'model'))
"""


def r6(expr: str) -> str:
    """Same rounding steps as the Spark side: floor(x * 1e6 + 0.5) / 1e6."""
    return f"(case when abs({expr}) < 1e12 then floor(({expr}) * 1e6 + 0.5) / 1e6 else ({expr}) end)"


# Integer-typed feature columns; every other feature is a double.
INT_FEATURES = set(
    """product_id_nunique product_id_count category_id_nunique category_id_count event_type_count
    user_id_nunique hour_min hour_max day_of_week_min day_of_week_max month_nunique day_nunique
    event_order_max ADD_CART BUY REMOVE_CART VIEW most_viewed_product_count most_viewed_category_count
    category_switch_count session_start_hour session_end_hour session_hour_span is_morning is_afternoon
    is_evening is_night starts_weekend ends_weekend crosses_weekend first_event_is_view first_event_is_cart
    first_event_is_buy last_event_is_view last_event_is_buy last_event_is_cart view_to_buy_direct
    view_cart_buy_funnel has_view_and_buy has_cart_and_buy event_type_diversity long_pauses_count
    is_short_session is_medium_session is_long_session is_very_long_session is_high_activity
    is_low_activity is_very_high_activity exploration_breadth event_count_bin duration_bin hour_bin
    products_x_categories view_buy_interaction""".split()
)


def _ratio(num: str, den: str) -> str:
    return f"cast({num} as double) / (cast({den} as double) + 1e-8)"


def _feature_sql() -> str:
    types = type_columns()
    cnt_cols = ",\n    ".join(f"count(*) filter (where event_type = '{t}') as \"{t}\"" for t in types)
    base = f"""
ev as (
  select *, cast(hour(event_time) as integer) as hour, cast(isodow(event_time) - 1 as integer) as dow,
         month(event_time) as mon, day(event_time) as dom2, epoch_us(event_time) as t
  from mev where user_session is not null),
b as (
  select user_session, min(split) as split, min(t) as t_min, max(t) as t_max,
    count(distinct product_id) as product_id_nunique, count(product_id) as product_id_count,
    count(distinct category_id) as category_id_nunique, count(category_id) as category_id_count,
    count(event_type) as event_type_count, count(distinct user_id) as user_id_nunique,
    min(hour) as hour_min, max(hour) as hour_max, avg(hour) as hour_mean, stddev_samp(hour) as hour_std,
    min(dow) as day_of_week_min, max(dow) as day_of_week_max, avg(dow) as day_of_week_mean,
    count(distinct mon) as month_nunique, count(distinct dom2) as day_nunique, count(*) as event_order_max,
    {cnt_cols},
    first(event_type order by t, event_id) filter (where event_type is not null) as first_type,
    last(event_type order by t, event_id) filter (where event_type is not null) as last_type,
    coalesce(bool_or(event_type = 'VIEW'), false) as has_view,
    coalesce(bool_or(event_type = 'ADD_CART'), false) as has_cart,
    coalesce(bool_or(event_type = 'BUY'), false) as has_buy,
    count(distinct event_type) + max(case when event_type is null then 1 else 0 end) as event_type_diversity,
    max(case when product_id is null then 1 else 0 end) as p_null,
    max(case when category_id is null then 1 else 0 end) as c_null
  from ev group by user_session),
ptop as (select user_session, max(n) as top from
  (select user_session, product_id, count(*) as n from ev where product_id is not null group by 1, 2) group by 1),
ctop as (select user_session, max(n) as top from
  (select user_session, category_id, count(*) as n from ev where category_id is not null group by 1, 2) group by 1),
seq as (
  select user_session, t - lag(t) over w as gap_us,
         case when row_number() over w > 1
              and not coalesce(category_id = lag(category_id) over w, false) then 1 else 0 end as sw
  from ev window w as (partition by user_session order by t, event_id)),
gq as (select user_session, quantile_cont(gap_us, 0.75) as q75_us from seq where gap_us is not null group by 1),
gs as (
  select s.user_session, count(gap_us) as m, avg(gap_us) / 1e6 as g_avg, stddev_samp(gap_us / 1e6) as g_std,
         min(gap_us) / 1e6 as g_min, max(gap_us) / 1e6 as g_max, sum(gap_us) / 1e6 as g_sum,
         count(*) filter (where gap_us > gq.q75_us) as g_long, sum(sw) as switches
  from seq s left join gq using (user_session) group by s.user_session),
core as (
  select b.*, coalesce(ptop.top, 0) as p_top, coalesce(ctop.top, 0) as c_top,
         cast(coalesce(gs.switches, 0) as bigint) as category_switch_count,
         case when gs.m > 0 then gs.g_avg else 0.0 end as avg_time_between_events,
         coalesce(case when gs.m > 0 then gs.g_std else 0.0 end, 0.0) as std_time_between_events,
         case when gs.m > 0 then gs.g_min else 0.0 end as min_time_between_events,
         case when gs.m > 0 then gs.g_max else 0.0 end as max_time_between_events,
         case when gs.m > 0 then gs.g_sum else 0.0 end as total_pause_time,
         cast(case when gs.m > 0 then gs.g_long else 0 end as bigint) as long_pauses_count,
         (t_max - t_min) / 1e6 as secs, (t_max - t_min) / 1e6 / 60 as mins, (t_max - t_min) / 1e6 / 3600 as hrs
  from b left join ptop using (user_session) left join ctop using (user_session)
         left join gs using (user_session)),
st as (
  select split as st_split,
         quantile_cont(event_type_count, 0.25) as q25, quantile_cont(event_type_count, 0.75) as q75,
         quantile_cont(event_type_count, 0.9) as q90,
         cast(min(event_type_count) as double) as ec_min, cast(max(event_type_count) as double) as ec_max,
         min(mins) as dm_min, max(mins) as dm_max
  from core group by split),
x as (select * from core join st on core.split = st.st_split)"""

    def bin_expr(xv: str, lo: str, hi: str) -> str:
        step = f"(({hi}) - ({lo})) / 5.0"
        parts = " + ".join(f"case when {xv} > {float(i)} * {step} + ({lo}) then 1 else 0 end" for i in range(1, 5))
        return f"cast(case when {hi} = {lo} then 2 else {parts} end as integer)"

    n, pn, cn = "event_type_count", "product_id_nunique", "category_id_nunique"
    rows = "event_order_max"

    def fl(cond: str) -> str:
        return f"cast(coalesce({cond}, false) as integer)"

    col = {}
    for k in BASE_COLUMNS:
        col[k] = k
    col["hour_std"] = "coalesce(hour_std, 0.0)"
    for t in types:
        col[t] = f'"{t}"'
    col.update(
        {
            "product_unique_ratio": f"cast({pn} + p_null as double) / {rows}",
            "most_viewed_product_count": "p_top",
            "most_viewed_product_ratio": f"cast(p_top as double) / {rows}",
            "category_unique_ratio": f"cast({cn} + c_null as double) / {rows}",
            "most_viewed_category_count": "c_top",
            "most_viewed_category_ratio": f"cast(c_top as double) / {rows}",
            "category_switch_count": "category_switch_count",
            "session_duration_seconds": "secs",
            "session_duration_minutes": "mins",
            "session_duration_hours": "hrs",
            "session_start_hour": "hour_min",
            "session_end_hour": "hour_max",
            "session_hour_span": "hour_max - hour_min",
            "avg_session_hour": "hour_mean",
            "is_morning": fl("hour_min >= 6 and hour_min < 12"),
            "is_afternoon": fl("hour_min >= 12 and hour_min < 18"),
            "is_evening": fl("hour_min >= 18 and hour_min < 22"),
            "is_night": fl("hour_min >= 22 or hour_min < 6"),
            "starts_weekend": fl("day_of_week_min >= 5"),
            "ends_weekend": fl("day_of_week_max >= 5"),
            "crosses_weekend": fl("day_of_week_min < 5 and day_of_week_max >= 5"),
            "first_event_is_view": fl("first_type = 'VIEW'"),
            "first_event_is_cart": fl("first_type = 'ADD_CART'"),
            "first_event_is_buy": fl("first_type = 'BUY'"),
            "last_event_is_view": fl("last_type = 'VIEW'"),
            "last_event_is_buy": fl("last_type = 'BUY'"),
            "last_event_is_cart": fl("last_type = 'ADD_CART'"),
            "view_to_buy_direct": fl("first_type = 'VIEW' and last_type = 'BUY'"),
            "view_cart_buy_funnel": fl("has_view and has_cart and has_buy"),
            "has_view_and_buy": fl("has_view and has_buy"),
            "has_cart_and_buy": fl("has_cart and has_buy"),
            "event_type_diversity": "cast(event_type_diversity as bigint)",
        }
    )
    for k in (
        "avg_time_between_events",
        "std_time_between_events",
        "min_time_between_events",
        "max_time_between_events",
        "total_pause_time",
        "long_pauses_count",
    ):
        col[k] = k
    for t in types:
        col[f"{t}_ratio"] = _ratio(f'"{t}"', n)
        col[f"{t}_per_minute"] = _ratio(f'"{t}"', "mins")
        col[f"{t}_per_product"] = _ratio(f'"{t}"', pn)
    col.update(
        {
            "cart_conversion_rate": _ratio('"ADD_CART"', '"VIEW"'),
            "purchase_conversion_rate": _ratio('"BUY"', '"ADD_CART"'),
            "direct_purchase_rate": _ratio('"BUY"', '"VIEW"'),
            "cart_abandonment_rate": _ratio('"REMOVE_CART"', '"ADD_CART"'),
            "events_per_minute": _ratio(n, "mins"),
            "events_per_hour": _ratio(n, "hrs"),
            "products_per_minute": _ratio(pn, "mins"),
            "categories_per_minute": _ratio(cn, "mins"),
            "is_short_session": fl("mins < 5"),
            "is_medium_session": fl("mins >= 5 and mins <= 30"),
            "is_long_session": fl("mins > 30"),
            "is_very_long_session": fl("mins > 60"),
            "is_high_activity": fl(f"{n} > q75"),
            "is_low_activity": fl(f"{n} < q25"),
            "is_very_high_activity": fl(f"{n} > q90"),
            "product_diversity_index": _ratio(pn, n),
            "category_diversity_index": _ratio(cn, n),
            "exploration_index": _ratio(f"{pn} * {cn}", n),
            "session_efficiency": _ratio(pn, "mins"),
            "browsing_intensity": _ratio(n, pn),
            "focus_score": f"(cast(p_top as double) / {rows}) * (cast(c_top as double) / {rows})",
            "purchase_intent_score": _ratio('"BUY" + "ADD_CART"', '"VIEW"'),
            "exploration_breadth": f"{pn} + {cn}",
            "exploration_depth": _ratio(n, f"{pn} + {cn}"),
        }
    )
    for name, xv in ((n, n), ("session_duration_minutes", "mins"), (pn, pn), (cn, cn)):
        col[f"{name}_log"] = f"ln(1 + cast({xv} as double))"
        col[f"{name}_sqrt"] = f"sqrt(cast({xv} as double))"
    for name, xv in ((n, n), ("session_duration_minutes", "mins"), (pn, pn)):
        col[f"{name}_squared"] = f"cast({xv} as double) * cast({xv} as double)"
    col.update(
        {
            "event_count_bin": bin_expr(f"cast({n} as double)", "ec_min", "ec_max"),
            "duration_bin": bin_expr("mins", "dm_min", "dm_max"),
            "hour_bin": "cast(case when hour_min > 0 and hour_min <= 6 then 0 when hour_min > 6 and hour_min <= 12 "
            "then 1 when hour_min > 12 and hour_min <= 18 then 2 when hour_min > 18 then 3 else 0 end as integer)",
            "duration_x_events": f"mins * cast({n} as double)",
            "products_x_categories": f"{pn} * {cn}",
            "hour_x_duration": "cast(hour_min as double) * mins",
            "view_buy_interaction": '"VIEW" * "BUY"',
        }
    )
    names = feature_names()
    assert set(names) == set(col), set(names) ^ set(col)
    sel = ",\n  ".join(f'{col[k]} as "{k}"' for k in names)
    return f"""{base},
feat as (
  select user_session, split,
  {sel}
  from x)"""


FEATURE_SQL = _feature_sql()


def with_ctes(*ctes: str) -> str:
    return "with " + ",".join([CLICKSTREAM_SQL, *ctes])


def _num(cols: list[str]) -> str:
    """Round the double feature columns, pass integer ones through."""
    return ", ".join(f'"{c}"' if c in INT_FEATURES else f'{r6(chr(34) + c + chr(34))} as "{c}"' for c in cols)


def core_oracle() -> dict[str, str]:
    tri = with_ctes(TRIAGE_SQL)
    feat = with_ctes(TRIAGE_SQL, FEATURE_SQL)
    q = {
        "scan_events": f"{with_ctes()} select {EV_COLS} from clk",
        "parse_event_time": f"{with_ctes()} select event_id, cast(cast(event_time as varchar) as timestamp) as event_time from clk",
        "triage_sessions": f"{tri} select * from tri",
        "anomalous_sessions": f"""{with_ctes()} select split, user_session from clk where user_session is not null
            group by split, user_session having count(distinct user_id) > 1""",
        "anomalous_union": f"""{with_ctes()} select distinct user_session from (select split, user_session from clk
            where user_session is not null group by split, user_session having count(distinct user_id) > 1)""",
        "clean_events": f"{tri} select {EV_COLS} from clean",
        "anomalous_test_events": f"""{tri} select {EV_COLS} from clk where split = 'test'
            and user_session in (select user_session from anom_ids)""",
        "placeholder_median": f"""{tri} select {r6("median(session_value)")} as placeholder_value
            from clean where split = 'train'""",
        "placeholder_predictions": f"""{tri} select user_session, {r6("(select median(session_value) from clean where split = 'train')")} as session_value
            from tri where session_class = 'anomalous' and in_test = 1""",
        "common_sessions": f"{tri} select user_session from tri where session_class = 'common'",
        "common_answers": f"""{tri} select distinct user_session, {r6("session_value")} as session_value from clk
            where split = 'train' and user_session in (select user_session from tri where session_class = 'common')""",
        "model_events": f"{tri} select {EV_COLS} from mev",
        "event_calendar": f"""{with_ctes()} select event_id, user_session, cast(hour(event_time) as integer) as hour,
            cast(isodow(event_time) - 1 as integer) as day_of_week, cast(month(event_time) as integer) as month,
            cast(day(event_time) as integer) as day, cast(isodow(event_time) >= 6 as integer) as is_weekend from clk""",
        "event_order": f"""{tri} select user_session, event_id, cast(row_number() over (partition by user_session
            order by event_time, event_id) as integer) as event_order from mev where user_session is not null""",
        "first_last_event": f"""{tri} select user_session,
            first(event_type order by event_time, event_id) filter (where event_type is not null) as first_event_type,
            last(event_type order by event_time, event_id) filter (where event_type is not null) as last_event_type
            from mev where user_session is not null group by user_session""",
        "inter_event_gaps": f"""{tri} select user_session, event_id, {r6("gap_us / 1e6")} as gap_seconds from (
            select user_session, event_id, epoch_us(event_time) - lag(epoch_us(event_time)) over
            (partition by user_session order by event_time, event_id) as gap_us from mev where user_session is not null)
            where gap_us is not null""",
        "category_switches": f"""{tri} select user_session, cast(sum(sw) as bigint) as category_switch_count from (
            select user_session, case when row_number() over w > 1 and not coalesce(category_id = lag(category_id)
            over w, false) then 1 else 0 end as sw from mev where user_session is not null
            window w as (partition by user_session order by event_time, event_id)) group by user_session""",
        "activity_quantiles": f"""{feat} select st_split as split, {r6("q25")} as q25, {r6("q75")} as q75,
            {r6("q90")} as q90 from st""",
        "event_presence": f"""{feat} select user_session, split, view_cart_buy_funnel, has_view_and_buy,
            has_cart_and_buy, event_type_diversity from feat""",
        "clean_features": f"""{feat} select user_session, split, {_num(['hour_std', 'std_time_between_events',
            'hour_bin', 'category_switch_count'])} from feat""",
        "session_features": f"{feat} select user_session, split, {_num(feature_names())} from feat",
    }
    for name, cols in FEATURE_GROUPS.items():
        q.setdefault(name, f"{feat} select user_session, split, {_num(cols)} from feat")
    return q


def _model_ctes() -> str:
    names = feature_names()
    corr_cols = ", ".join(f'corr(cast("{c}" as double), session_value) as "{c}"' for c in names)
    return f"""
lab as (select distinct user_session, session_value from clk where split = 'train'),
trn as (select f.*, lab.session_value from feat f left join lab using (user_session) where f.split = 'train'),
tst as (select * from feat where split = 'test'),
corrs as (select {corr_cols} from trn where session_value is not null),
sc as (select feature, case when c is null or isnan(c) then 0.0 else abs(c) end as score
       from (unpivot corrs on columns(*) into name feature value c)),
top as (select feature, score, cast(row_number() over (order by floor(score * 1e9 + 0.5) desc, feature) as integer) as rank
        from sc qualify rank <= 25),
fo as (select user_session, cast((row_number() over (order by md5(user_session || ':42'), user_session) - 1) % 5 as integer) as fold
       from (select distinct user_session from trn)),
d as (select t.user_session, fo.fold, t.session_value, cast(t.event_type_count as double) as x
      from trn t join fo using (user_session) where t.session_value is not null),
per as (select fold, cast(count(*) as double) as n, sum(x) as sx, sum(session_value) as sy,
               sum(x * session_value) as sxy, sum(x * x) as sxx from d group by fold),
oth as (select p.fold, t.n - p.n as n, t.sx - p.sx as sx, t.sy - p.sy as sy, t.sxy - p.sxy as sxy, t.sxx - p.sxx as sxx
        from per p cross join (select sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxy) as sxy, sum(sxx) as sxx from per) t),
pb as (select fold, sx, sy, n, case when n * sxx - sx * sx <> 0 then (n * sxy - sx * sy) / (n * sxx - sx * sx) else 0.0 end as b from oth),
prm as (select fold, b, (sy - b * sx) / n as a from pb),
oof as (select d.user_session, d.fold, d.session_value, prm.a + prm.b * d.x as prediction from d join prm using (fold)),
tp as (select t.user_session, sum(prm.a + prm.b * cast(t.event_type_count as double)) / 5 as prediction
       from tst t cross join prm group by t.user_session),
med as (select median(session_value) as v from clean where split = 'train'),
sub as (
  select user_session, prediction as session_value, 'model' as source from tp
  union all
  select distinct user_session, session_value, 'common' from clk
    where split = 'train' and user_session in (select user_session from tri where session_class = 'common')
  union all
  select user_session, (select v from med), 'placeholder' from tri where session_class = 'anomalous' and in_test = 1)"""


def _cat_case(col: str) -> str:
    rules = [
        ("Temporal", ("time", "hour", "duration", "minute", "second")),
        ("Product/Category", ("product", "category")),
        ("Event/Behavior", ("view", "buy", "cart", "event")),
        ("Conversion/Ratio", ("ratio", "rate", "conversion")),
        ("Aggregation", ("count", "nunique", "sum")),
        ("Engagement", ("diversity", "exploration", "efficiency")),
    ]
    parts = " ".join(
        f"when {' or '.join(f'contains(lower({col}), {chr(39)}{w}{chr(39)})' for w in ws)} then '{name}'"
        for name, ws in rules
    )
    return f"case {parts} else 'Other' end"


def model_oracle() -> dict[str, str]:
    m = with_ctes(TRIAGE_SQL, FEATURE_SQL, _model_ctes())
    names = feature_names()
    train_num = _num(names)
    long_sel = f"""select user_session, split, feature, {r6('value')} as value from
        (unpivot (select * exclude (session_value) from {{src}}) on {{cols}} into name feature value value)
        where feature in (select feature from top)"""
    cols_all = ", ".join(f'"{c}"' for c in names)
    z_src = f"""(select user_session, split, feature, value from
        (unpivot (select user_session, split, {cols_all} from feat) on {cols_all} into name feature value value)
        where feature in (select feature from top))"""
    text_ids = "concat('PROD_', product_id) as product_id, concat('CAT_', category_id) as category_id, concat('USER_', user_id) as user_id"
    broken = "(select split, event_id % 97 = 0 as t, event_id % 89 = 0 as u from clk)"
    return {
        "scan_splits": f"""{with_ctes()} select event_time, event_type, {text_ids}, user_session, split,
            case when split = 'train' then {r6("session_value")} end as session_value from clk""",
        "scan_layouts": f"""{with_ctes()} select event_id, event_time, event_type,
            case when event_id % 2 = 1 then 'one "' || product_id || '"' || chr(10) || ' two' else cast(product_id as varchar) end as product_id,
            cast(category_id as varchar) as category_id, cast(user_id as varchar) as user_id, user_session,
            {r6("session_value")} as session_value, split from clk""",
        "input_status": f"""{with_ctes()} select split as name, true as present, count(*) as n_rows from clk group by split
            union all select 'validation', false, null""",
        "features_train_statistics": f"""{with_ctes(TRIAGE_SQL, FEATURE_SQL.replace(
            "x as (select * from core join st on core.split = st.st_split)",
            "x as (select * from core cross join (select * from st where st_split = 'train'))"))}
            select user_session, split, {_num(FEATURE_GROUPS["activity_flags"] + FEATURE_GROUPS["equal_width_bins"])} from feat""",
        "quarantine": f"""{with_ctes()} select split, reason, count(*) as n_rows from (
            select split, 'bad event_time' as reason from {broken} where t
            union all select split, 'null user_session' as reason from {broken} where u) group by split, reason""",
        "multi_label_sessions": f"""{with_ctes()} select user_session, count(distinct session_value) as n_labels from clk
            where split = 'train' group by user_session having count(distinct session_value) > 1""",
        "attach_label": f"select user_session, split, {r6('session_value')} as session_value, {train_num} from trn",
        "numeric_columns": f"select user_session, {train_num} from trn",
        "sample_rows": f"""select user_session, {r6('session_value')} as session_value from trn
            order by md5(user_session || ':42'), user_session limit 1000""",
        "top_features": f"select feature, {r6('score')} as score, rank from top",
        "select_features": m + " " + f"""select user_session, split, feature, {r6('value')} as value from {z_src}""",
        "feature_reduction": f"""select count(*) as n_features, least(count(*), 25) as n_chosen,
            {r6('(1 - least(count(*), 25) / count(*)) * 100')} as reduction_percent from sc""",
        "model_invariants": """select c.name as "check", c.n, true as holds from (
            select (select count(*) from trn) as n_train, (select count(*) from d) as n_fit, (select count(*) from tst) as n_test) k,
            lateral (values ('attributions add up to the prediction', n_train), ('forest importances are shares', 25),
              ('every feature has a mean attribution', 25), ('mean importances are shares', 25),
              ('forest: one out-of-fold prediction a session', n_fit), ('forest: better than the mean', n_fit),
              ('forest: one test prediction a session', n_test), ('boosted: one out-of-fold prediction a session', n_fit),
              ('boosted: better than the mean', n_fit), ('boosted: one test prediction a session', n_test),
              ('boosted: every fold stops before its limit', 5)) c(name, n)""",
        "standardize": m + " " + f"""select user_session, split, feature, {r6('z')} as z_tmp from (
            select v.user_session, v.split, v.feature,
              (v.value - s.mu) / (case when s.sd is null or s.sd = 0 then 1.0 else s.sd end) as z
            from {z_src} v join (select feature, avg(value) as mu, stddev_pop(value) as sd from {z_src}
              where split = 'train' group by feature) s using (feature))""".replace("as z_tmp", "as value"),
        "kfold_assign": "select user_session, fold from fo",
        "fold_metrics": f"""select fold, n, {r6('rmse')} as rmse, {r6('avg(rmse) over ()')} as rmse_mean,
            {r6('stddev_pop(rmse) over ()')} as rmse_std from (
            select fold, count(*) as n, sqrt(avg((session_value - prediction) * (session_value - prediction))) as rmse
            from oof group by fold)""",
        "oof_metrics": f"""select {r6('sqrt(mse)')} as oof_rmse, {r6('mse')} as oof_mse from (
            select avg((session_value - prediction) * (session_value - prediction)) as mse from oof)""",
        "prediction_stats": f"""select {r6('min(prediction)')} as pred_min, {r6('max(prediction)')} as pred_max,
            {r6('avg(prediction)')} as pred_mean, {r6('median(prediction)')} as pred_median,
            {r6('stddev_pop(prediction)')} as pred_std from tp""",
        "feature_categories": f"select feature, {r6('score')} as score, {_cat_case('feature')} as category from sc",
        "category_report": f"""select category, n_features, rank_in_category, feature, {r6('score')} as score,
            greatest(n_features - 3, 0) as n_more from (
            select category, count(*) over (partition by category) as n_features,
              cast(row_number() over (partition by category order by floor(score * 1e9 + 0.5) desc, feature) as integer)
                as rank_in_category, feature, score
            from (select feature, score, {_cat_case('feature')} as category from top where rank <= 20))
            where rank_in_category <= 3""",
        "assemble_submission": f"select user_session, {r6('session_value')} as session_value, source from sub",
        "clip_negative": f"""select user_session, {r6('case when session_value < 0 then 0.0 else session_value end')}
            as session_value from sub""",
        "write_submission": f"""select user_session, {r6('case when session_value < 0 then 0.0 else session_value end')}
            as session_value from sub""",
        "coverage_check": """select t.n as n_test_sessions, s.n as n_submission_sessions,
            (select count(*) from (select distinct user_session from clk where split = 'test')
               where user_session not in (select user_session from sub)) as n_missing,
            (select count(*) from (select distinct user_session from sub)
               where user_session not in (select user_session from clk where split = 'test')) as n_extra,
            t.n = s.n as counts_match
            from (select count(distinct user_session) as n from clk where split = 'test') t,
                 (select count(distinct user_session) as n from sub) s""",
        "coverage_ids": """select coalesce(e.user_session, s.user_session) as user_session,
            case when s.user_session is null then 'missing' else 'extra' end as side
            from (select distinct user_session from clk where split = 'test') e
            full outer join (select user_session from tri where session_class = 'model') s on e.user_session = s.user_session
            where e.user_session is null or s.user_session is null""",
        "profile_shapes": """select stage, n_rows, n_cols from (
            select 'events_' || split as stage, count(*) as n_rows, 9 as n_cols from clk group by split
            union all select 'clean_' || split, count(*), 9 from clean group by split
            union all select 'anomalous_test', count(*), 9 from clk where split = 'test'
              and user_session in (select user_session from anom_ids)
            union all select 'model_' || split, count(*), 9 from mev group by split
            union all select 'features_' || split, count(*), 113 from feat group by split)""",
    }


def all_oracle() -> dict[str, str]:
    out = core_oracle()
    m = with_ctes(TRIAGE_SQL, FEATURE_SQL, _model_ctes())
    for k, v in model_oracle().items():
        out[k] = v if v.startswith("with ") else f"{m} {v}"
    return out
