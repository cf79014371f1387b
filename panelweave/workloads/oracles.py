"""SQL that DuckDB runs on the same tables; one statement per checked query."""

from __future__ import annotations

from panelweave.workloads.standins import METERS, with_tables

ORACLES: dict[str, str] = {}


def check(name: str, tables: list[str], body: str, **extra: str) -> None:
    ORACLES[name] = with_tables(tables, body, **extra)


def r6(*names: str) -> str:
    return ", ".join(f"round(cast({n} as double), 6) as {n}" for n in names)


# ---- sources and sinks -------------------------------------------------------------------------

check(
    "read_csv_dates", ["months"],
    "select cast(Month || '-01' as date) as month_start, Passengers from months",
)
check(
    "read_decimal_comma", ["meters"],
    'select "timestamp", ' + ", ".join(f'round("{m}", 6) as "{m}"' for m in METERS) + " from meters",
)
check("scan_parquet", [], "select event_id, user_id, value from events")
check("write_parquet", [], "select o_orderkey, o_orderstatus, o_totalprice from orders")
check("cached_result", ["daily"], f"select id, ts, {r6('y')} from daily")

PARTS = ["hourly_parts"]
GROUP_SCALER = """
    select id, avg(y) as my, case when stddev_pop(y) = 0 then 1 else stddev_pop(y) end as sy,
           avg(year) as myear,
           case when stddev_pop(year) = 0 then 1 else stddev_pop(year) end as syear
    from hourly_parts group by id"""
GLOBAL_SCALER = GROUP_SCALER.replace("select id, avg", "select avg").replace(" group by id", "")
CODED = """
    dense_rank() over (order by id) - 1 as id_code, dense_rank() over (order by month) - 1 as month_code,
    dense_rank() over (order by day) - 1 as day_code, dense_rank() over (order by hour) - 1 as hour_code,
    dense_rank() over (order by day_of_week) - 1 as dow_code"""
ENCODED_OUT = """
    select cast(id_code as integer) as id, ts, {year} as year, cast(month_code as integer) as month,
           cast(day_code as integer) as day, cast(dow_code as integer) as day_of_week,
           cast(hour_code as integer) as hour, {y} as y from coded"""
check(
    "preprocessor_state", PARTS,
    ENCODED_OUT.format(year="round(zyear, 6)", y="round(zy, 6)"),
    scaler=GROUP_SCALER,
    coded=f"""
        select p.id, ts, (year - myear) / syear as zyear, (y - my) / sy as zy, {CODED.replace('by id)', 'by p.id)')}
        from hourly_parts p join scaler s on p.id = s.id""",
)
check(
    "electricity_transform", PARTS,
    ENCODED_OUT.format(year="round(zyear, 6)", y="round(zy, 6)"),
    scaler=GLOBAL_SCALER,
    coded=f"""
        select id, ts, (year - myear) / syear as zyear, (y - my) / sy as zy, {CODED}
        from hourly_parts, scaler""",
)

# ---- projections and columns -------------------------------------------------------------------

check("select_order", PARTS, f"select id, ts, year, month, day, hour, {r6('y')} from hourly_parts")
check("rename", [], "select event_id, user_id as id, ts, value as y from events")
check("drop", [], "select event_id, ts, user_id, value from events")
check(
    "literal_column", [],
    "select o_orderkey, cast(0 as integer) as id, cast(1 as tinyint) as open, 'training' as split from orders",
)
check(
    "downcast", ["train"],
    """select date, cast(store_nbr as smallint) as store_nbr, item_nbr,
              cast(unit_sales as float) as unit_sales from train""",
)
check("text_flag", ["train"],
      "select date, store_nbr, item_nbr, onpromotion = 'True' as onpromotion from train")
TRAJ = "cast(store_nbr as varchar) || '_' || cast(item_nbr as varchar)"
check("composite_key", ["train"], f"select date, {TRAJ} as traj_id from train")
check("fill_null_const", ["train"],
      "select date, store_nbr, item_nbr, coalesce(onpromotion, '') as onpromotion from train")
check(
    "feature_vector", [],
    """select l_orderkey, l_linenumber, l_quantity as v0, l_discount as v1, l_tax as v2
       from lineitem""",
)
check(
    "scalar_functions", [],
    """
    select o_orderkey, cast(year(o_orderdate) as integer) as year,
           cast(month(o_orderdate) as integer) as month, cast(day(o_orderdate) as integer) as day,
           cast(hour(o_orderdate) as integer) as hour,
           cast(isodow(o_orderdate) as integer) as weekday, last_day(o_orderdate) as month_end,
           cast(date_trunc('month', o_orderdate) as date) as month_start,
           round(ln(o_totalprice), 6) as log_price, replace(o_orderpriority, '-', '.') as replaced,
           cast(o_custkey as varchar) || '_' || o_orderstatus as key,
           cast(trunc(o_totalprice) as integer) as whole, o_totalprice >= 100000 as large,
           cast(month(o_orderdate) - 1 as integer) as month_index,
           cast(month(o_orderdate) as integer) as month_again,
           greatest(o_totalprice - cast(100000 as double), cast(0 as double)) as excess,
           round(1 / (1 + exp(o_totalprice / 100000)), 6) as softmax_low,
           round(1 / (1 + exp(-o_totalprice / 100000)), 6) as softmax_mid
    from orders""",
)

# ---- filters -----------------------------------------------------------------------------------

check(
    "date_range_filter", [],
    """select l_orderkey, l_linenumber, l_shipdate from lineitem
       where l_shipdate between timestamp '1996-01-01' and timestamp '1996-06-30'""",
)
check("locale_filter", ["holidays"],
      "select date, lower(locale) as level, description as name from holidays")
check("not_null_filter", ["transactions"], "select * from transactions where transactions is not null")
check("year_filter", [], "select o_orderkey, o_orderdate from orders where year(o_orderdate) >= 1998")

SALES = f"select {TRAJ} as traj_id, * from train"
NAMELESS = f"select nullif({TRAJ}, '3_2') as traj_id, * from train"
KEPT = "select *, min(unit_sales) over (partition by traj_id) as lowest from sales"
check("drop_negative_groups", ["train"],
      "select traj_id, date, unit_sales from kept where lowest >= 0", sales=NAMELESS, kept=KEPT)
check(
    "partition_min", ["train"],
    f"""select {TRAJ} as traj_id, date, unit_sales,
               min(unit_sales) over (partition by {TRAJ}) as lowest from train""",
)

# ---- joins -------------------------------------------------------------------------------------

check(
    "left_join_series", ["train", "oil"],
    f"""select date, store_nbr, item_nbr, unit_sales, {r6('dcoilwtico')}
        from train left join oil using (date)""",
)
check(
    "inner_join_dims", ["train", "stores", "items"],
    """select date, store_nbr, item_nbr, unit_sales, city, state, family, class
       from train join stores using (store_nbr) join items using (item_nbr)""",
)
check(
    "inner_join_composite", ["train", "transactions"],
    """select date, store_nbr, item_nbr, unit_sales, transactions
       from train join transactions using (store_nbr, date)""",
)
NATIONAL = "select date, description as national_hol from holidays where locale = 'National'"
REGIONAL = """select date, locale_name as state, description as regional_hol from holidays
              where locale = 'Regional'"""
LOCAL = """select date, locale_name as city, description as local_hol from holidays
           where locale = 'Local'"""
HOLIDAYS = {"national": NATIONAL, "regional": REGIONAL, "local_": LOCAL}
HOLIDAY_JOINS = """left join national using (date) left join regional using (date, state)
    left join local_ using (date, city)"""
HOLIDAY_COLUMNS = """coalesce(national_hol, '') as national_hol,
    coalesce(regional_hol, '') as regional_hol, coalesce(local_hol, '') as local_hol"""
check(
    "holiday_join", ["stores", "transactions", "holidays"],
    f"""select date, store_nbr, transactions, {HOLIDAY_COLUMNS}
        from transactions join stores using (store_nbr) {HOLIDAY_JOINS}""",
    **HOLIDAYS,
)

# Trajectories: gap-free days between first and last sale, then fills per trajectory.
PREP = {
    "sales": f"""
        select {TRAJ} as traj_id, date, cast(store_nbr as smallint) as store_nbr, item_nbr,
               cast(unit_sales as float) as unit_sales,
               cast(onpromotion = 'True' as smallint) as onpromotion from train""",
    "kept": """
        select * exclude (lowest) from
            (select *, min(unit_sales) over (partition by traj_id) as lowest from sales)
        where lowest >= 0""",
    "days": """
        select traj_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
        from kept group by traj_id""",
    "panel": """
        select traj_id, date,
               last_value(store_nbr ignore nulls) over w as store_nbr,
               last_value(item_nbr ignore nulls) over w as item_nbr,
               last_value(onpromotion ignore nulls) over w as onpromotion,
               last_value(case when unit_sales > 0 then ln(cast(unit_sales as double)) end
                          ignore nulls) over w as log_sales,
               cast(case when k.unit_sales is null then 0 else 1 end as tinyint) as open
        from days left join kept k using (traj_id, date)
        window w as (partition by traj_id order by date
                     rows between unbounded preceding and current row)""",
}
check(
    "trajectory_prep", ["train"],
    f"""select traj_id, date, store_nbr, item_nbr, onpromotion, {r6('log_sales')}, open from panel""",
    **PREP,
)
STAR = {
    **PREP,
    "oiled": """
        select panel.*, last_value(cast(dcoilwtico as float) ignore nulls) over
                   (partition by traj_id order by date rows between unbounded preceding and current row)
                   as oil_price
        from panel left join oil using (date)""",
    "busy": """
        select o.*, s.* exclude (store_nbr), i.* exclude (item_nbr),
               last_value(cast(transactions as integer) ignore nulls) over
                   (partition by traj_id order by o.date
                    rows between unbounded preceding and current row) as transactions
        from oiled o join stores s using (store_nbr) join items i using (item_nbr)
             join transactions t on t.store_nbr = o.store_nbr and t.date = o.date""",
    **HOLIDAYS,
    "star": f"""
        select traj_id, date, store_nbr, item_nbr, onpromotion, log_sales, open, oil_price,
               city, state, type, cast(cluster as smallint) as cluster, family, class,
               cast(perishable as smallint) as perishable, transactions, {HOLIDAY_COLUMNS},
               cast(year(date) as integer) as year, cast(month(date) as integer) as month,
               cast(day(date) as integer) as day_of_month,
               cast(isodow(date) as integer) as day_of_week
        from busy {HOLIDAY_JOINS} where oil_price is not null""",
}
STAR_TABLES = ["train", "stores", "items", "transactions", "oil", "holidays"]
check(
    "star_assembly", STAR_TABLES,
    """select * replace (round(log_sales, 6) as log_sales,
                         round(cast(oil_price as double), 0) as oil_price) from star""",
    **STAR,
)
check(
    "retail_transform", STAR_TABLES,
    """
    select traj_id, date, round((log_sales - ml) / sl, 4) as log_sales,
           round((transactions - mt) / st, 4) as transactions,
           cast(dense_rank() over (order by item_nbr) - 1 as integer) as item_nbr,
           cast(dense_rank() over (order by store_nbr) - 1 as integer) as store_nbr,
           cast(dense_rank() over (order by national_hol) - 1 as integer) as national_hol,
           cast(dense_rank() over (order by regional_hol) - 1 as integer) as regional_hol,
           cast(dense_rank() over (order by local_hol) - 1 as integer) as local_hol,
           cast(dense_rank() over (order by coalesce(onpromotion, 0)) - 1 as integer) as onpromotion,
           cast(dense_rank() over (order by open) - 1 as integer) as open, city, family,
           cast(dense_rank() over (order by state) - 1 as integer) as state,
           cast(dense_rank() over (order by type) - 1 as integer) as type,
           cast(dense_rank() over (order by cluster) - 1 as integer) as cluster,
           cast(dense_rank() over (order by class) - 1 as integer) as class,
           cast(dense_rank() over (order by perishable) - 1 as integer) as perishable,
           cast(dense_rank() over (order by month) - 1 as integer) as month,
           cast(dense_rank() over (order by day_of_month) - 1 as integer) as day_of_month,
           cast(dense_rank() over (order by day_of_week) - 1 as integer) as day_of_week,
           round((year - my) / sy, 4) as year, round((oil_price - mo) / so, 4) as oil_price
    from star, scaler""",
    **STAR,
    scaler="""select avg(log_sales) as ml, stddev_pop(log_sales) as sl, avg(transactions) as mt,
                     stddev_pop(transactions) as st, avg(year) as my, stddev_pop(year) as sy,
                     avg(cast(oil_price as double)) as mo, stddev_pop(cast(oil_price as double)) as so from star""",
)
check(
    "cold_start_filter", ["daily"],
    f"""select id, ts, {r6('y')} from daily where ts >= date '2024-01-02'
        and id in (select id from daily where ts < date '2024-01-02')""",
)
check(
    "actual_vs_forecast", ["daily"],
    f"""select a.id, a.ts, round(a.y, 6) as y, round(p.y, 6) as yhat
        from daily a left join daily p on a.id = p.id and a.ts = p.ts + 1""",
)

# ---- aggregations ------------------------------------------------------------------------------

check("resample_mean", ["hourly"], f"select id, ts, {r6('y')} from hourly")
SIMPLE_SCALER = """select id, avg(y) as m, case when stddev_pop(y) = 0 then 1 else stddev_pop(y) end as s
                   from {t} group by id"""
check(
    "group_apply", ["hourly"],
    "select h.id, ts, round((y - m) / s, 6) as z from hourly h join scaler c on h.id = c.id",
    scaler=SIMPLE_SCALER.format(t="hourly"),
)
check(
    "fit_scaler", PARTS,
    """
    select cast(id as varchar) as scope_key, 'y' as "column", round(my + cast(1e-9 as double), 6) as mean, round(sy + cast(1e-9 as double), 6) as scale from g
    union all select cast(id as varchar), 'year', round(myear + cast(1e-9 as double), 6), round(syear + cast(1e-9 as double), 6) from g
    union all select '*', 'y', round(my + cast(1e-9 as double), 6), round(sy + cast(1e-9 as double), 6) from o
    union all select '*', 'year', round(myear + cast(1e-9 as double), 6), round(syear + cast(1e-9 as double), 6) from o""",
    g=GROUP_SCALER, o=GLOBAL_SCALER,
)
VOCAB = """select '{c}' as "column", cast({c} as varchar) as value,
           cast(row_number() over (order by {c}) - 1 as integer) as code
           from (select distinct {c} from {t})"""
check(
    "fit_vocabulary", PARTS,
    " union all ".join(
        [VOCAB.format(c=c, t="hourly_parts") for c in ("id", "month", "day", "hour", "day_of_week")]
        + [VOCAB.format(c=c, t="part") for c in ("p_type", "p_brand", "p_name")]
    ),
)
check("distinct_ids", [], "select distinct user_id from events")
check(
    "null_count", ["meters"],
    'select count(*) - count("timestamp") as "timestamp", '
    + ", ".join(f'count(*) - count("{m}") as "{m}"' for m in METERS) + " from meters",
)
DESCRIBE = """select '{c}' as "column", count({c}) as count, count(*) - count({c}) as null_count,
              round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
              round(min({c}), 6) as min, round(max({c}), 6) as max from lineitem"""
check("describe", [],
      " union all ".join(DESCRIBE.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
check(
    "describe_time", [],
    """select count(ts) as count, count(*) - count(ts) as null_count, min(ts) as min, max(ts) as max,
              timestamp '1970-01-01' + to_seconds(floor(avg(floor(epoch(ts))))::bigint) as mean from events""",
)
check(
    "resample_monthly", [],
    " union all ".join(
        f"""select '{step}' as step, o_orderpriority as id, date_trunc('{step}', o_orderdate)::date as ts, round(avg(o_totalprice), 4) as y
            from orders group by all"""
        for step in ("month", "quarter")
    ),
)
LABEL = "case when ts < timestamp '2024-01-24' then 'training' else 'validation' end as split"
check("row_count", ["readings"], f"select {LABEL}, count(*) as rows from readings group by 1")
check("batch_mean", [],
      "select l_linenumber as epoch, round(avg(l_extendedprice), 4) as loss from lineitem group by 1")

# ---- ordered operators -------------------------------------------------------------------------

LONG = " union all ".join(f"""select '{m}' as id, "timestamp", "{m}" as y from meters""" for m in METERS)
check(
    "forward_fill", ["meters"],
    """select nullif(id, 'click') as id, "timestamp" as ts, round(last_value(y ignore nulls) over
           (partition by id order by "timestamp" rows between unbounded preceding and current row), 6) as y
       from long""",
    long=LONG,
)
WINDOWS = """
    select w.id, w.ts as window_ts, w.pos = 0 as is_first, cast(s.pos - w.pos as integer) as step,
           s.ts, s.y
    from numbered w join numbered s on w.id = s.id and s.pos between w.pos and w.pos + {t} - 1
    where w.pos + {t} <= w.n"""
NUMBERED = """select id, ts, y, row_number() over (partition by id order by ts) - 1 as pos,
                     count(*) over (partition by id) as n from {t}"""
check(
    "sliding_windows", [],
    "select * replace (round(y, 6) as y) from (" + WINDOWS.format(t=12) + ")",
    days="select cast(0 as integer) as id, cast(o_orderdate as date) as ts, round(sum(o_totalprice), 2) as y from orders group by 2",
    numbered=NUMBERED.format(t="days"),
)
check(
    "panel_windows", ["daily"],
    "select * replace (nullif(id, 7) as id, round(y, 6) as y) from (" + WINDOWS.format(t=7) + ")",
    numbered=NUMBERED.format(t="daily"),
)
DENSE = {
    "calendar": """select id, cast(unnest(generate_series(min(ts), max(ts), interval 1 day)) as date) as ts
                   from daily group by id""",
    "dense": """select id, ts, last_value(y ignore nulls) over (partition by id order by ts
                    rows between unbounded preceding and current row) as y
                from calendar left join daily using (id, ts)""",
}
DENSE_NUMBERED = {**DENSE, "numbered": NUMBERED.format(t="dense")}
check(
    "encoder_decoder_split", ["daily"],
    """select id, window_ts, step, cast(id as double) as x_id,
              cast(isodow(ts) as double) as x_weekday,
              case when step >= 5 then round(y, 6) end as y from w""",
    **DENSE_NUMBERED, w=WINDOWS.format(t=7),
)
check(
    "flatten_windows", ["daily"],
    f"select id, ts, {r6('y')} from numbered where n >= 7",
    **DENSE_NUMBERED,
)

# ---- gap filling -------------------------------------------------------------------------------

check(
    "upsample_daily", ["train"],
    """select traj_id, date, last_value(store_nbr ignore nulls) over (partition by traj_id order by date
                  rows between unbounded preceding and current row) as store_nbr,
              unit_sales, unit_sales is null as made
       from days left join sales using (traj_id, date)""",
    sales=SALES,
    days="""select traj_id, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
            from sales group by traj_id""",
)
MONTH_PANEL = {
    "ends": """select last_day(cast(Month || '-01' as date)) as ts, Passengers as y from months""",
    "grid": """select last_day(cast(unnest(generate_series(date_trunc('month', min(ts)),
                   date_trunc('month', max(ts)), interval 1 month)) as date)) as ts from ends""",
    "month_panel": """select cast(0 as integer) as id, ts, y, cast(month(ts) as integer) as month,
                          cast(year(ts) as integer) as year from grid left join ends using (ts)""",
}
check("upsample_monthly", ["months"], "select * from month_panel", **MONTH_PANEL)
check(
    "column_transformer", ["months"],
    """select id, ts, round((year - myr) / syr, 6) as year, month - 1 as month,
              round((y - my) / sy, 6) as y from month_panel, scaler""",
    **MONTH_PANEL,
    scaler="""select avg(year) as myr, stddev_pop(year) as syr, avg(y) as my, stddev_pop(y) as sy
              from month_panel""",
)

# ---- ordering and batching ---------------------------------------------------------------------

check("sort_panel", ["hourly"], f"select id, ts, {r6('y')} from hourly order by id, ts")
check("head", ["hourly"], f"select id, ts, {r6('y')} from hourly order by id, ts limit 10")
check("shuffle_rows", ["hourly"], f"select id, ts, {r6('y')} from hourly")
check(
    "assign_batches", ["hourly"],
    "select id, ts, cast((row_number() over (order by place, id, ts) - 1) // 64 as bigint) as batch from placed",
    placed="""select id, ts, ('0x' || substr(md5(coalesce(id::varchar, chr(0)) || chr(31) || ts::varchar || chr(31) || '69'), 1, 15))::bigint as place
              from hourly""",
)

# ---- reshaping and splits ----------------------------------------------------------------------

check("union_all", ["readings"], f"select id, ts, y, {LABEL} from readings")
check("wide_to_long", ["meters"],
      f"""select id, "timestamp", {r6('y')} from long""", long=LONG)
check(
    "hourly_panel", ["meters"],
    """select id, ts, cast(year(ts) as integer) as year, cast(month(ts) as smallint) as month,
              cast(day(ts) as smallint) as day, cast(isodow(ts) as smallint) as day_of_week,
              cast(hour(ts) as smallint) as hour,
              round(cast(cast(y as float) as double), 3) as y
       from (select id, date_trunc('hour', "timestamp") as ts, avg(y) as y from long group by 1, 2)""",
    long=LONG,
)
check(
    "split_two", [],
    """select event_id, ts, case when ts < timestamp '2024-01-24' then 'train' else 'test' end as part
       from events""",
)
check(
    "split_three", ["readings"],
    """
    select case when ts < timestamp '2024-01-05' then 'train' when ts < timestamp '2024-01-20'
                then 'validation' else 'test' end as part, id, ts, kind
    from kinds where ts < timestamp '2024-01-05'
        or kind in (select kind from kinds where ts < timestamp '2024-01-05')""",
    kinds="select id, ts, cast(floor(y) as bigint) as kind from readings",
)
check("split_label", ["readings"], f"select id, ts, y, {LABEL} from readings")
check("split_series", ["daily"], f"select id, ts, {r6('y')}, {LABEL} from daily")

# ---- preprocessing -----------------------------------------------------------------------------

check(
    "scale_by_group", PARTS,
    """select p.id, ts, round((year - myear) / syear, 6) as year, round((y - my) / sy, 6) as y
       from hourly_parts p join scaler s on p.id = s.id""",
    scaler=GROUP_SCALER,
)
check(
    "scale_global", PARTS,
    """select id, ts, round((year - myear) / syear, 6) as year, round((y - my) / sy, 6) as y
       from hourly_parts, scaler""",
    scaler=GLOBAL_SCALER,
)
check(
    "encode_labels", [],
    """select p_partkey, cast(dense_rank() over (order by p_brand) - 1 as integer) as p_brand,
              cast(dense_rank() over (order by p_type) - 1 as integer) as p_type,
              cast(dense_rank() over (order by p_size) - 1 as integer) as p_size from part""",
)
check(
    "inverse_scale", PARTS,
    "select p.id, ts, round(y, 6) as y, round(y + sy, 6) as yhat from hourly_parts p join scaler s on p.id = s.id",
    scaler=GROUP_SCALER,
)
check("inverse_labels", [], "select p_partkey, p_brand, p_size from part")
check(
    "month_normalizer", [],
    """select o_orderkey, cast(month(o_orderdate) - 1 as integer) as month_index,
              cast(month(o_orderdate) as integer) as month from orders""",
)
FITTED_ROWS = "hourly_parts where ts < timestamp '2024-01-10' and id % 4 <> 0"
check(
    "is_fitted", PARTS,
    " union all ".join(
        [
            f"""select 'scaler' as kind, '{c}' as "column", id::varchar as key, count(*) as rows from hourly_parts
                where id not in (select id from {FITTED_ROWS}) group by id"""
            for c in ("year", "y")
        ]
        + [
            f"""select 'vocabulary' as kind, '{c}' as "column", {c}::varchar as key, count(*) as rows from hourly_parts
                where {c} not in (select {c} from {FITTED_ROWS}) group by {c}"""
            for c in ("id", "month", "day", "hour", "day_of_week")
        ]
    ),
)

# ---- forecasts and scores ----------------------------------------------------------------------

# Persistence forecasts: the encoder's last value for the two steps that follow it.
PERSIST = {
    **DENSE_NUMBERED,
    "fc": """
        select w.id, w.ts as window_ts, w.pos = 0 as is_first, cast(s.pos - w.pos - 5 as integer) as step,
               s.ts, s.y, e.y as yhat, e.y - 1 as yhat_low, e.y + 1 as yhat_up
        from numbered w join numbered e on w.id = e.id and e.pos = w.pos + 4
             join numbered s on w.id = s.id and s.pos between w.pos + 5 and w.pos + 6
        where w.pos + 7 <= w.n""",
}


def pin(tau: float, yhat: str) -> str:
    return f"({tau} * greatest(y - {yhat}, 0) + (1 - {tau}) * greatest({yhat} - y, 0))"


BAND_LOSS = f"({pin(0.1, 'yhat_low')} + {pin(0.5, 'yhat')} + {pin(0.9, 'yhat_up')}) / 3"
for key in ("pinball_loss", "pinball_loss_arrays"):
    check(
        key, ["daily"],
        f"select id, window_ts, round(avg({pin(0.9, 'yhat')}), 8) as loss from fc group by 1, 2",
        **PERSIST,
    )
check(
    "quantile_pinball_loss", ["daily"],
    f"select id, window_ts, round(avg({BAND_LOSS}), 8) as loss from fc group by 1, 2", **PERSIST,
)
check(
    "evaluate_forecast", ["daily"],
    f"select id, step, round(avg({BAND_LOSS}), 8) as loss, count(*) as windows from fc group by 1, 2",
    **PERSIST,
)
SCALED = {
    **DENSE,
    "scaler": SIMPLE_SCALER.format(t="dense"),
    "scaled": "select d.id, ts, (y - m) / s as y from dense d join scaler c on d.id = c.id",
    "numbered": NUMBERED.format(t="scaled"),
}
BASELINE = {
    **SCALED,
    "w": WINDOWS.format(t=7),
    "baseline": """
        select cast(step - 4 as integer) as step, quantile, value from (
            select step, unnest([0.1, 0.5, 0.9]) as quantile,
                   unnest(quantile_cont(y, [0.1, 0.5, 0.9])) as value
            from w where step >= 5 group by step)""",
}
check(
    "quantile_baseline", ["daily"],
    "select step, cast(quantile as double) as quantile, round(value, 6) as value from baseline",
    **BASELINE,
)
check(
    "predict_quantiles", ["daily"],
    """
    select s.id, s.window_ts, b.step, s.ts, round(s.y, 6) as y,
           round(lo + push, 6) as yhat_low, round(mid + push, 6) as yhat, round(hi + push, 6) as yhat_up
    from (select w.id, w.window_ts, w.step - 4 as step, w.ts, w.y,
                 0.5 * e.y + case when isodow(w.ts) = 3 then 0.25 else 0 end as push
          from w join w e on w.id = e.id and w.window_ts = e.window_ts and e.step = 4
          where w.step >= 5) s
    join (select step, max(value) filter (where quantile = 0.1) as lo,
                 max(value) filter (where quantile = 0.5) as mid,
                 max(value) filter (where quantile = 0.9) as hi from baseline group by step) b
      on s.step = b.step""",
    **BASELINE,
)
# Two steps of the full subgradient on inputs and targets in units of 2^-24, in whole numbers; the weights are doubles.
UNIT = "16777216.0::double"


def unit(x: str) -> str:
    return f"floor(({x}) * {UNIT} + 0.5::double)::bigint"


TAUS = "(values (0.1::double), (0.5::double), (0.9::double)) u(tau)"
TRAINED = {
    **SCALED,
    "w": WINDOWS.format(t=7),
    "codes": "select id, dense_rank() over (order by id) - 1 as code, dense_rank() over (order by id % 5) - 1 as cohort from (select distinct id from dense)",
    "sizes": "select count(*) as n, count(distinct cohort) as m from codes",
    "rows": f"""select id, window_ts, step - 4 as step, ts, {unit("y")} as y, isodow(ts) as weekday, window_ts >= date '2024-01-20' as held
                from w where step >= 5""",
    "encoder": "select id, window_ts, max(y) filter (step = 4) as last, sum(y) / 5 as mean from w where step < 5 group by 1, 2",
    "pairs": """
        select id, window_ts, step, unnest([0, 1 + code, 1 + n + cohort, 1 + n + m + weekday, 9 + n + m, 10 + n + m]) as position,
               unnest([16777216, 16777216, 16777216, 16777216, """ + unit("last") + ", " + unit("mean") + """]) as v
        from rows join encoder using (id, window_ts) join codes using (id) cross join sizes""",
    "w0": f"""select step, 0 as position, tau, {unit("value")} / {UNIT} as weight, 1e-12::double as seen from (
                 select step, unnest([0.1::double, 0.5::double, 0.9::double]) as tau, unnest(quantile_cont(y / {UNIT}, [0.1, 0.5, 0.9])) as value
                 from rows where not held group by step)""",
}
for k in range(3):
    TRAINED[f"e{k}"] = f"""
        select id, window_ts, step, tau, held, any_value(r.y) - sum(floor(coalesce(weight, 0) * v + 0.5::double)::bigint) as e
        from rows r join pairs using (id, window_ts, step) cross join {TAUS} left join w{k} using (step, position, tau) group by all"""
    TRAINED[f"g{k}"] = f"""
        select step, position, tau, (sum(case when e < 0 then v else 0 end)::double - tau * sum(v)::double)
               / ({UNIT} * (select count(*) from rows where not held and step = 1)) as g
        from e{k} join pairs using (id, window_ts, step) where not held group by step, position, tau"""
    TRAINED[f"w{k + 1}"] = f"""
        select step, position, tau, coalesce(weight, 0) - 0.02::double * g / sqrt(coalesce(seen, 1e-12::double) + g * g) as weight,
               coalesce(seen, 1e-12::double) + g * g as seen from g{k} left join w{k} using (step, position, tau)"""
TRAINED["losses"] = " union all ".join(
    f"""select {k} as epoch, avg(loss) filter (not held) as train_loss, avg(loss) filter (held) as held_out_loss
        from (select held, (tau * e + greatest(-e, 0)) / {UNIT} as loss from e{k})"""
    for k in range(3)
)
TRAINED["best"] = " union all ".join(
    f"select step, position, tau, weight from w{k} where {k} = (select arg_min(epoch, train_loss) from losses)" for k in range(3)
)
check(
    "fit_quantile_model", ["daily"],
    """select step::int as step, tau as quantile, position::int as position, case when position = 0 then 'bias'
              when position <= n then 'entity=' || (position - 1) when position <= n + m then 'cohort=' || (position - 1 - n)
              when position <= n + m + 8 then 'weekday=' || (position - 1 - n - m)
              when position = n + m + 9 then 'y_last' else 'y_mean' end as feature, round(weight, 6) as weight from best, sizes""",
    **TRAINED,
)
check("fit_history", ["daily"], f"select epoch, {r6('train_loss', 'held_out_loss')} from losses", **TRAINED)
AHEAD = {
    **TRAINED,
    "ends": """select id, max(ts) as last_ts, max_by(y, ts) as last, sum(y) filter (back < 5) / 5 as mean
               from (select *, row_number() over (partition by id order by ts desc) - 1 as back from scaled) group by id having count(*) >= 5""",
    "ahead": """select id, step, last_ts + step::int as ts, last, mean from ends, (values (1), (2)) s(step)""",
    "reach": """select id, step, ts, unnest([0, 1 + code, 1 + n + cohort, 1 + n + m + isodow(ts), 9 + n + m, 10 + n + m]) as position,
                       unnest([1, 1, 1, 1, last, mean]) as v from ahead join codes using (id) cross join sizes""",
    "told": "select id, step, ts, tau, sum(v * coalesce(weight, 0)) as yhat from reach join best using (step, position) group by all",
}
check(
    "forecast_flow", ["daily"],
    """select id, step::int as step, ts::date as ts, round(max(yhat * s + m) filter (tau = 0.1), 6) as yhat_low,
              round(max(yhat * s + m) filter (tau = 0.5), 6) as yhat, round(max(yhat * s + m) filter (tau = 0.9), 6) as yhat_up
       from told join scaler using (id) group by id, step, ts""",
    **AHEAD,
)
check(
    "static_importance", ["daily"],
    """select id, window_ts, unnest(['bias', 'entity', 'cohort', 'y_last', 'y_mean']) as feature,
              unnest([round(x / (a + b + c + d + e), 6) for x in [a, b, c, d, e]]) as weight
       from (select id, window_ts, exp(avg(a)) as a, exp(avg(b)) as b, exp(avg(c)) as c, exp(avg(d)) as d, exp(avg(e)) as e from parts group by 1, 2)""",
    **TRAINED,
    inputs="""select r.id, window_ts, step, [1, 1, 1, last, mean] as v, [0, 1 + code, 1 + n + cohort, 9 + n + m, 10 + n + m] as p
              from rows r join encoder using (id, window_ts) join codes using (id) cross join sizes""",
    used="select id, window_ts, inputs.step, i, abs(v[i] * coalesce(weight, 0)) as x from inputs cross join range(1, 6) t(i) left join best b on b.step = inputs.step and b.position = p[i] and tau = 0.5",
    parts="""select id, window_ts, step, max(x) filter (i = 1) as a, max(x) filter (i = 2) as b, max(x) filter (i = 3) as c,
                    max(x) filter (i = 4) as d, max(x) filter (i = 5) as e from used group by 1, 2, 3""",
)
# Inputs of the stated model whose weight is zero.
REST_OF_MODEL = ", ".join(
    f"round(avg(1 / t), 6) as {n}_importance" for n in ("id_code", "y_mean", *(f"weekday_{i}" for i in range(8) if i != 3))
)
check(
    "model_importance", ["daily"],
    f"""
    select ts, round(avg(exp(a) / t), 6) as bias_importance, round(avg(exp(b) / t), 6) as y_last_importance,
           round(avg(exp(c) / t), 6) as weekday_3_importance, {REST_OF_MODEL}
    from (select *, exp(a) + exp(b) + exp(c) + 9 as t from (select w.ts, abs(m.value) as a, abs(0.5 * e.y) as b,
                 case when isodow(w.ts) = 3 then 0.25 else 0 end as c
          from w join w e on w.id = e.id and w.window_ts = e.window_ts and e.step = 4
               join baseline m on m.step = w.step - 4 and m.quantile = 0.5
          where w.step >= 5)) group by ts""",
    **BASELINE,
)
TWO = {
    **SCALED,
    "w": WINDOWS.format(t=7),
    "twofold": "select id, window_ts, step, ts, unnest(['y', 'z']) as output, unnest([y, y * y]) as y from w",
    "enc": "select id, window_ts, max(y) filter (step = 4) as last, sum(y * y) / 5 as mean from w where step < 5 group by 1, 2",
    "aims": "select output, step, quantile_cont(y, [0.1, 0.5, 0.9]) as q from twofold where step >= 5 group by 1, 2",
    "told": """
        select b.id, b.window_ts, b.output, cast(b.step - 4 as integer) as step, ts, y, q[1] + push as yhat_low, q[2] + push as yhat, q[3] + push as yhat_up
        from (select *, 0.5 * last - 0.25 * mean + case when isodow(ts) = 3 then 0.125 else 0 end as push
              from twofold join enc using (id, window_ts) where step >= 5) b join aims using (output, step)""",
}
check(
    "predict_two_targets", ["daily"],
    f"select id, window_ts, output, step, ts, {r6('y', 'yhat_low', 'yhat', 'yhat_up')} from told",
    **TWO,
)
check(
    "two_target_loss", ["daily"],
    f"select id, window_ts, round(2 * avg({BAND_LOSS}), 6) as loss from told group by 1, 2",
    **TWO,
)
check(
    "predict_external_model", ["daily"],
    """select id, window_ts, round(avg(y) - 1, 6) as yhat_low, round(avg(y), 6) as yhat,
              round(avg(y) + 1, 6) as yhat_up from w where step < 5 group by 1, 2""",
    **DENSE_NUMBERED, w=WINDOWS.format(t=7),
)
# The forecast of a time comes from the first window for its first step, else from the window
# that ends there: the value one or two rows back.
FLAT = """
    select id, ts, y, case when n < 7 or pos < 5 then null
                           when pos = 5 then lag(y, 1) over (partition by id order by ts)
                           else lag(y, 2) over (partition by id order by ts) end as back
    from numbered"""
check(
    "band_series", ["daily"],
    """select id, ts, round(y, 6) as y, round(back, 6) as yhat, round(back - 1, 6) as yhat_low,
              round(back + 1, 6) as yhat_up from flat""",
    **DENSE_NUMBERED, flat=FLAT,
)
check(
    "forecast_to_series", ["daily"],
    """select f.id, ts, round(y * s + m, 6) as y, round((back - 1) * s + m, 6) as yhat_low,
              round(back * s + m, 6) as yhat, round((back + 1) * s + m, 6) as yhat_up
       from flat f join scaler c on f.id = c.id""",
    **SCALED, flat=FLAT,
)
IMPORTANCE = {
    **DENSE_NUMBERED,
    "w": WINDOWS.format(t=7),
    "x": """select id, window_ts, step, ts, case when step < 5 then 'historical' else 'future' end as part,
                   exp(day(ts) * 0.1) as d, exp(isodow(ts) * 0.3) as k, exp(abs(y * 0.02)) as v from w""",
}
check(
    "feature_importance", ["daily"],
    " union all ".join(
        f"select id, window_ts, step, '{n}' as feature, round({c} / (d + k + v), 6) as weight from x"
        for n, c in (("day", "d"), ("weekday", "k"), ("value", "v"))
    ),
    **IMPORTANCE,
)
check(
    "importance_table", ["daily"],
    """select part, ts, round(avg(d / (d + k + v)), 6) as day_importance,
              round(avg(k / (d + k + v)), 6) as weekday_importance,
              round(avg(v / (d + k + v)), 6) as value_importance from x group by 1, 2""",
    **IMPORTANCE,
)
check(
    "window_flow", ["hourly"],
    """
    select id, count(*) as windows, round(sum((y - m) / s), 4) as last_sum, split from (
        select p.*, row_number() over (partition by id, split order by ts) as pos from panel p) q
    join scaler c using (id) where pos >= 24 group by id, split""",
    calendar="select id, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from hourly group by id",
    panel=f"""select id, ts, {LABEL}, last_value(y ignore nulls) over (partition by id order by ts
                  rows between unbounded preceding and current row) as y
              from calendar left join hourly using (id, ts)""",
    scaler=SIMPLE_SCALER.format(t="panel where split = 'training'"),
)
check(
    "resample_stream", ["hourly"],
    f"""select id, ts, {r6('y')} from hourly
        where ts + interval 1 hour <= (select max(ts) - interval 1 hour from events)""",
)
check("resample_stream_restarted", ["hourly"], f"""select id, ts, {r6('y')} from hourly
        where ts + interval 1 hour <= (select max(ts) - interval 1 hour from events)""")
