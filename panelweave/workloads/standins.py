"""Panel, retail and meter tables derived from the given star schema and event tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.timegrid import date_parts, iso_weekday
from panelweave.operators.resample import resample_mean
from panelweave.sources.staging import stage
from panelweave.spec import PanelSpec

HOURLY = PanelSpec(step="1 hour")
DAILY = PanelSpec(step="1 day")
METERS = ["view", "signup", "error", "click", "purchase"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sensor readings: id, ts, y."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "ts", F.col("value").alias("y")
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return resample_mean(readings(spark, sf), HOURLY)


def hourly_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly panel with calendar columns."""
    return hourly(spark, sf).withColumns(date_parts(F.col("ts")))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means with a DATE time column; days without an event are absent."""
    return resample_mean(readings(spark, sf), DAILY).withColumn("ts", F.col("ts").cast("date"))


def meters(spark: SparkSession, sf: str) -> DataFrame:
    """Wide 15-minute table with one column per event type."""
    events = table(spark, sf, "events")
    quarter = F.window("ts", "15 minutes")["start"].alias("timestamp")
    return events.groupBy(quarter).pivot("event_type", METERS).agg(F.avg("value"))


def train(spark: SparkSession, sf: str) -> DataFrame:
    """Sales per day, store (nation of the supplier) and item (brand); some brands have returns."""
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    supplier = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("store_nbr")
    )
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), brand_number().alias("item_nbr")
    )
    sales = lines.join(supplier, "l_suppkey").join(part, "l_partkey")
    returned = (
        (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1) & (F.col("item_nbr") <= 5)
    )
    signed = F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    flag = (
        F.when(iso_weekday(F.col("date")) == 3, None)
        .when(F.max(F.col("l_linestatus") == "O"), "True")
        .otherwise("False")
    )
    return (
        sales.withColumn("date", F.col("l_shipdate").cast("date"))
        .groupBy("date", "store_nbr", "item_nbr")
        .agg(F.sum(signed).alias("unit_sales"), flag.alias("onpromotion"))
    )


def brand_number():
    return F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("bigint")


def stores(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("store_nbr"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        (F.col("n_nationkey") % 5).cast("string").alias("type"),
        (F.col("n_nationkey") % 17).alias("cluster"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .groupBy(brand_number().alias("item_nbr"))
        .agg(
            F.min("p_type").alias("family"),
            F.min("p_size").alias("class"),
            (F.max("p_size") % 2).alias("perishable"),
        )
    )


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per store and day: no row on Sundays, no value on Tuesdays."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("date")
    )
    supplier = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("store_nbr")
    )
    day = iso_weekday(F.col("date"))
    return (
        lines.where(day != 7)
        .join(supplier, "l_suppkey")
        .groupBy("store_nbr", "date")
        .agg(F.countDistinct("l_orderkey").alias("n"))
        .select("store_nbr", "date", F.when(day != 2, F.col("n")).alias("transactions"))
    )


def oil(spark: SparkSession, sf: str) -> DataFrame:
    """Order value per working day."""
    day = F.col("o_orderdate").cast("date")
    return (
        table(spark, sf, "orders")
        .where(iso_weekday(day) <= 5)
        .groupBy(day.alias("date"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("dcoilwtico"))
    )


def holidays(spark: SparkSession, sf: str) -> DataFrame:
    """Order days by priority as national, regional and local holidays; on some days keys occur twice."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("date")
    )
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("store_nbr")
    )
    placed = orders.join(customer, "o_custkey").join(
        stores(spark, sf).select("store_nbr", "city", "state"), "store_nbr"
    )
    day, priority = F.dayofmonth("date"), F.col("o_orderpriority")
    twice = F.when(priority == "1-URGENT", day == 1).when(priority == "2-HIGH", day.isin(5, 6)).otherwise(day == 15)
    odd = F.when(twice, (F.col("o_orderkey") % 2).cast("string")).otherwise("0")
    national, regional, local = (priority == p for p in ("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return (
        placed.where(national | regional | local)
        .select(
            "date",
            F.when(national, "National").when(regional, "Regional").otherwise("Local").alias("locale"),
            F.when(national, "Everywhere")
            .when(regional, F.col("state"))
            .otherwise(F.col("city"))
            .alias("locale_name"),
            F.concat(
                F.when(national, "N").when(regional, "R").otherwise("L"), odd
            ).alias("description"),
        )
        .distinct()
    )


def retail_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The retail tables, each derived once and stored, as they would be in a warehouse."""
    makers = {
        "train": train,
        "stores": stores,
        "items": items,
        "transactions": transactions,
        "oil": oil,
        "holidays_events": holidays,
    }
    # independent writes, submitted together so that one's last tasks leave no idle executors
    with ThreadPoolExecutor(len(makers)) as pool:
        jobs = {name: pool.submit(stage, make(spark, sf), name) for name, make in makers.items()}
        return {name: job.result() for name, job in jobs.items()}


def months(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order totals as (Month text, Passengers); two months are missing."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    return (
        table(spark, sf, "orders")
        .groupBy(month.alias("Month"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("Passengers"))
        .where(~F.col("Month").isin("1996-02", "1998-07"))
    )


# The same tables in SQL, for the checks.
SQL = {
    "readings": "select user_id as id, ts, value as y from events",
    "hourly": "select id, date_trunc('hour', ts) as ts, avg(y) as y from readings group by 1, 2",
    "hourly_parts": """
        select id, ts, y, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month,
               cast(day(ts) as integer) as day, cast(isodow(ts) as integer) as day_of_week,
               cast(hour(ts) as integer) as hour
        from hourly""",
    "daily": "select id, cast(ts as date) as ts, avg(y) as y from readings group by 1, 2",
    "meters": "select time_bucket(interval 15 minutes, ts) as \"timestamp\", "
    + ", ".join(f"avg(value) filter (where event_type = '{m}') as \"{m}\"" for m in METERS)
    + " from events group by 1",
    "train": """
        select cast(l_shipdate as date) as date, s_nationkey as store_nbr,
               cast(replace(p_brand, 'Brand#', '') as bigint) as item_nbr,
               sum(case when l_returnflag = 'R' and l_discount >= 0.1
                         and cast(replace(p_brand, 'Brand#', '') as bigint) <= 5
                        then -l_quantity else l_quantity end) as unit_sales,
               case when isodow(cast(l_shipdate as date)) = 3 then null
                    when max(l_linestatus) = 'O' then 'True' else 'False' end as onpromotion
        from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
        group by cast(l_shipdate as date), s_nationkey, 3""",
    "stores": """
        select n_nationkey as store_nbr, n_name as city, r_name as state,
               cast(n_nationkey % 5 as varchar) as type, n_nationkey % 17 as cluster
        from nation join region on n_regionkey = r_regionkey""",
    "items": """
        select cast(replace(p_brand, 'Brand#', '') as bigint) as item_nbr, min(p_type) as family,
               min(p_size) as class, max(p_size) % 2 as perishable
        from part group by 1""",
    "transactions": """
        select s_nationkey as store_nbr, cast(l_shipdate as date) as date,
               case when isodow(cast(l_shipdate as date)) <> 2 then count(distinct l_orderkey) end
                   as transactions
        from lineitem join supplier on l_suppkey = s_suppkey
        where isodow(cast(l_shipdate as date)) <> 7 group by s_nationkey, cast(l_shipdate as date)""",
    "oil": """
        select cast(o_orderdate as date) as date, round(sum(o_totalprice), 2) as dcoilwtico
        from orders where isodow(cast(o_orderdate as date)) <= 5 group by 1""",
    "holidays": """
        select distinct cast(o_orderdate as date) as date,
               case o_orderpriority when '1-URGENT' then 'National' when '2-HIGH' then 'Regional'
                    else 'Local' end as locale,
               case o_orderpriority when '1-URGENT' then 'Everywhere' when '2-HIGH' then state
                    else city end as locale_name,
               case o_orderpriority when '1-URGENT' then 'N' when '2-HIGH' then 'R' else 'L' end
                   || case when (o_orderpriority = '1-URGENT' and day(o_orderdate) = 1)
                             or (o_orderpriority = '2-HIGH' and day(o_orderdate) in (5, 6))
                             or (o_orderpriority = '3-MEDIUM' and day(o_orderdate) = 15)
                           then cast(o_orderkey % 2 as varchar) else '0' end as description
        from orders join customer on o_custkey = c_custkey join stores on c_nationkey = store_nbr
        where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "months": """
        select strftime(o_orderdate, '%Y-%m') as Month, round(sum(o_totalprice), 2) as Passengers
        from orders group by 1 having strftime(o_orderdate, '%Y-%m') not in ('1996-02', '1998-07')""",
}
NEEDS = {
    "hourly": ["readings"],
    "hourly_parts": ["readings", "hourly"],
    "daily": ["readings"],
    "holidays": ["stores"],
}


def with_tables(names: list[str], body: str, **extra: str) -> str:
    """``body`` below a WITH clause that defines the named tables and what they need."""
    order: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    ctes = [f"{n} as ({SQL[n]})" for n in order] + [f"{n} as ({q})" for n, q in extra.items()]
    return f"with {', '.join(ctes)} {body}" if ctes else body
