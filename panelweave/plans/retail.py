"""Retail flow: sales of store-item trajectories with oil, store, item, traffic and holidays."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.columns import composite_key, downcast, log_target, text_flag
from panelweave.functions.timegrid import iso_weekday
from panelweave.operators.joins import (
    attach_filled_series,
    holiday_join,
    inner_join_dims,
)
from panelweave.operators.series import fill_gaps
from panelweave.operators.splits import between
from panelweave.spec import PanelSpec

TRAJECTORY = PanelSpec(id="traj_id", ts="date", target="log_sales", step="1 day")


def trajectory_prep(
    train: DataFrame, start: date | None = None, end: date | None = None, zero: str = "null", first: str | None = None
) -> DataFrame:
    """Gap-free daily trajectories with the log of sales.

    Rows in the closed date range (None: no bound), without trajectories that ever had a return; days between a
    trajectory's first and last sale get ``open`` 0 and the last known key, promotion and log sales.
    ``zero`` says what the log of zero sales is: null (then filled) or minus infinity.
    ``first`` names an optional column with the trajectory's first date.
    Input: date, store_nbr, item_nbr, unit_sales, onpromotion (text).  One shuffle of the facts.
    """
    rows = between(train.select("date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"),
                   "date", start, end)
    rows = downcast(
        rows.withColumns(
            {
                "onpromotion": text_flag(F.col("onpromotion")),
                "traj_id": composite_key(F.col("store_nbr"), F.col("item_nbr")),
                "open": F.lit(1).cast("tinyint"),
            }
        )
    )
    rows = rows.withColumn("log_sales", log_target(F.col("unit_sales"), zero))
    panel = fill_gaps(
        rows,
        TRAJECTORY,
        forward=["store_nbr", "item_nbr", "onpromotion", "log_sales"],
        lowest="unit_sales",
        first=first,
    )
    return panel.select(
        "traj_id", "date", "store_nbr", "item_nbr", "onpromotion", "log_sales",
        F.coalesce(F.col("open"), F.lit(0).cast("tinyint")).alias("open"),
        *([first] if first else []),
    )


def star_assembly(
    tables: Mapping[str, DataFrame],
    start: date | None = None,
    end: date | None = None,
    *,
    zero: str = "null",
    dedupe_holidays: bool = False,
) -> DataFrame:
    """The joined retail panel; write it with ``write_table`` or ``materialize``.

    ``tables``: train, stores, items, transactions, oil, holidays_events.  The facts are shuffled
    once, inside ``trajectory_prep``; every other table is attached by ``attach``.  The oil price
    and the transactions are forward filled per trajectory on their own small tables.
    """
    panel = trajectory_prep(tables["train"], start, end, zero, "first_date")
    # the oil price is carried on to the last day of the facts
    until = end or tables["train"].agg(F.max("date")).first()[0]
    oil = tables["oil"].withColumnRenamed("dcoilwtico", "oil_price")
    panel = attach_filled_series(
        panel, downcast(oil), date="date", value="oil_price", since="first_date", until=until
    ).where(F.col("oil_price").isNotNull())
    panel = inner_join_dims(
        panel,
        [(downcast(tables["stores"]), "store_nbr"), (downcast(tables["items"]), "item_nbr")],
    )
    panel = attach_filled_series(
        panel,
        downcast(tables["transactions"]),
        date="date",
        value="transactions",
        since="first_date",
        place="store_nbr",
        how="inner",
    )
    panel = holiday_join(panel, tables["holidays_events"], dedupe=dedupe_holidays)
    day = F.col("date")
    return panel.drop("first_date").withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "day_of_month": F.dayofmonth(day),
            "day_of_week": iso_weekday(day),
        }
    )
