"""Monthly series: text months to a month-end panel without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.timegrid import parse_year_month
from panelweave.operators.series import fill_gaps
from panelweave.spec import PanelSpec

MONTH_ENDS = PanelSpec(step="1 month")


def upsample_monthly(df: DataFrame, spec: PanelSpec = MONTH_ENDS) -> DataFrame:
    """Every month end between an entity's first and last month; made rows have no value."""
    ends = df.withColumn(spec.ts, F.last_day(spec.ts))
    return fill_gaps(ends, spec.with_(step="1 month"))


def month_end_panel(df: DataFrame, month: str, value: str) -> DataFrame:
    """One series of ``YYYY-MM`` text and a value to id, ts, y, month, year."""
    rows = df.select(
        F.lit(0).alias("id"), parse_year_month(F.col(month)).alias("ts"), F.col(value).alias("y")
    )
    ts = F.col("ts")
    return upsample_monthly(rows).withColumns({"month": F.month(ts), "year": F.year(ts)})
