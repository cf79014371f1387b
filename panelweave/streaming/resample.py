"""Tumbling means on an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.operators.resample import resample_mean
from panelweave.sources.staging import new_path
from panelweave.spec import PanelSpec


def resample_stream(
    stream: DataFrame, spec: PanelSpec, every: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """``resample_mean`` on a streaming frame; a window is emitted once the watermark passed it.

    A watermark needs TIMESTAMP, so a zoneless time column is read in the session time zone.
    """
    if isinstance(stream.schema[spec.ts].dataType, T.TimestampNTZType):
        stream = stream.withColumn(spec.ts, F.col(spec.ts).cast("timestamp"))
    return resample_mean(stream.withWatermark(spec.ts, late), spec, every)


def run_available(stream: DataFrame, label: str = "stream", folder: str | None = None) -> DataFrame:
    """Process everything the source holds now in append mode and return all rows emitted so far.

    With a ``folder`` the job can be stopped and run again: the checkpoint in it holds the source's position and the open
    windows, so a later run goes on where the last one ended and emits every window once.  Rows behind the
    watermark that the earlier runs reached are dropped.
    """
    spark = stream.sparkSession
    base = folder.rstrip("/") if folder else new_path(spark, label)
    out, marks = f"{base}/rows", f"{base}/checkpoint"
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
