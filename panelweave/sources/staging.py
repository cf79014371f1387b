"""Written tables in the cluster's shared folder.

A staged table cuts the lineage, survives lost executors, is computed once however often it is
used, and gives the planner exact file sizes for its broadcast decision.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="panelweave-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/panelweave/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table; ``codec`` replaces the session's compression."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """``stage`` plus the number of rows, counted while they are written."""
    seen = Observation()
    stored = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return stored, seen.get["rows"]


def discard(*stored: DataFrame) -> None:
    """Delete the folders of tables from ``stage`` that nothing reads any more; folders of others are left alone."""
    for df in stored:
        spark, own = df.sparkSession, f"{shared_dir(df.sparkSession)}/panelweave/".split(":", 1)[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this library has staged in the session's shared folder; call it when their results are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/panelweave")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer has committed the table at ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse the table stored at ``path``; compute and store it when there is none, or only a part.

    A complete table has the marker that Spark's writers leave when they commit.
    """
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
