"""A fit / transform / inverse object whose state is two tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.columns import index_to_month, month_to_index
from panelweave.operators import scaling, vocab
from panelweave.operators.joins import attach
from panelweave.sources.files import write_table
from panelweave.sources.staging import stage
from panelweave.spec import PanelSpec


@dataclass(frozen=True)
class PreprocessorState:
    """``scalers``: scope_key, column, mean, scale.  ``vocabularies``: column, value, code."""

    scalers: DataFrame
    vocabularies: DataFrame

    def save(self, path: str) -> None:
        write_table(self.scalers, f"{path}/scalers")
        write_table(self.vocabularies, f"{path}/vocabularies")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PreprocessorState:
        return cls(
            spark.read.schema(scaling.STATE_SCHEMA).parquet(f"{path}/scalers"),
            spark.read.schema(vocab.STATE_SCHEMA).parquet(f"{path}/vocabularies"),
        )


@dataclass(frozen=True)
class PanelPreprocessor:
    """Which columns are scaled, encoded, shifted or passed on, and in which order they come out.

    ``scope`` is "group" (a scaler per entity) or "global".
    """

    spec: PanelSpec
    scale: Sequence[str] = ()
    encode: Sequence[str] = ()
    months: Sequence[str] = ()
    scope: str = "group"
    output: Sequence[str] = ()
    unseen: str = "error"
    types: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.scope not in ("group", "global"):
            raise ValueError("scope must be 'group' or 'global'")
        twice = set(self.scale) & set(self.encode) | set(self.months) & set(self.encode)
        if twice:
            raise ValueError(f"columns with two roles: {sorted(twice)}")

    @property
    def _by(self) -> str | None:
        return self.spec.id if self.scope == "group" else None

    def fit(self, df: DataFrame) -> PreprocessorState:
        """Fitted state, stored once; fit on training rows only to keep test data out of it."""
        spark = df.sparkSession
        scalers = (
            stage(scaling.fit_scaler(df, self.scale, self._by), "scalers")
            if self.scale
            else spark.createDataFrame([], scaling.STATE_SCHEMA)
        )
        vocabularies = (
            stage(vocab.fit_vocabulary(df, self.encode), "vocabularies")
            if self.encode
            else spark.createDataFrame([], vocab.STATE_SCHEMA)
        )
        return PreprocessorState(scalers, vocabularies)

    def transform(self, df: DataFrame, state: PreprocessorState) -> DataFrame:
        out = df
        if self.scale:
            # the scope key is the entity label, so scaling comes before encoding
            out = scaling.scale(out, state.scalers, self.scale, self._by)
        if self.months:
            out = out.withColumns({m: month_to_index(F.col(m)) for m in self.months})
        if self.encode:
            out = vocab.encode_labels(out, state.vocabularies, self.encode, self.unseen)
        return out.select(*self.output) if self.output else out

    def inverse(self, df: DataFrame, state: PreprocessorState) -> DataFrame:
        present = set(df.columns)
        encoded = [c for c in self.encode if c in present]
        scaled = {c: c for c in self.scale if c in present}
        out = vocab.decode_labels(df, state.vocabularies, encoded, dict(self.types)) if encoded else df
        months = {m: index_to_month(F.col(m)) for m in self.months if m in present}
        if months:
            out = out.withColumns(months)
        return scaling.inverse_scale(out, state.scalers, scaled, self._by) if scaled else out

    def missing(self, state: PreprocessorState) -> DataFrame:
        """Declared columns that the state does not cover, as a one-column table."""
        spark = state.scalers.sparkSession
        wanted = [("scaler", c) for c in self.scale] + [("vocabulary", c) for c in self.encode]
        declared = spark.createDataFrame(wanted, "kind string, column string")
        fitted = state.scalers.select(F.lit("scaler").alias("kind"), "column").unionByName(
            state.vocabularies.select(F.lit("vocabulary").alias("kind"), "column")
        )
        return declared.join(fitted, ["kind", "column"], "left_anti")

    def uncovered(self, df: DataFrame, state: PreprocessorState) -> DataFrame:
        """What ``df`` needs and the state lacks: kind, column, key (scope or value) and the rows that need it.

        Empty when ``transform`` can take every row.  A null entity needs a state of its own; a null label is never covered.
        """
        scope = F.col(self._by).cast("string") if self._by else F.lit(scaling.EVERYTHING)
        names = lambda columns: F.explode(F.array(*[F.lit(c) for c in columns]).cast("array<string>")).alias("column")
        scopes = df.groupBy(scope.alias("key")).agg(F.count(F.lit(1)).alias("rows")).select("key", "rows", names(self.scale))
        held = state.scalers.select("column", F.col("scope_key").alias("key"))
        out = attach(scopes, held, ["column", "key"], "left_anti", null_safe=True).select(F.lit("scaler").alias("kind"), "column", "key", "rows")
        if self.encode:
            cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in self.encode]))
            values = df.select(cells).groupBy("column", "key").agg(F.count(F.lit(1)).alias("rows"))
            held = state.vocabularies.select("column", F.col("value").alias("key"))
            lacking = attach(values, held, ["column", "key"], "left_anti")
            out = out.unionByName(lacking.select(F.lit("vocabulary").alias("kind"), "column", "key", "rows"))
        return out

    def is_fitted(self, state: PreprocessorState | None) -> bool:
        if state is None:
            return False
        if not self.scale and not self.encode:
            return True
        try:
            return self.missing(state).isEmpty()
        except AnalysisException:
            return False


# Input roles of the meter panel.
METER_SCALED = ("year", "y")
METER_ENCODED = ("id", "month", "day", "hour", "day_of_week")
METER_COLUMNS = ("id", "ts", "year", "month", "day", "day_of_week", "hour", "y")


def electricity_preprocessor(scope: str = "group") -> PanelPreprocessor:
    """Hourly meter panel: year and target scaled per meter, id and calendar columns encoded."""
    return PanelPreprocessor(
        PanelSpec(),
        scale=METER_SCALED,
        encode=METER_ENCODED,
        scope=scope,
        output=METER_COLUMNS,
    )


# Input roles of the retail panel.
RETAIL_REAL = ("oil_price", "transactions", "year")
RETAIL_CATEGORICAL = (
    "item_nbr", "store_nbr", "city", "state", "type", "cluster", "family", "class",
    "month", "day_of_month", "day_of_week", "national_hol", "regional_hol", "local_hol",
    "onpromotion", "open", "perishable",
)


def retail_preprocessor(
    target: str = "log_sales",
    real: Sequence[str] = RETAIL_REAL,
    categorical: Sequence[str] = RETAIL_CATEGORICAL,
) -> PanelPreprocessor:
    """Retail panel: one scaler per column over all trajectories, categorical inputs encoded."""
    return PanelPreprocessor(
        PanelSpec(id="traj_id", ts="date", target=target, step="1 day"),
        scale=(target, *real),
        encode=tuple(categorical),
        scope="global",
    )
