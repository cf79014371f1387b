"""Names and grid of a panel: which column is the entity, the time and the target."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Seconds in each fixed-length grid unit.
UNIT_SECONDS = {
    "second": 1,
    "minute": 60,
    "hour": 3600,
    "day": 86400,
    "week": 604800,
}


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a long panel plus its time grid.

    ``step`` is the grid distance ("1 hour", "1 day", "1 month").  Ordered operators never hold a
    whole entity in one task: they cut its history into pieces of ``chunk_steps`` grid steps, so
    with one row per (id, ts) a piece has at most ``chunk_steps`` rows however large the entity is.
    """

    id: str = "id"
    ts: str = "ts"
    target: str = "y"
    step: str = "1 hour"
    chunk_steps: int = 4096

    def with_(self, **changes) -> PanelSpec:
        return replace(self, **changes)

    @property
    def step_count(self) -> int:
        return int(self.step.split()[0])

    @property
    def step_unit(self) -> str:
        unit = self.step.split()[1].lower().rstrip("s")
        if unit != "month" and unit not in UNIT_SECONDS:
            raise ValueError(f"unknown grid unit in step {self.step!r}")
        return unit

    @property
    def is_monthly(self) -> bool:
        return self.step_unit == "month"

    @property
    def step_seconds(self) -> int:
        if self.is_monthly:
            raise ValueError("a month has no fixed length in seconds")
        return self.step_count * UNIT_SECONDS[self.step_unit]
