"""Panel time-series preparation, windowing, scaling, forecasting and scoring on Spark."""

from panelweave.spec import PanelSpec

__all__ = ["PanelSpec"]
