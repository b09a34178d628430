"""panelcast: a Spark-native engine for short-horizon event forecasting on
multi-station panels (labelling, features, training, metrics, bootstrap,
data products and streaming)."""

from .spec import DEFAULT_HORIZONS, PROXY_SPEC, STATION_SPEC, Horizon, PanelSpec

__all__ = ["Horizon", "PanelSpec", "DEFAULT_HORIZONS", "STATION_SPEC", "PROXY_SPEC"]
