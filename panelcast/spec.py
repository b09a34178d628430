"""Panel specification: column names, horizons, thresholds and window sizes.

Every operator takes a :class:`PanelSpec` so the same code serves the real
station master (15-minute steps, one calendar year hold-out) and the proxy
panel derived from the driver's ``events`` table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Horizon:
    name: str              # label used in tables and column suffixes, e.g. "1h"
    steps: int             # number of forward rows accumulated
    light_threshold: float  # upper bound (mm, inclusive) of the "light" class
    minutes: int           # horizon in minutes (dashboard field)


# Fixed values that must equal the reference for right results.
# Horizons (15-minute steps) and light-rain upper bounds in mm:
#   1h = 4 steps, 0.254 mm; 3h = 12 steps, 0.508 mm; 6h = 24 steps, 0.762 mm
# Rain lags (rows): 1, 2, 3, 6, 12.  Rolling windows (rows): 3, 6, 12.
# Hold-out: rows with TIMESTAMP >= max(TIMESTAMP) - 1 year.
DEFAULT_HORIZONS = (
    Horizon("1h", 4, 0.254, 60),
    Horizon("3h", 12, 0.508, 180),
    Horizon("6h", 24, 0.762, 360),
)
DEFAULT_LAGS = (1, 2, 3, 6, 12)
DEFAULT_ROLLS = (3, 6, 12)


@dataclass(frozen=True)
class PanelSpec:
    station: str = "station"
    ts: str = "TIMESTAMP"
    rain: str = "Rain_mm_Tot"
    # Explicit tie-break column for duplicate (station, TIMESTAMP) keys.
    tie: str | None = None
    horizons: tuple[Horizon, ...] = DEFAULT_HORIZONS
    holdout: str = "1 YEAR"           # SQL interval literal body
    lags: tuple[int, ...] = DEFAULT_LAGS
    rolls: tuple[int, ...] = DEFAULT_ROLLS
    # Rows per window chunk (see operators.sequence). Must exceed the largest halo.
    chunk_rows: int = 1 << 20
    # Cross-station resampling step for irregular panels (None = use TIMESTAMP as is).
    resample: str | None = None
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "PanelSpec":
        return replace(self, **kw)

    def horizon(self, name: str) -> Horizon:
        for h in self.horizons:
            if h.name == name:
                return h
        raise KeyError(name)

    @property
    def max_forward(self) -> int:
        return max(h.steps for h in self.horizons)

    @property
    def max_backward(self) -> int:
        # lags look back k rows; rolling / trailing sums look back n-1 rows
        return max([*self.lags, *(n - 1 for n in self.rolls), *(h.steps - 1 for h in self.horizons)])

    def target_cols(self) -> list[str]:
        out = []
        for h in self.horizons:
            out += [f"obs_precip_{h.name}", f"obs_class_{h.name}"]
        return out


# The station master of the reference: 4 stations, 15-minute steps.
STATION_SPEC = PanelSpec()

# The proxy panel built from the driver's ``events`` table (FIXTURES.md §D):
# event_type plays the station, ts the timestamp, event_id breaks ties, and the
# hold-out is 7 days because the table spans 30 days. Chunks of 4,096 rows keep
# several chunks (and their halos) per station even on the small test tables,
# so the oracle checks cover chunk edges; halo overhead is about 1 %.
PROXY_SPEC = PanelSpec(tie="event_id", holdout="7 DAYS", resample="15 minutes", chunk_rows=4096)
