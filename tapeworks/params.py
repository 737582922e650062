"""The tunable values of the library, checked once."""

from __future__ import annotations

from dataclasses import dataclass

TIMEFRAMES = ("15minute", "60minute", "4hour", "day", "week")
PRESETS = ("auto", "15min", "30min", "custom")
#: Days of history that each timeframe's scan looks back on.
LOOKBACK_DAYS = {"3minute": 6, "15minute": 15, "30minute": 30, "60minute": 90, "4hour": 120, "day": 400, "week": 730}


@dataclass(frozen=True)
class Params:
    timeframe: str = "60minute"
    macd_preset: str = "auto"
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    rsi_length: int = 9
    rsi_smooth: int = 9
    ema_length: int = 9
    bb_length: int = 20
    min_required: int = 2
    rel_volume: float = 1.2
    adx_length: int = 14
    ranging_multiplier: float = 1.3
    require_index: bool = False
    require_flow: bool = False
    require_candle: bool = False
    require_sector: bool = False
    require_breadth: bool = False
    breadth_pct: float = 30.0
    atr_length: int = 14
    atr_stop: float = 1.5
    atr_target: float = 3.0
    capital: float = 100_000.0
    risk_pct: float = 1.0
    max_daily_risk_pct: float = 3.0
    max_positions: int = 5

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.timeframe in TIMEFRAMES, f"timeframe: one of {TIMEFRAMES}")
        need(self.macd_preset in PRESETS, f"macd_preset: one of {PRESETS}")
        for name in ("macd_fast", "macd_slow", "macd_signal", "rsi_length", "rsi_smooth", "ema_length", "bb_length", "max_positions"):
            need(getattr(self, name) >= 1, f"{name}: at least 1")
        for name in ("adx_length", "atr_length"):
            need(getattr(self, name) >= 2, f"{name}: at least 2")
        for name in ("rel_volume", "atr_stop", "atr_target", "capital"):
            need(getattr(self, name) > 0, f"{name}: above 0")
        need(self.min_required in (2, 3, 4), "min_required: 2, 3 or 4")
        need(self.ranging_multiplier >= 1, "ranging_multiplier: at least 1")
        need(0 < self.breadth_pct < 100, "breadth_pct: between 0 and 100")
        for name in ("risk_pct", "max_daily_risk_pct"):
            need(0 < getattr(self, name) <= 100, f"{name}: above 0, at most 100")

    def macd_spans(self, timeframe: str | None = None) -> tuple[int, int, int]:
        """Spans of the fast and slow averages and of the signal line."""
        short = {"15minute": (3, 8, 9), "30minute": (8, 16, 9)}
        own = (self.macd_fast, self.macd_slow, self.macd_signal)
        if self.macd_preset == "auto":
            return short.get(timeframe or self.timeframe, own)
        return {"15min": (3, 8, 9), "30min": (8, 16, 9)}.get(self.macd_preset, own)
