"""Definitions shared by all operators: instruments, variables, splits, table schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import types as T

#: Minutes of each timeframe (fixed values).
TIMEFRAMES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440}

_KEY = re.compile(r"^[a-z][A-Za-z0-9]*\.[a-zA-Z][a-zA-Z0-9_]*$")


def is_variable_key(key: str) -> bool:
    """``namespace.name``."""
    return bool(_KEY.match(key))


@dataclass(frozen=True)
class Instrument:
    id: str
    symbol: str
    session_timezone: str = "America/New_York"
    tick_size: float = 0.1
    point_value: float = 1.0
    open_minute: int = 570
    close_minute: int = 960
    description: str = ""


@dataclass(frozen=True)
class Binning:
    """How values become buckets: none, edges, quantile (count) or width (width, origin)."""

    kind: str = "none"
    edges: tuple[float, ...] = ()
    count: int = 5
    width: float = 1.0
    origin: float = 0.0


@dataclass(frozen=True)
class Variable:
    key: str
    column: str
    value_type: str = "continuous"  # continuous, ordinal, categorical, boolean
    causality: str = "predictor"  # predictor, outcome, meta
    binning: Binning = field(default_factory=Binning)
    label: str = ""
    unit: str = ""
    produced_by: str = ""

    @property
    def categorical(self) -> bool:
        return self.value_type in ("categorical", "boolean")


@dataclass(frozen=True)
class Split:
    """A named half-open range of time."""

    name: str
    role: str  # training, validation, holdout
    start: datetime
    end: datetime
    embargo_days: int = 0

    def overlaps(self, other: "Split") -> bool:
        """Whether the ranges overlap once each end is pushed out by its embargo."""
        mine, theirs = timedelta(days=self.embargo_days), timedelta(days=other.embargo_days)
        return self.start < other.end + theirs and other.start < self.end + mine


BAR_SCHEMA = T.StructType([
    T.StructField("instrument", T.StringType()), T.StructField("timeframe", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "tick_volume", "volume", "spread")),
])
BAR_KEY = ["instrument", "timeframe", "ts"]
