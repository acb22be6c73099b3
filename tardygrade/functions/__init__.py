"""Column builders: every function takes and returns Spark columns."""

from .bands import bands, first_match
from .clock import clock_hour, clock_minute, cycle, epoch_seconds, without_midnight_24, weekend_flag
from .rates import masked_rate, percent, presence_flag, rate, zero_safe

__all__ = [
    "bands",
    "clock_hour",
    "clock_minute",
    "cycle",
    "epoch_seconds",
    "first_match",
    "masked_rate",
    "percent",
    "presence_flag",
    "rate",
    "weekend_flag",
    "without_midnight_24",
    "zero_safe",
]
