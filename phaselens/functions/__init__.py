"""Column-level helpers: phase calendar, exact metrics, text, time parsing."""

from phaselens.functions.calendar import (CRISIS, DRIVER_CALENDAR, PRE, RECOVERY, REFERENCE_CALENDAR,
                                          PhaseCalendar, with_phase)
from phaselens.functions.metrics import (decline_pct, exact_mean, money_total, monthly_mean, pct, ratio,
                                         round_double, yn_flag)
from phaselens.functions.text import NEGATIVE_WORDS, ascii_words
from phaselens.functions.timeparse import parse_mixed_ts

__all__ = [
    "CRISIS", "DRIVER_CALENDAR", "PRE", "RECOVERY", "REFERENCE_CALENDAR", "PhaseCalendar", "with_phase",
    "decline_pct", "exact_mean", "money_total", "monthly_mean", "pct", "ratio", "round_double", "yn_flag",
    "NEGATIVE_WORDS", "ascii_words", "parse_mixed_ts",
]
