"""phaselens: incident-phase analytics as lazy Spark DataFrames.

A time axis is cut into named phases (before / during / after an
incident) and fact tables are compared across them: trends, revenue
loss, cancellation and SLA rates, rating shifts, churn, top-share
customers, RFM segments, keyword mining and data profiles.

Everything is expressed with the DataFrame API so Catalyst can prune,
push down and plan the shuffles; no Python UDF runs on the hot path.
"""

from phaselens.functions.calendar import PhaseCalendar, with_phase  # noqa: F401
from phaselens.session import get_session  # noqa: F401

__all__ = ["PhaseCalendar", "with_phase", "get_session"]
