"""Every registered query with its SQL oracle."""

from tracewright.plans import advection, clips, contacts, extras, findings, motion, physics, reporting, screening, smoothing, stores, streams, unified, violations  # noqa: F401
from tracewright.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
