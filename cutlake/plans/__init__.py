"""Registered demonstrations: every operator on the driver's tables, with its SQL check."""

from cutlake.plans.base import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
