"""Every operator as a query over the given tables, with the SQL it must agree with."""

from . import columns, groups, joins, cohorts, models, panels, rows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
