"""cutlake: PySpark operators for media-production metadata."""

from cutlake.functions.sqlnames import register

__all__ = ["register"]
