"""The registered queries over the driver's tables, and their SQL."""

from lodestone.plans import files  # noqa: F401  registers its queries
from lodestone.plans.queries import QUERIES
from lodestone.plans.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
