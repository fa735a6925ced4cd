"""Named queries over the test tables and the SQL that must give the same rows."""

from lattica.plans import registered_db  # noqa: F401  adds its queries to those below
from lattica.plans.registered import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
