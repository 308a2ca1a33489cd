"""Every registered query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from spindrift.plans import personal, profiles, purchases, rerank, rules, search, state, suggestions  # noqa: F401
from spindrift.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
