"""Registry of the named queries and their SQL oracles."""

from __future__ import annotations

from .plans import conversations, documents, events, intake, language, records, scripts, star, streams, tasks, vectors  # noqa: F401  (they register their queries)
from .plans._base import ORACLE_SQL, QUERIES  # noqa: F401
