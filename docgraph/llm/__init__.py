"""Operations of a training-data pipeline.

Nothing else in the library imports this package.  Each module holds one
operator, the query that applies it to its whole table (``QUERIES``) and,
where SQL can state the result, the SQL for it (``ORACLE_SQL``).
"""

from __future__ import annotations

import importlib

MODULES = ("sharding", "decontamination", "line_dedup", "lm_scoring", "records", "secret_scan", "mixing", "simhash", "quality", "warc")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"{__name__}.{name}"), attribute))
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
