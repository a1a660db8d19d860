"""Registered checks: each key pairs a Spark query with an equivalent SQL text.

The Spark side uses the library on the driver-given parquet tables; the SQL
side restates the same rule for DuckDB so results can be compared.
"""

from __future__ import annotations

from siftframe.suite import charts, clean, profile, stats

QUERIES = {**stats.QUERIES, **profile.QUERIES, **clean.QUERIES, **charts.QUERIES}
ORACLES = {**stats.ORACLES, **profile.ORACLES, **clean.ORACLES, **charts.ORACLES}
