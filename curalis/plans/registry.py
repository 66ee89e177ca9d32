"""All queries of the library's own operators."""

from __future__ import annotations

from curalis.plans import arrays, base, joining, measuring, scalars, selecting, streams, tables  # noqa: F401  they register themselves


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
