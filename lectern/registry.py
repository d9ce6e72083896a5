"""Every registered query of the library's own operators, with its SQL."""

from __future__ import annotations

from lectern.plans import base, ledger_queries, more_queries, order_queries, package_queries, page_queries, reader_queries, report_queries, study_queries, text_queries  # noqa: F401

FLAGSHIP = "search_hits"


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
