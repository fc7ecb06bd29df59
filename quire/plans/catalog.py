"""All queries of the core, with their SQL."""

from __future__ import annotations

from quire.plans import dealt, reference

FLAGSHIP = "page_types_by_rule"


def queries() -> dict:
    return dict(reference.QUERIES) | dict(dealt.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(reference.SQL) | dict(dealt.SQL)
