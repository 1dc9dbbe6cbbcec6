"""All registered queries."""

from __future__ import annotations

from wrenchlake.querybook import analytics, changing, pricing, viewing
from wrenchlake.querybook.base import Query

_SECTIONS = [viewing, pricing, changing, analytics]


def all_queries() -> list[Query]:
    return [q for section in _SECTIONS for q in section.QUERIES]


def find(name: str) -> Query:
    return next(q for q in all_queries() if q.name == name)
