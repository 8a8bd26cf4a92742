"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from registered import features, models, profiles, quality, scans

_PARTS = (scans, profiles, quality, features, models)


def all_queries():
    return {name: query for part in _PARTS for name, (query, _) in part.REGISTERED.items()}


def all_sql():
    return {name: sql for part in _PARTS for name, (_, sql) in part.REGISTERED.items() if sql is not None}
