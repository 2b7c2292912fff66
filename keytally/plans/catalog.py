"""All registered queries."""

from __future__ import annotations

from keytally.plans import exact, frequent, linear, quality, sampling, streams, synthetic

AREAS = (exact, linear, frequent, sampling, synthetic, quality, streams)


def all_queries() -> dict:
    merged: dict = {}
    for area in AREAS:
        for name, query in area.reg.queries.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = query
    return merged


def all_sql() -> dict[str, str]:
    return {name: text for area in AREAS for name, text in area.reg.sql.items()}
