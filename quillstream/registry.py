"""All queries of the library, gathered from the plans' modules."""

from __future__ import annotations

from quillstream.plans import analytics, entities, extras, feed, health, history, identity, linkage, naming, outer, outside, rules, scalars, streams, upkeep
from quillstream.plans.common import Query

_ALL = (feed.P, analytics.P, history.P, entities.P, identity.P, linkage.P, naming.P, outer.P, outside.P, rules.P, scalars.P, health.P, upkeep.P, streams.P, extras.P)


def queries() -> dict[str, Query]:
    return {name: f for plans in _ALL for name, f in plans.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in _ALL for name, sql in plans.sql.items()}
