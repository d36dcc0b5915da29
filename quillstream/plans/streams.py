"""Streams over the events table, replayed to their end and held against the batch answer."""

from __future__ import annotations

from quillstream.plans.common import Plans
from quillstream.plans.history import RANKS
from quillstream.streaming import streams as S

P = Plans()
_RANK = "coalesce(list_position(['view', 'click', 'signup', 'logout', 'purchase'], event_type), 0)"


def _add(name: str, sql: str, operator) -> None:
    """``operator(stream, late)``: a table's files come in no order, so they are one batch, in which nothing is late."""

    def query(spark, sf_dir):
        return S.replay(S.read(spark, sf_dir, "events", 1 << 30), lambda stream: operator(stream, "2 hours"))

    P.queries[name], P.sql[name] = query, sql


_add("strm_2_changes", "select user_id, event_id, event_type from events qualify event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id)", lambda stream, late: S.changes(stream, late).drop("late"))
_add("strm_3_advances", f"""
    select user_id, event_id, r::int as rank from (select *, {_RANK} as r, coalesce(max({_RANK}) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as b from events) where r > b
""", lambda stream, late: S.advances(stream, RANKS, late).drop("late"))
_add("strm_5_strikes", """
    with f as (select *, value < 40 as failed, sum(case when value < 40 then 0 else 1 end) over (partition by user_id order by ts, event_id) as run from events)
    select user_id, event_id from f where failed qualify row_number() over (partition by user_id, run order by ts, event_id) = 3
""", lambda stream, late: S.strikes(stream, "value < 40", late).drop("late"))
_add("strm_4_hourly_closed", "select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) as n from events group by all", S.hourly)
