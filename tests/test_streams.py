"""Streams give the same whether a table comes in one micro-batch or in several, in any order."""

import random

import pytest

from quillstream.plans.history import RANKS
from quillstream.streaming import streams as S

SF = "/root/testdata/sf0.001"

OPERATORS = {
    "changes": lambda stream: S.changes(stream, "4000 days"),
    "advances": lambda stream: S.advances(stream, RANKS, "4000 days"),
    "strikes": lambda stream: S.strikes(stream, "value < 40", "4000 days"),
    "hourly": lambda stream: S.hourly(stream, "4000 days"),
}


@pytest.fixture(scope="module")
def pieces(spark, tmp_path_factory):
    """The events in three files that interleave in time."""
    folder = tmp_path_factory.mktemp("pieces")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3, "event_id").write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", OPERATORS)
def test_three_batches_are_as_one(spark, pieces, name):
    one = S.replay(S.read(spark, SF, "events", 1000), OPERATORS[name])
    three = S.replay(S.read(spark, pieces, "events", 1), OPERATORS[name])
    got = sorted(map(tuple, one.collect()))
    assert got and got == sorted(map(tuple, three.collect()))


def test_all_windows_close(spark):
    rows = S.replay(S.read(spark, SF, "events", 1), S.hourly)
    assert rows.agg({"n": "sum"}).head()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def ordered(folder, batches):
    """One file a batch, in this order of time."""
    import os

    import pandas as pd

    os.makedirs(f"{folder}/events.parquet")
    for k, rows in enumerate(batches):
        path = f"{folder}/events.parquet/part-{k}.parquet"
        frame = pd.DataFrame(rows, columns=["user_id", "event_id", "event_type", "ts"])
        frame["ts"] = pd.to_datetime(frame["ts"], unit="s").astype("datetime64[us]")
        frame.to_parquet(path)
        os.utime(path, (1_700_000_000 + 60 * k,) * 2)
    return str(folder)


HOUR = 3600


def test_late_rows_are_given_out_and_state_is_what_the_clock_has_not_passed(spark, tmp_path):
    rng = random.Random(2)
    # batches of four hours each, in which rows are in no order; some come an hour, three hours or nine hours late
    rows, batches = [], []
    for k in range(12):
        own = []
        for _ in range(60):
            behind = rng.choice([0] * 20 + [1, 3, 9]) * HOUR
            at = 1_000_000_000 + k * 4 * HOUR + rng.randrange(4 * HOUR) - behind
            rows.append((rng.randrange(5), len(rows), rng.choice("abc"), at))
            own.append(rows[-1])
        batches.append(own)
    late, lost, kept, top, before = set(), set(), [], 0, 0
    for own in batches:
        for r in own:
            if r[3] <= before - 2 * 2 * HOUR:  # Spark drops by the watermark of the batch before
                lost.add(r[1])
            elif r[3] <= top - 2 * HOUR:
                late.add(r[1])
            else:
                kept.append(r)
        before, top = top, max(top, *(r[3] for r in own))
    assert late and lost
    wanted, last = set(), {}
    for user, event, kind, _ in sorted(kept, key=lambda r: (r[3], r[1])):
        if last.get(user) != kind:
            wanted.add(event)
        last[user] = kind
    progress = []
    got = S.replay(S.read(spark, ordered(tmp_path, batches), "events", 1), lambda stream: S.changes(stream, "2 hours"), progress).collect()
    assert {r.event_id for r in got if r.late} == late
    assert {r.event_id for r in got if not r.late} == wanted and len(got) == len(late) + len(wanted)
    states = [p["stateOperators"][0] for p in progress]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == len(lost)
