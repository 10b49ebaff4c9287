"""Merged sketches against exact counts, and what a month's query reads."""

import contextlib
import io
import random
from datetime import datetime, timedelta

from tessella.operators import rollups


def test_months_from_days(spark, tmp_path):
    r = random.Random(1)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=r.randrange(90 * 1440)), r.choice("ab"), r.randrange(6000), r.random() * 100) for _ in range(20_000)] + [(None, "a", None, None), (datetime(2024, 4, 2), "c", 1, None)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, user_id long, value double")
    events.write.parquet(f"{tmp_path}/events")
    rollups.daily(spark.read.parquet(f"{tmp_path}/events")).write.parquet(f"{tmp_path}/days")
    days = spark.read.parquet(f"{tmp_path}/days")
    months = rollups.told(rollups.merged(days, "month", "event_type"), 0.1, 0.5, 0.9)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        months.explain("formatted")
    assert "days" in said.getvalue() and "events" not in said.getvalue().replace("event_type", "")
    got = {(x["day"], x["event_type"]): x for x in months.collect()}
    want = {}
    for ts, kind, user, value in rows:
        if ts:
            want.setdefault((datetime(ts.year, ts.month, 1), kind), []).append((user, value))
    assert set(got) == set(want)
    for k, held in want.items():
        if k[1] == "c":
            assert got[k]["n"] == 1 and got[k]["q50"] is None and got[k]["users"] == 1
            continue
        users, values = len({u for u, _ in held}), sorted(v for _, v in held)
        assert got[k]["n"] == len(held) and abs(got[k]["total"] - sum(values)) < 1e-6
        assert abs(got[k]["users"] - users) <= 0.05 * users
        for share, q in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90")):
            rank = sum(v <= got[k][q] for v in values) / len(values)
            assert abs(rank - share) <= 0.03
    twice = rollups.told(rollups.merged(rollups.merged(days, "month", "event_type"), "year"), 0.5)
    assert {x["n"] for x in twice.collect()} == {20_001}
