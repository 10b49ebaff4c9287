"""Sessions and events told once: restarts, late rows, and the same rows as from a table; paths in branching trees."""

import random
from datetime import datetime, timedelta

from tessella.operators import trees
from tessella.streaming import sessions

EVENTS = "ts timestamp, user_id long, value double, event_id long"
START = datetime(2024, 1, 1)


def made(n, seed=1, span=1200):
    r = random.Random(seed)
    minutes = sorted(r.uniform(0, span) for _ in range(n))
    return [(START + timedelta(minutes=m), r.choice([1, 1, 1, 2, 3, None]), float(r.randrange(10)), k) for k, m in enumerate(minutes)]


def plain(rows, gap=30):
    out, of = [], {}
    for ts, user, value, _ in sorted(rows, key=lambda r: r[0]):
        of.setdefault(user, []).append((ts, value))
    for user, events in of.items():
        held = [events[0]]
        for e in events[1:]:
            if e[0] - held[-1][0] > timedelta(minutes=gap):
                out.append((user, held))
                held = []
            held.append(e)
        out.append((user, held))
    return {(u, h[0][0], h[-1][0] + timedelta(minutes=gap), len(h), sum(v for _, v in h)) for u, h in out}


def told(spark, folder, schema):
    return {(r["user_id"], r["start"], r["end"], r["n"], r["total"]) for r in spark.read.schema(schema).parquet(folder).collect()}


def test_sessions_of_a_table(spark):
    rows = made(300)
    assert {tuple(r) for r in sessions.sessions(spark.createDataFrame(rows, EVENTS)).collect()} == plain(rows)


def test_sessions_survive_a_restart_and_drop_what_is_late(spark, tmp_path):
    rows, (folder, store, checkpoint) = made(400, 2), (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    write = lambda part: spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)

    def run():
        found = sessions.sessions(sessions.events_of(spark, folder, spark.createDataFrame([], EVENTS).schema))
        sessions.kept(found, store, checkpoint).awaitTermination()
        return told(spark, store, found.schema)

    write(rows[:200])
    first = run()
    assert first and first == {s for s in plain(rows[:200]) if s[2] <= rows[199][0] - timedelta(minutes=10)}
    assert run() == first  # nothing new
    late = (rows[0][0], 1, 99.0, 5000)  # long before the watermark
    write([*rows[200:], late])
    assert run() == {s for s in plain(rows) if s[2] <= rows[-1][0] - timedelta(minutes=10)}


def test_events_are_told_once(spark, tmp_path):
    rows, (folder, store, checkpoint) = made(200, 3), (str(tmp_path / n) for n in ("in", "store", "checkpoint"))
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        sessions.kept(sessions.told_once(sessions.events_of(spark, folder, schema), ["event_id"]), store, checkpoint).awaitTermination()
        return sorted(r["event_id"] for r in spark.read.parquet(store).collect())

    for part in ([*rows[:100], *rows[50:60]], [*rows[95:], *rows[100:120]]):  # repeats in a batch, and of the batch before
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        found = run()
    assert found == list(range(200))


def test_paths_of_branching_trees(spark):
    r = random.Random(5)
    nodes = [(c, k, r.randrange(k) if k and r.random() < 0.97 else (None if r.random() < 0.5 else 10_000), f"n{k}") for c in (1, 2) for k in range(150)]
    nodes += [(3, k, k - 1 if k else None, f"n{k}") for k in range(100)]  # a line
    nodes += [(4, 0, 1, "a"), (4, 1, 0, "b"), (4, 2, None, "c")]  # a circle, and a root of its own
    parent = {(c, k): p for c, k, p, _ in nodes}

    def path(c, k):
        out = [f"n{k}" if c < 4 else "abc"[k]]
        while parent[c, k] is not None and (c, parent[c, k]) in parent:
            k = parent[c, k]
            out.append(f"n{k}")
        return "/".join(out[::-1])

    got = {(x["c"], x["id"]): (x["depth"], x["path"]) for x in trees.root_paths(spark.createDataFrame(nodes, "c long, id long, parent long, label string"), ["c"], "label").collect()}
    want = {(c, k): (path(c, k).count("/") + 1, path(c, k)) for c, k, _, _ in nodes if c < 4} | {(4, 2): (1, "c")}
    assert got == want
    assert trees.root_paths(spark.createDataFrame([], "c long, id long, parent long, label string"), ["c"], "label").count() == 0
