"""Incremental pulls over several runs, and trend fits against numpy."""

import datetime as dt

import numpy as np

from xcheck.operators import model, sync

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "connection_id string, feed string, id long, ts timestamp, v int"


def _rows(*items):
    return [(c, "orders", i, DAY + dt.timedelta(hours=h), v) for c, i, h, v in items]


def test_runs_lose_nothing(spark, tmp_path):
    folder = str(tmp_path)
    one = _rows(("a", 1, 0, 1), ("a", 2, 10, 1), ("b", 1, 5, 1))
    s = {r.connection_id: r for r in sync.sync_run(spark.createDataFrame(one, SCHEMA), folder, 1, "ts", 6).collect()}
    assert (s["a"].pulled, s["a"].cursor, s["a"].state) == (2, DAY + dt.timedelta(hours=10), "idle")
    # a late order inside the overlap, one outside it, an update, a new connection, and one that fails
    two = one + _rows(("a", 3, 5, 1), ("a", 4, 3, 1), ("a", 5, 20, 1), ("c", 9, 1, 1))
    two = [(c, f, i, t, 7 if (c, i) == ("a", 2) else v) for c, f, i, t, v in two]
    failed = spark.createDataFrame([("b", "orders", "401")], "connection_id string, feed string, message string")
    s = {r.connection_id: r for r in sync.sync_run(spark.createDataFrame(two, SCHEMA), folder, 2, "ts", 6, failed).collect()}
    assert (s["a"].pulled, s["a"].state) == (3, "idle") and s["a"].cursor == DAY + dt.timedelta(hours=20)
    assert (s["b"].pulled, s["b"].state, s["b"].message, s["b"].cursor) == (0, "error", "401", DAY + dt.timedelta(hours=5))
    assert (s["c"].pulled, s["c"].state) == (1, "idle")
    have = {(r.connection_id, r.id): r.v for r in sync.stored_rows(spark, folder, ["connection_id", "id"]).collect()}
    assert have == {("a", 1): 1, ("a", 2): 7, ("a", 3): 1, ("a", 5): 1, ("b", 1): 1, ("c", 9): 1}
    # nothing new: cursors stay, and the failed connection goes on from its own
    s = {r.connection_id: r for r in sync.sync_run(spark.createDataFrame(two, SCHEMA), folder, 3, "ts", 0).collect()}
    assert s["a"].cursor == DAY + dt.timedelta(hours=20) and s["b"].state == "idle" and s["b"].pulled == 1
    states = spark.read.parquet(f"{folder}/cursors").where("run = 2 and connection_id = 'b'").orderBy("step").collect()
    assert [r.state for r in states] == ["syncing", "error"]


def test_quadratic_equals_polyfit(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        x = np.arange(300, 300 + 5 + 12 * g)
        y = np.round(1e6 + 40 * x - 0.3 * x * x + rng.normal(0, 5, len(x)), 2)
        rows += [(g, int(a), float(b)) for a, b in zip(x, y)]
    rows += [(9, 1, 2.0), (9, 2, 3.0), (8, 1, None)]
    got = {r.g: r for r in model.trend_fit(spark.createDataFrame(rows, "g int, x int, y double"), ["g"], "x", "y").collect()}
    for g in range(6):
        x, y = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        c = np.polyfit(x - x.mean(), y, 2)
        at = lambda v: got[g].quad_c0 + got[g].quad_c1 * v + got[g].quad_c2 * v * v
        assert abs(got[g].quad_c2 - c[0]) < 1e-6 * max(1, abs(c[0])) and np.allclose([at(v) for v in x], np.polyval(c, x - x.mean()), rtol=1e-8)
    assert got[9].quad_c2 is None and got[9].n == 2 and got[8].n == 0
