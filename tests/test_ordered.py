from pyspark.sql import functions as F

from corvane.operators import ordered, state


def test_previous_and_running_count_cross_range_borders(spark):
    # one hot key spans every range
    rows = spark.createDataFrame([("hot", i, i % 5) for i in range(200)] + [("z", i, 1) for i in range(3)], "k string, n int, v int")
    placed = ordered.ranged(rows.repartition(7), "k", "n")
    assert placed.select("_range").distinct().count() > 1
    got = ordered.with_running_count(ordered.with_previous(placed, "k", "n", "v", "before"), "k", "n", F.col("v") == 0, "zeros").collect()
    for r in got:
        want = None if r["n"] == 0 else ((r["n"] - 1) % 5 if r["k"] == "hot" else 1)
        assert r["before"] == want
        assert r["zeros"] == (r["n"] // 5 + 1 if r["k"] == "hot" else 40)


def test_guard_segments_do_not_change_outcomes(spark):
    kinds = ["ask", "failed", "ask", "ask", "succeeded", "ask", "failed", "failed", "failed", "ask"]
    events = [("hot", i, float(i * 3), kinds[i * 7 % 10]) for i in range(300)]
    got = {r["n"]: r["outcome"] for r in state.loop_guard(
        spark.createDataFrame(events, "k string, n int, s double, e string").repartition(5), "k", "n", "s", "e", ttl=10).collect()}
    guard = None
    for _, n, at, what in events:
        guard, outcome = state.guard_step(guard, what, at, 10)
        assert got[n] == outcome
