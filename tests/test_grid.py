"""Travel times on the grid and the scan of its cells, against their definitions."""

import numpy as np

from tremorlake.operators import relational as R
from tremorlake.params import Association

P = Association(xy_grid=0.05, z_grids=(2.0, 8.0))


def stations(spark, n=8):
    g = np.random.default_rng(6)
    return spark.createDataFrame([(f"N.S{i}", 35 + float(g.random()), -118 + float(g.random()), 100.0 * i) for i in range(n)], "net_sta string, lat double, lon double, ele double").cache()


def test_cell_scan_makes_times_for_its_picks_alone(spark):
    st = stations(spark)
    picks = [(c, 0, f"N.S{i}", int(1e6 * (2 + (i * 7 + c) % 9))) for c in (0, 1) for i in range(4)]
    cluster = spark.createDataFrame([*picks, (2, 0, "X.unknown", 5)], "cluster_id long, ot_us long, net_sta string, tp_us long")
    plan = R.cell_scan(cluster, st, P, 1.5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text.replace("BroadcastNestedLoopJoin BuildRight", "") and "CartesianProduct" not in text
    tt = R.travel_times(st, P).join(cluster, "net_sta").toPandas()
    tt["res"] = (tt.ttp - tt.tp_us / 1e6).abs()
    cells = tt[tt.res < 1.5].groupby(["cluster_id", "zi", "xi", "yi"]).res.agg(["size", "sum"]).reset_index()
    cells["sum"] = cells["sum"].round(9)
    want = cells.sort_values(["size", "sum", "zi", "xi", "yi"], ascending=[False, True, True, True, True]).drop_duplicates("cluster_id").set_index("cluster_id")
    got = {r["cluster_id"]: r for r in plan.collect()}
    assert set(got) == set(want.index) == {0, 1}
    for c, r in got.items():
        assert (r["num_sta"], r["zi"], r["xi"], r["yi"]) == tuple(want.loc[c, ["size", "zi", "xi", "yi"]])


def test_travel_times_are_made_by_many_tasks(spark):
    st = stations(spark, 200).coalesce(1)
    tt = R.travel_times(st, P)
    rows = tt.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(n > 0 for n in rows) >= 4 and max(rows) < sum(rows) / 2
