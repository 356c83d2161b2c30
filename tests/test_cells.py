import math

import pytest
from pyspark.sql import functions as F

from celltable.functions import columns as C
from celltable.operators import cells as K, patches as P
from celltable.operators.skew import GROUP_LIMIT, avg_rank, prefix_agg, quantiles

NAN, INF = float("nan"), float("inf")


def make_cells(spark, rows):
    """rows: (slide, id, x, y, area, {marker: value}); other markers are 1."""
    cols = ["slide_id", "cell_id", "x", "y", "nucleus_area", *C.MARKERS]
    data = [(s, i, float(x), float(y), float(a), *[m.get(k, 1.0) for k in C.MARKERS]) for s, i, x, y, a, m in rows]
    schema = "slide_id string, cell_id string, " + ", ".join(f"{c} double" for c in cols[2:])
    return spark.createDataFrame(data, schema)


def test_patch_id_forms(spark):
    d = spark.createDataFrame([("1_2_3",), ("a_b",), ("plain",), ("_x",)], "c string")
    assert [r[0] for r in d.select(C.patch_id("c")).collect()] == ["1_2", "a", "plain", ""]


def test_nan_and_inf_are_negative_and_skipped(spark):
    d = K.clean_cells(make_cells(spark, [("s", f"0_0_{i}", i, 0, 10, {"CD3": v}) for i, v in
                                         enumerate([1.0, 2.0, 3.0, NAN, INF, -INF])]))
    thr = K.thresholds(d, ["CD3"]).first()
    assert thr["CD3_weak"] == pytest.approx(2.2) and thr["CD3_strong_cut"] == pytest.approx(2.7)
    flags = K.flag_markers(d, K.thresholds(d, ["CD3"]), ["CD3"]).orderBy("x").collect()
    assert [r["CD3_pos"] for r in flags] == [0, 0, 1, 0, 0, 0]


def test_fixed_threshold_keeps_strong_above_weak(spark):
    d = make_cells(spark, [("s", f"0_0_{i}", i, 0, 10, {"CD3": float(i)}) for i in range(5)])
    t = K.thresholds(d, ["CD3"], fixed={"CD3": {"weak": 9, "strong": 2}}).first()
    assert (t["CD3_weak"], t["CD3_strong_cut"]) == (9.0, 9.0)


@pytest.mark.parametrize("on,strong,expect", [
    ([], [], ("Other", 0.2)), (["CD19"], [], ("B cell", 0.55)), (["CD68"], ["CD68"], ("Macrophage", 0.7)),
    (["CD3"], [], ("T cell", 0.6)), (["CD3", "Foxp3", "CD4"], [], ("Treg", 0.75)), (["CD3", "CD8"], [], ("CD8 T", 0.7)),
    (["CD3", "CD19"], ["CD19"], ("B cell", 0.7)), (["CD3", "CD19"], ["CD19", "CD3"], ("T cell", 0.7))])
def test_retype_rules(spark, on, strong, expect):
    row = {f"{m}_pos": int(m in on) for m in C.POSITIVE_MARKERS} | {f"{m}_strong": int(m in strong) for m in C.POSITIVE_MARKERS}
    d = spark.createDataFrame([(*row.values(), 5.0, 1.0)], [*row, "DAPI", "DAPI_low"])
    r = K.retype(d).first()
    assert (r["cell_type_retyped"], r["cell_type_confidence"]) == expect
    low = K.retype(d.withColumn("DAPI", F.lit(0.5))).first()
    assert low["cell_type_confidence"] == pytest.approx(round(expect[1] * 0.7, 3))


def test_small_patches_have_null_moments(spark):
    rows = [("s", f"{n}_0_{i}", i, 0, 10 + i, {"CD3": float(i + 1)}) for n in (1, 2, 3, 4) for i in range(n)]
    f = {r["patch_id"]: r for r in P.patch_features(K.typed_cells(make_cells(spark, rows))).collect()}
    assert f["1_0"]["CD3__sd"] is None and f["1_0"]["CD3__cv"] == 0.0 and f["2_0"]["CD3__skew"] is None
    assert f["3_0"]["CD3__kurt"] is None and f["4_0"]["CD3__kurt"] == pytest.approx(-1.36)
    assert f["4_0"]["CD3__mad"] == 1.0 and f["4_0"]["CD3__iqr"] == pytest.approx(1.5)
    assert f["3_0"]["type_count__CD8 T"] == 0 and f["4_0"]["n_cells"] == 4


def test_column_count_with_all_variances(spark):
    d = make_cells(spark, [("s", f"0_0_{i}", i, 0, 10, {"CD3": float(i)}) for i in range(6)])
    d = d.withColumns({f"{m}_var": F.col(m) * 2 for m in C.MARKERS})
    assert len(P.patch_features(K.typed_cells(d)).columns) - 2 == 178


@pytest.mark.parametrize("split", [False, True])
def test_quantiles_both_ways(spark, split):
    d = spark.createDataFrame([("a", float(v % 17)) for v in range(300)] + [("b", 5.0), ("b", None), ("c", None)], "k string, v double")
    got = {r["k"]: r["v_q"] for r in quantiles(d, ["k"], ["v"], [0.1, 0.5, 0.93], split=split).collect()}
    import numpy as np
    assert got["a"] == pytest.approx(list(np.quantile([v % 17 for v in range(300)], [0.1, 0.5, 0.93])))
    assert got["b"] == [5.0, 5.0, 5.0]


def test_split_follows_the_session_limit(spark):
    d = spark.range(400).selectExpr("'hot' as k", "id % 50 as v", "id")
    spark.conf.set("spark.celltable.maxGroupRows", "100")
    try:
        r = prefix_agg(d, ["k"], ["id"], F.lit(1), "c").agg(F.max("c"), F.sum("c")).first()
        assert tuple(r) == (400, 400 * 401 // 2)
        ranks = {x["v"]: x["rank"] for x in avg_rank(d, ["k"], "v").select("v", "rank").distinct().collect()}
        assert ranks == {v: 8 * v + 4.5 for v in range(50)}
    finally:
        spark.conf.set("spark.celltable.maxGroupRows", str(GROUP_LIMIT))


def test_patch_features_same_when_split(spark):
    d = K.typed_cells(make_cells(spark, [("s", f"{i % 3}_0_{i}", i, 0, 10 + i % 7, {"CD3": float(i % 11), "CD8": float(i % 5)}) for i in range(60)]))
    a = [tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
         for s in (False, True) for r in P.patch_features(d, split=s).orderBy("patch_id").collect()]
    assert a[:3] == a[3:]


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="missing columns"):
        K.clean_cells(spark.range(1))


def test_edge_bin_boundaries(spark):
    d = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.95,), (1.0,)], "v double")
    want = [int(round((v - math.fmod(v, 0.1)) / 0.1)) for v in (0.0, 0.05, 0.1, 0.95, 1.0)]
    assert [r[0] for r in d.select(C.tenth_bin("v")).collect()] == want


def test_bad_magnification_fails(spark):
    with pytest.raises(Exception, match="no pixel size"):
        spark.range(1).select(C.magnification_to_microns(F.lit(33))).collect()
