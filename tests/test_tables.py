import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltable.functions import columns as C
from celltable.functions.special import beta_inc
from celltable.operators import attention as A, embeddings as E, learning as L, survival as S, tiling as T
from celltable.sources import readers as IN, writers as OUT
from celltable.streaming import inbox as ST


def brute_c(rows, tol=1e-8):
    comp = conc = tied = 0
    for ti, ei, ri in rows:
        for tj, ej, rj in rows:
            if ei == 1 and (tj > ti or (tj == ti and ej == 0)):
                comp += 1
                conc += rj < ri - tol
                tied += abs(ri - rj) <= tol
    return comp, conc, tied


@pytest.mark.parametrize("split", [False, True])
def test_concordance_brute_force(spark, split):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(1, 20)), int(rng.integers(0, 2)), float(rng.integers(0, 9))) for _ in range(120)]
    d = spark.createDataFrame(rows, "time double, event int, risk double")
    r = S.c_index(d, split=split).first()
    assert (r["comparable"], r["concordant"], r["tied"]) == brute_c(rows)


def test_concordance_without_events(spark):
    d = spark.createDataFrame([(1.0, 0, 1.0), (2.0, 0, 2.0)], "time double, event int, risk double")
    assert S.c_index(d).first()["c_index"] is None


def test_time_bins_are_left_closed(spark):
    d = spark.createDataFrame([(float(t), 1) for t in (1, 2, 3, 4, 5)] + [(9.0, 0)], "time double, event int")
    assert [r["bin"] for r in S.discretize_time(d).orderBy("time").collect()] == [0, 1, 2, 3, 3, 3]


def test_early_stop(spark):
    m = [1, 2, 9, 9, 8, 8, 8, 8, 8, 8]
    d = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(m)], "run string, epoch int, metric double")
    r = S.early_stop(d, ["run"], patience=3, warmup=2, stop_epoch=6).orderBy("epoch").collect()
    assert [x["wait"] for x in r] == [0, 0, 1, 2, 3, 4, 5, 6] and [x["epoch"] for x in r if x["stop"]] == [7, 8, 9]


@pytest.mark.parametrize("alpha", [0.95, 0.5])
def test_moving_average_over_blocks(spark, alpha):
    v = np.random.default_rng(6).random(1500)
    d = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "run string, i int, v double")
    got = [r["ema"] for r in S.ema(d, ["run"], ["i"], "v", alpha).orderBy("i").collect()]
    want, cur = [], v[0]
    for i, x in enumerate(v):
        cur = x if i == 0 else alpha * cur + (1 - alpha) * x
        want.append(cur)
    assert np.allclose(got, want, rtol=1e-10)


def test_beta_and_correlation(spark):
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248) and beta_inc(0.5, 0.5, 0.5) == pytest.approx(0.5)
    d = spark.createDataFrame([(float(i), float(i * i), 3.0) for i in range(12)], "attn_mean double, sq double, flat double")
    r = {x["feature"]: x for x in A.correlate(d).collect()}
    assert r["sq"]["spearman_r"] == pytest.approx(1.0) and r["flat"]["pearson_r"] is None
    assert r["sq"]["pearson_r"] == pytest.approx(np.corrcoef(range(12), np.arange(12) ** 2)[0, 1])
    few = A.correlate(d.limit(5)).collect()
    assert all(x["spearman_r"] is None for x in few)


def test_attention_outside_and_bad_ids(spark):
    p = spark.createDataFrame([("s", "0_0"), ("s", "9999_0")], "slide_id string, patch_id string")
    px = spark.createDataFrame([("s", y, x, float(x)) for y in range(4) for x in range(4)], "slide_id string, ay int, ax int, value double")
    r = {x["patch_id"]: x for x in A.attention_stats(A.patch_xy(p), px, 128).collect()}
    assert r["0_0"]["attn_mean"] == 0.5 and r["9999_0"]["attn_mean"] is None
    assert A.patch_xy(p.filter("patch_id = '9999_0'"), order="xy").first()["px"] == 9999
    with pytest.raises(Exception, match="unreadable patch_id"):
        A.patch_xy(p.withColumn("patch_id", F.lit("a_b"))).collect()


def test_frechet_and_rank(spark):
    rng = np.random.default_rng(7)
    a, b = rng.random((50, 3)), rng.random((60, 3)) + 1
    df = lambda m: spark.createDataFrame([(r.tolist(),) for r in m], "feature array<double>")
    assert E.frechet(df(a), df(a)) == pytest.approx(0.0, abs=1e-9)
    mu, cov = E.moments(df(a))
    assert np.allclose(mu, a.mean(0)) and np.allclose(cov, np.cov(a.T))
    got = E.frechet_from_moments(np.zeros(2), np.diag([4.0, 9.0]), np.ones(2), np.diag([1.0, 1.0]))
    assert got == pytest.approx(2 + (2 - 1) ** 2 + (3 - 1) ** 2)
    assert E.frechet(df(a), df(b)) > 2
    assert E.smooth_rank(df(np.eye(4))) == pytest.approx(4.0, abs=0.01)


def test_sampling_sizes(spark):
    b = spark.createDataFrame([(s, i) for s, n in (("a", 9), ("b", 1)) for i in range(n)], "slide_id string, vec_id bigint")
    half = {r["slide_id"]: r["count"] for r in L.half_sample(b, 1).groupBy("slide_id").count().collect()}
    assert half == {"a": 4, "b": 1}
    bag = {r["slide_id"]: r["count"] for r in L.bag_sample(b, 5, 1).groupBy("slide_id").count().collect()}
    assert bag == {"a": 5, "b": 5}
    assert L.repeat_sample(b, 4, 3, 0, "vec_id").count() == 12
    w = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "id0 bigint, w double")
    hits = {r["id0"]: r["count"] for r in L.weighted_draw(w, "w", 4000, 3, "id0").groupBy("id0").count().collect()}
    assert sum(hits.values()) == 4000 and 0 not in hits and 2700 < hits[2] < 3300


def test_kappa_and_auc(spark):
    c = spark.createDataFrame([(0, 0, 5), (1, 1, 3), (0, 1, 2), (2, 2, 4)], "true int, pred int, value int")
    o = np.zeros((3, 3)); o[0, 0], o[1, 1], o[0, 1], o[2, 2] = 5, 3, 2, 4
    w = np.subtract.outer(range(3), range(3)) ** 2
    want = 1 - (w * o).sum() / (w * np.outer(o.sum(1), o.sum(0)) / o.sum()).sum()
    assert L.quadratic_kappa(c).first()[0] == pytest.approx(want)
    d = spark.createDataFrame([(0, .1), (0, .4), (1, .4), (1, .8)], "y int, s double")
    assert L.roc_auc(d, "y", "s").first()["auc"] == pytest.approx(0.875)


def test_polygon_edges_are_outside(spark):
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rings = spark.createDataFrame([("s", 1, 0, False, sq(0., 10.)), ("s", 1, 1, True, sq(4., 6.)), ("s", 2, 0, False, sq(8., 20.))],
                                  "slide_id string, tissue_id int, ring int, is_hole boolean, pts array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([("s", x, y) for x, y in [(1., 1.), (5., 5.), (0., 5.), (10., 10.), (9., 9.), (0., 0.), (15., 8.)]],
                                "slide_id string, x double, y double")
    got = {(r["x"], r["y"]) for r in T.points_in_polygons(pts, rings).collect()}
    assert got == {(1., 1.), (9., 9.), (10., 10.)}
    assert T.contour_area(rings).filter("tissue_id = 1").first()["area"] == 96.0
    assert T.tissue_rings(rings, 1e9, 0).count() == 0
    assert T.slides_without_tissue(rings, 1e9).count() == rings.select("slide_id").distinct().count()


def test_delimiters_and_round_trip(spark, tmp_path):
    for sep in (",", ";", "\t"):
        f = tmp_path / f"S{ord(sep)}_cells.csv"
        f.write_text(sep.join([" cell_id", "x ", "y"]) + "\n" + sep.join(["0_0_1", "3", "none"]) + "\n")
        r = IN.read_cells(spark, str(f)).first()
        assert (r["slide_id"], r["cell_id"], r["x"], r["y"]) == (f"S{ord(sep)}", "0_0_1", "3", "none")


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"mag": None, "nuc": {"1": {
        "bbox": [[0, 0], [2, 2]], "centroid": [1.5, 1.0], "contour": [[0, 0]], "type_prob": 0.5, "type": 1}}}, indent=1))
    n = IN.read_nuclei(spark, str(tmp_path / "a.json"))
    assert n.first()["cx"] == 1.5
    types = IN.type_lookup(spark, {"0": ["none", [0, 0, 0]], "1": ["x", [1, 2, 3]]}, 2)
    assert OUT.to_qupath(n, types).first()["color"] == 66051
    (tmp_path / "types").mkdir()
    (tmp_path / "types" / "t.json").write_text('{"0": ["none", [0, 0, 0]],\n "1": ["x", [1, 2, 3]]}')
    assert IN.read_type_lookup(spark, str(tmp_path / "types"), 2).count() == 2
    OUT.write_qupath(OUT.to_qupath(n, types, ["slide_id"]), str(tmp_path / "q"), by=["slide_id"])
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "q")).first()
    assert (back["slide_id"], back["x"], back["name"], back["color"]) == ("a", "1.5", "x", "66051")
    (tmp_path / "types" / "u.json").write_text("{}")
    with pytest.raises(ValueError, match="one file"):
        IN.read_type_lookup(spark, str(tmp_path / "types"), 2)
    with pytest.raises(ValueError, match="lacks ids"):
        IN.type_lookup(spark, {"0": ["none", [0, 0, 0]]}, 2)
    with pytest.raises(ValueError):
        IN.load_params("{bad")


def test_polygon_xml_forms(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<A><Annotation><Coordinates><Coordinate X="1" Y="2"/><Coordinate X="3" Y="4"/></Coordinates></Annotation></A>')
    (tmp_path / "b.xml").write_text('<A><Regions><Region><Vertices><Vertex X="5" Y="6"/></Vertices></Region></Regions></A>')
    got = sorted((r["slide_id"], r["ord"], r["x"]) for r in IN.read_polygons(spark, str(tmp_path)).collect())
    assert got == [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 5.0)]
    (tmp_path / "c.xml").write_text("<A><B/></A>")
    with pytest.raises(ValueError, match="no polygon"):
        IN.read_polygons(spark, str(tmp_path))


def test_inbox_equals_batch_and_skips_done(spark, tmp_path):
    from celltable.operators.cells import clean_cells, typed_cells
    from celltable.operators.patches import composition_report
    from tests.test_cells import make_cells
    d = make_cells(spark, [(s, f"{i % 2}_0_{i}", i, 0, 10, {"CD3": float(i * k)}) for k, s in enumerate(["a", "b"]) for i in range(8)])
    box, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for s in ("a", "b"):
        d.filter(F.col("slide_id") == s).coalesce(1).write.mode("append").parquet(box)
        ST.watch_cells(spark, box, out, ck, d.schema)
    got = sorted(map(tuple, spark.read.parquet(out).drop("batch").collect()))
    assert got == sorted(map(tuple, composition_report(typed_cells(clean_cells(d))).collect()))
    d.filter("slide_id = 'a'").coalesce(1).write.mode("append").parquet(box)
    d.withColumn("slide_id", F.when(F.col("slide_id") == "b", "c")).dropna(subset=["slide_id"]).coalesce(1).write.mode("append").parquet(box)
    ST.watch_cells(spark, box, out, ck, d.schema)
    assert {r["slide_id"] for r in spark.read.parquet(out).collect()} == {"a", "b", "c"}
    bad = spark.read.parquet(f"{out}-errors").collect()
    assert [(r["slide_id"], r["reason"]) for r in bad] == [("a", "was processed before")]


def test_append_checks_schema(spark, tmp_path):
    p = str(tmp_path / "d")
    OUT.append_bags(spark.createDataFrame([(1,)], "a int"), p)
    with pytest.raises(ValueError, match="schema differs"):
        OUT.append_bags(spark.createDataFrame([(1,)], "a bigint"), p)


def test_lab_of_white(spark):
    r = spark.range(1).select(C.srgb_to_lab(F.lit(255), F.lit(255), F.lit(255)).alias("l")).first()["l"]
    assert r["l"] == pytest.approx(100.0, abs=0.01) and math.isclose(r["a"], 0, abs_tol=0.05)


def test_registry_is_consistent():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
