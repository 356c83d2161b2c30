"""Plans that must hold when the tables grow: what is sent through the driver, and how often rows are shuffled."""

import pytest
from pyspark.sql import functions as F

from celltable.plans.views import Views

D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_views_are_not_taken_for_small_tables(spark):
    v = Views(spark, D)
    for name, key in (("raster", "slide_id"), ("labels_px", "img"), ("rgb_px", "img"), ("rings", "slide_id")):
        px = getattr(v, name)
        assert "BroadcastHashJoin" not in plan(px.join(px.groupBy(key).count(), key)), name


def test_seam_pixels_are_not_sent_through_the_driver(spark):
    import __spark_entry__ as e
    semi = [line for line in plan(e.queries()["seam_reconcile"](spark, D)).splitlines() if "LeftSemi" in line]
    assert semi and all("SortMergeJoin" in line for line in semi)


def test_pair_join_copies_only_points_near_a_border(spark):
    from celltable.operators.spatial import pairs_within
    pts = spark.sql("select 1 as g, id as i, cast(id % 100 * 7 as double) as x, cast(floor(id / 100) * 7 as double) as y from range(10000)")
    p = pairs_within(pts, ["g"], "i", 10.0)
    # four neighbours at 7 and four at 9.9 of every inner point
    assert p.count() == 2 * 99 * 100 + 2 * 99 * 99
    # sides of 40 copy a quarter of the points per side; copies of one row to five buckets were 50,000 rows
    copies = p._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array" in copies


def test_edges_carry_node_columns_without_a_join(spark):
    from celltable.operators import spatial as S
    pts = spark.createDataFrame([("s", "p", c, float(i), 0.0, g) for i, (c, g) in enumerate(zip("abc", "TBT"))],
                                "slide_id string, patch_id string, cell_id string, x double, y double, grp string")
    ends = S.radius_edges(pts, radius=1.0, carry=("grp",))
    assert sorted((r.src, r.dst, r.grp_src, r.grp_dst) for r in ends.collect()) == [("a", "b", "T", "B"), ("b", "c", "B", "T")]
    assert plan(ends).count("Join") == 1


def test_small_graphs_share_a_call_and_large_ones_agree(spark):
    from celltable.operators import graph as G, spatial as S
    pts = spark.sql("""select cast(id % 40 as string) as slide_id, 'p' as patch_id, cast(id as string) as cell_id,
        cast(id * 37 % 101 as double) as x, cast(id * 53 % 97 as double) as y from range(2000)""")
    e = S.radius_edges(pts, radius=15.0)
    one = {r.slide_id: round(r.clustering_avg, 9) for r in G.clustering(pts, e).collect()}
    assert one == {r.slide_id: round(r.clustering_avg, 9) for r in G.clustering(pts, e, small=5).collect()}
    named = lambda d: sorted(map(tuple, d.collect()))
    assert named(G.components(pts, e)) == named(G.components(pts, e, small=5))


def test_parts_of_an_overlap_graph_share_task_calls(spark):
    from celltable.operators.segmentation import unique_pairs
    o = spark.createDataFrame([(1, 1, 1, 5, 9, 0.5), (1, 2, 2, 5, 9, 0.6), (1, 2, 3, 5, 9, 0.5), (1, 3, 2, 5, 9, 0.5), (2, 1, 1, 1, 2, 0.4)],
                              "img int, t int, p int, inter int, `union` int, iou double")
    got = unique_pairs(o)
    assert sorted((r.img, r.t, r.p) for r in got.collect()) == [(1, 1, 1), (1, 2, 3), (1, 3, 2), (2, 1, 1)]
    assert "_block" in plan(got)


def test_nearest_neighbours_are_found_across_buckets_and_shuffled_once(spark):
    from celltable.operators.spatial import knn_edges
    pts = spark.sql("select 's' as g, id as i, cast(id * 37 % 211 as double) as x, cast(id * 53 % 199 as double) as y from range(300)")
    rows = [(r.i, r.x, r.y) for r in pts.collect()]
    want = set()
    for i, x, y in rows:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in rows if j != i)[:3]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    got = knn_edges(pts, ["g"], 3, "i", start_radius=5.0)
    assert {(r.src, r.dst) for r in got.collect()} == want
    assert "Join" not in plan(got)


def test_patch_tables_move_the_cells_once(spark):
    import __spark_entry__ as e
    # cuts, patch statistics, deviations and slide moments all sit behind the one shuffle by slide
    for name in ("patch_features", "slide_rollup"):
        assert "Join" not in plan(e.queries()[name](spark, D)), name


def test_patch_table_is_the_same_with_and_without_a_hot_slide(spark):
    from celltable.operators import cells as K, patches as P
    from celltable.operators.skew import GROUP_LIMIT
    from celltable.plans import q_cells
    d = P.with_patch(q_cells.cells(Views(spark, D))).filter("slide_id < '5' or slide_id is null")
    d = d.withColumn("slide_id", F.when(F.col("slide_id") != "1", F.col("slide_id"))).withColumn("CD8", F.when(F.col("slide_id") != "2", F.col("CD8")))

    def rows():
        f = P.patch_features(K.typed_by_slide(d)).orderBy("slide_id", "patch_id")
        return [tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in f.collect()]

    one = rows()
    spark.conf.set("spark.celltable.maxGroupRows", "100")
    try:
        assert len(one) > 9 and one == rows()
    finally:
        spark.conf.set("spark.celltable.maxGroupRows", str(GROUP_LIMIT))


def test_spread_quantiles_move_each_row_once(spark):
    from celltable.operators import skew
    d = spark.sql("""select case when id % 10 < 7 then 'hot' when id % 10 > 7 then concat('k', id % 200) end as k,
        case when id % 3 = 0 then 5.0 else cast(id * 7919 % 10007 as double) end as v, case when id % 10 < 8 then cast(-id % 977 as double) end as w from range(30000)""")
    probs, was = [0.0, 0.1, 0.5, 0.93, 1.0], (skew.SLICE_ROWS, skew.GUIDES)
    named = lambda q: {r.k: (r.v_q, r.w_q) for r in q.collect()}
    want = named(skew.quantiles(d, ["k"], ["v", "w"], probs, split=False))
    try:
        # slices of about 2,000 rows name at most 64 values, so the hot keys need their second step
        skew.SLICE_ROWS, skew.GUIDES = 2000, 64
        got = skew.quantiles(d, ["k"], ["v", "w"], probs, split=True)
        assert "Generate explode" not in plan(got) and "Window" not in plan(got)
        got = named(got)
    finally:
        skew.SLICE_ROWS, skew.GUIDES = was
    assert set(got) == set(want)
    for k, pair in want.items():
        for a, b in zip(pair, got[k]):
            assert a == b or a == pytest.approx(b, rel=1e-12), k


def test_mask_pixels_are_not_joined(spark):
    from celltable.operators.tiling import polygon_mask
    slides = spark.createDataFrame([("a", 40, 50), ("a", 70, 20), ("b", 5, 5)], "slide_id string, w int, h int")
    ring = [(0.0, 0.0), (60.0, 0.0), (60.0, 45.0), (15.0, 45.0), (15.0, 15.0), (0.0, 15.0)]
    hole = [(25.0, 25.0), (35.0, 25.0), (35.0, 35.0), (25.0, 35.0)]
    rings = spark.createDataFrame([("a", 1, 0, ring), ("a", 1, 1, hole)], "slide_id string, tissue_id int, ring int, pts array<struct<x: double, y: double>>")
    mask = polygon_mask(slides, rings, 10)
    # rows of 4 pixels down to 50 and of 7 down to 20; 15 and 45 lie on pixel centres, so on the outline, which is outside
    want = {(0, x) for x in range(6)} | {(y, x) for y in (1, 2, 3) for x in range(2, 6 if y == 1 else 4)} - {(2, 2), (2, 3), (3, 2), (3, 3)}
    got = {(r.y, r.x) for r in mask.collect()}
    assert {(0, x) for x in range(6)} <= got and (4, 2) not in got and (1, 1) not in got and (3, 3) not in got
    assert got <= want | {(2, 2), (3, 2), (2, 3)} and {(1, x) for x in range(2, 6)} <= got
    text = plan(mask)
    # pixels appear above the join, not under it
    assert text.index("explode") < text.index("Join")


def test_nuclei_files_do_not_grow_in_number_with_the_slides(spark):
    import os

    import __spark_entry__ as e
    d = e.queries()["nuclei_rows"](spark, D)
    folders = {os.path.dirname(f) for f in d.inputFiles()}
    assert len(folders) == 1 and len(d.inputFiles()) < d.select("slide_id").distinct().count()
    assert d.count() == Views(spark, D).lineitem.count()
    # a slide lies in one file
    assert d.select("slide_id", F.input_file_name()).distinct().count() == d.select("slide_id").distinct().count()


def test_thumbnail_needs_no_cell_ids_and_no_sort(spark):
    from celltable.operators.tiling import cell_raster
    d = spark.createDataFrame([("s", "c9", "A", 10.0, 10.0, 9.0), ("s", "c1", "B", 12.0, 9.0, 9.0), ("s", "c2", "Z", 12.0, 9.0, 9.0), ("s", "c3", "Z", 200.0, 9.0, 9.0),
                               ("s", "c4", None, 100.0, 9.0, 9.0), ("s", "c5", "A", 64.0, 64.0, 3.2e4)],
                              "slide_id string, cell_id string, cell_type string, x double, y double, nucleus_area double")
    got = cell_raster(d, ["A", "B"], 256, 256)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    # a radius of 3.15 pixels about (2, 2), over whose corner B wins
    disc = {(y, x): "A" for y in range(8) for x in range(8) if (y - 2) ** 2 + (x - 2) ** 2 <= 3.2e4 / 3.141592653589793 / 1024}
    assert {(r.ty, r.tx): r.cell_type for r in got.collect()} == disc | {(0, 0): "B"}


def _lumps(spark, groups=7, n=60):
    import random
    r = random.Random(3)
    rows = [(f"g{g}", f"{r.randrange(n):03d}" if g == 6 else f"{i:03d}", float(r.randrange(40)), float(r.randrange(40)))
            for g in range(groups) for i in range(n)]
    rows += [(None, "a", 1.0, 1.0), (None, "b", 1.0, 1.0), ("g1", None, 1.0, 1.0), ("g1", "z", None, 1.0), ("g2", "y", float("inf"), 1.0), ("one", "a", 0.0, 0.0)]
    return spark.createDataFrame(rows, "g string, i string, x double, y double").selectExpr("*", "concat(i, g) as w")


def test_pairs_in_a_task_are_those_of_the_bucket_join(spark):
    """Repeated ids, points at one spot, NULLs and infinities included; the points of a group move once."""
    from celltable.operators.spatial import pairs_within
    pts = _lumps(spark)
    for radius, closed in ((5.0, True), (5.0, False), (0.5, True), (100.0, True)):
        few, many = (pairs_within(pts, ["g"], "i", radius, closed, carry=("w",), small=n) for n in (2_000, 0))
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count()
    moved = few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert moved.count("Exchange") == 1 and "Join" not in moved
    of_group = few.groupBy("g", "src").count()._jdf.queryExecution().executedPlan().toString()
    assert of_group.count("Exchange") == 1


def test_nearest_in_a_task_are_those_of_the_rounds(spark):
    from celltable.operators.spatial import knn_edges
    pts = _lumps(spark)
    for k in (1, 4, 70):
        few, many = (knn_edges(pts.filter("x < 100 or x is null"), ["g"], k, "i", start_radius=9.0, small=n) for n in (2_000, 0))
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count()
    assert few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1


def test_typed_edges_and_their_sums_sit_behind_the_shuffle_by_slide(spark):
    from celltable.operators import graph as G
    from celltable.plans import q_graph as Q
    from celltable.plans.views import Views
    ends = Q.near(Q.typed_nodes(Views(spark, D)), carry=Q.ENDS, laid=True)
    for d in (ends, G.edge_profile(ends), G.edge_profile(ends, ["slide_id"])):
        text = d._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "Join" not in text


def test_graph_operators_leave_laid_edges_where_they_lie(spark):
    from celltable.operators import graph as G, graph_kernels as GK, spatial as S
    pts = spark.sql("""select cast(id % 40 as string) as slide_id, 'p' as patch_id, cast(id as string) as cell_id,
        cast(id * 37 % 101 as double) as x, cast(id * 53 % 97 as double) as y from range(1200)""")
    keys = ["slide_id", "patch_id"]
    far, e = S.radius_edges(pts, radius=15.0), S.radius_edges(pts, radius=15.0, small=2_000)
    rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    for f in (G.components, G.clustering, G.degree_stats):
        assert rows(f(pts, e, laid=keys)) == rows(f(pts, far))
    moved = G.clustering(pts, e, laid=keys).select("clustering_avg")._jdf.queryExecution().executedPlan().toString()
    assert "src" not in "".join(line for line in moved.splitlines() if "Exchange" in line)
    one = GK.path_features(pts, e, G.components(pts, e, laid=keys), laid=keys)
    assert rows(one) == rows(GK.path_features(pts, far, G.components(pts, far)))
