"""Work that is spread over tasks by rows: same results, and no more rows moved than needed."""

from pyspark.sql import functions as F

from celltable.operators import graph as G
from celltable.operators.skew import has_hot_group


def test_a_limit_of_zero_rows_is_a_limit(spark):
    assert has_hot_group(spark.range(3).withColumn("k", F.lit(1)), ["k"], 0)
    assert not has_hot_group(spark.range(3).withColumn("k", F.lit(1)), ["k"], 3)


def test_components_of_runs_meet(spark):
    # two chains per graph, cut into runs of ten edges; every link of neighbouring runs must be found
    e = spark.range(600).selectExpr("cast(id % 3 as string) as slide_id", "lpad(cast(id as string), 5, '0') as src", "lpad(cast(id + 6 as string), 5, '0') as dst")
    n = e.selectExpr("slide_id", "src as id").union(e.selectExpr("slide_id", "dst")).union(spark.createDataFrame([("9", "alone")], "slide_id string, id string")).distinct()
    got = G.components(n, e, ["slide_id"], "id", small=0, run_rows=10).collect()
    assert len(got) == 607 and all(r.component == ("alone" if r.node == "alone" else f"{int(r.node) % 6:05d}") for r in got)


def test_a_slide_of_edges_is_written_by_few_tasks(spark, tmp_path):
    from celltable.sources.writers import write_edges
    e = spark.range(4000).selectExpr("cast(id % 20 as string) as slide_id", "'0_0' as patch_id", "id as src", "id + 1 as dst").repartition(16)
    write_edges(e, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 4000
    assert len(list((tmp_path / "edges").glob("slide_id=*/*.parquet"))) <= 40


def test_small_groups_share_a_call_of_a_group_function(spark):
    import os

    import pandas as pd
    from celltable.operators.custom import apply_groups
    d = spark.range(3000).selectExpr("if(id % 1000 = 7, null, id % 1000) as k", "cast(id as double) as x")
    fn = lambda g: pd.DataFrame({"k": [g["k"].iloc[0]], "first": [g.index[0]], "top": [g["x"].max()]})
    assert "_block" in apply_groups(d, ["k"], fn, "k double, first bigint, top double")._jdf.queryExecution().analyzed().toString()
    got = {r.k: (r.first, r.top) for r in apply_groups(d, ["k"], fn, "k double, first bigint, top double").toPandas().itertuples()}
    assert len(got) == 1000 and all(f == 0 for f, _ in got.values()) and got[5.0][1] == 2005.0


def test_points_of_small_images_share_a_call(spark):
    import itertools

    import numpy as np
    from celltable.operators.segmentation import hungarian, match_points
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (3, 6), (6, 4), (0, 3)):
        c = rng.integers(0, 4, (n, m)).astype(float)
        i, j = hungarian(c)
        small = c if n <= m else c.T
        assert len(i) == min(n, m) == len(set(i)) == len(set(j))
        assert c[i, j].sum() == min(sum(small[r, p[r]] for r in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
    # both sides come from one table, as in matched_points
    pts = spark.range(400).selectExpr("cast(id % 50 as string) as image", "id", "cast(floor(id / 50) as double) * 10 as x", "0D as y", "id >= 200 as later")
    a, b = pts.filter("not later").drop("later"), pts.filter("later").withColumn("x", F.col("x") - 39).drop("later")
    got = match_points(a, b)
    assert "_block" in got._jdf.queryExecution().analyzed().toString()
    assert sorted((r.a, r.b, r.dist) for r in got.collect()) == [(i, i + 200, 1.0) for i in range(200)]


def test_only_texts_that_may_be_trusted_are_moved(spark):
    from celltable.llm.kneser_ney import with_trust
    docs = spark.range(2000).selectExpr("if(id = 3, null, cast(id as int)) as doc_id", "concat('text ', id) as text")
    trusted = spark.range(0, 4000, 10).selectExpr("id as doc_id", "true as trusted")
    got = with_trust(docs, trusted)
    assert {r.text for r in got.filter("trusted").collect()} == {f"text {i}" for i in range(0, 2000, 10)}
    assert got.count() == 2000 and got.select("text").distinct().count() == 2000
    assert with_trust(docs, trusted.limit(0)).filter("not trusted").count() == 2000


def test_parts_of_slides_come_in_many_files(spark, monkeypatch):
    from celltable.plans import q_records
    from celltable.plans.views import Views
    boxes = []

    def watch(s, box, out, *rest):
        boxes.append(box)
        s.range(0).withColumn("batch", F.lit(0)).write.mode("overwrite").parquet(out)

    monkeypatch.setattr(q_records.ST, "watch_parts", watch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        q_records.incremental_composition(Views(spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(boxes[0]).select("slide_id", "part", F.input_file_name().alias("file")).distinct()
    # a part of a slide stays one file; a delivery is more than one file per part number
    assert files.groupBy("slide_id", "part").count().filter("count > 1").isEmpty() and files.select("file").distinct().count() > 3


def test_communities_of_small_graphs_share_a_call(spark):
    from celltable.operators.graph_kernels import louvain
    # two triangles joined by one weak edge, fifty times
    e = spark.sql("select cast(g.id as string) as slide_id, src, dst, w as weight from range(50) g, values (1,2,1D),(2,3,1D),(1,3,1D),(4,5,1D),(5,6,1D),(4,6,1D),(3,4,0.1D) v(src,dst,w)")
    got = louvain(e, ["slide_id"])
    assert "_block" in got._jdf.queryExecution().analyzed().toString()
    parts = got.groupBy("slide_id", "community").agg(F.sort_array(F.collect_list("node")).alias("m")).collect()
    assert len(parts) == 100 and {tuple(r.m) for r in parts} == {(1, 2, 3), (4, 5, 6)}
