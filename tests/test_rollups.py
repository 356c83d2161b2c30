"""Means over images and merged super-patches, against plain loops."""

import pytest

from celltable.operators import graph as G, imaging as I, segmentation as S


def label_pixels(spark):
    rows = []
    for img in (1, 2):
        for y in range(8):
            for x in range(8):
                true = 1 + x // 4 if y < 6 else 0
                pred = 1 + (x + img) // 4 if y < 5 + img else 0
                rows.append((img, y, x, true, pred))
    return spark.createDataFrame(rows, "img int, y int, x int, true_id int, pred_id int"), rows


def test_mean_scores_hold_all_six(spark):
    px, _ = label_pixels(spark)
    each = S.instance_scores(px).collect()
    got = S.mean_scores(S.instance_scores(px)).first()
    assert got["n_images"] == 2
    for c in ("dice", "aji", "aji_plus", "dq", "sq", "pq"):
        assert got[c] == pytest.approx(sum(r[c] for r in each) / 2)
    assert S.mean_scores(S.instance_scores(px.limit(0))).first()["n_images"] == 0


def test_pooled_scalars_pool_the_pixels(spark):
    px, rows = label_pixels(spark)
    d = px.selectExpr("*", "true_id as true_type", "pred_id as pred_type", "true_id/7 as true_h", "pred_id/7 as pred_h", "0.0 as true_v", "2.0 as pred_v")
    got = S.seg_scalars(d, [1], keys=[], maps=["h", "v"]).collect()
    assert len(got) == 1
    both = sum(r[3] > 0 and r[4] > 0 for r in rows)
    assert got[0]["dice"] == pytest.approx(2 * both / (sum(r[3] > 0 for r in rows) + sum(r[4] > 0 for r in rows)))
    assert got[0]["mse_hv"] == pytest.approx((sum((r[3] / 7 - r[4] / 7) ** 2 for r in rows) / len(rows) + 4) / 2)


def test_quality_counts_every_pair(spark):
    rows = [(img, y, x, (x * 9 + y) % 256, 5, 6, (x * 9 + y + img) % 256, 5, 6, "a" if img < 3 else "b") for img in range(5) for y in range(8) for x in range(8)]
    px = spark.createDataFrame(rows, "img int, y int, x int, r int, g int, b int, r2 int, g2 int, b2 int, marker string")
    got = {r["marker"]: r for r in I.quality_by_group(px, ["marker"]).collect()}
    assert got["a"]["n_images"] == 3 and got["b"]["n_images"] == 2
    one = {r["img"]: r["psnr"] for r in I.pair_quality(px).collect()}
    assert one[0] is None and got["a"]["psnr"] == pytest.approx((one[1] + one[2]) / 2)


def test_selected_superpatches_average_their_neighbours(spark):
    nodes = [(i, "s", float(i), 0.0, [float(i), 1.0]) for i in range(6)]
    bags = spark.createDataFrame(nodes, "vec_id bigint, slide_id string, x double, y double, feature array<double>")
    edges = [(0, 1), (1, 2), (1, 3), (4, 5)]
    pairs = spark.createDataFrame([("s", a, b) for a, b in edges], "slide_id string, src bigint, dst bigint")
    kept = G.select_superpatches(bags, pairs)
    got = {r["node"]: r for r in G.merge_superpatches(bags, pairs, kept).collect()}
    assert 1 in got and len(got) == 2
    for n, r in got.items():
        near = {n} | {b for a, b in edges if a == n} | {a for a, b in edges if b == n}
        assert r["n_members"] == len(near) and r["feature"][0] == pytest.approx(sum(near) / len(near))
