import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltable.operators import graph as G, graph_kernels as GK, segmentation as SEG, spatial as S

KEYS = ["slide_id", "patch_id"]


def graph(spark, shapes):
    """shapes: {patch: (node count, [(a, b[, length])])}"""
    n = [("s", p, f"n{i:02}") for p, (k, _) in shapes.items() for i in range(k)]
    e = [("s", p, f"n{min(x[0], x[1]):02}", f"n{max(x[0], x[1]):02}", float(x[2]) if len(x) > 2 else 1.0)
         for p, (_, es) in shapes.items() for x in es]
    nodes = spark.createDataFrame(n, "slide_id string, patch_id string, cell_id string")
    edges = spark.createDataFrame(e, "slide_id string, patch_id string, src string, dst string, dist double")
    return nodes, edges.withColumn("weight", F.lit(1.0) / F.col("dist"))


PATH5 = (5, [(i, i + 1) for i in range(4)])
STAR6 = (6, [(0, i) for i in range(1, 6)])
K5 = (5, list(itertools.combinations(range(5), 2)))
TWO_K4 = (8, [*itertools.combinations(range(4), 2), *itertools.combinations(range(4, 8), 2), (3, 4)])


@pytest.fixture(scope="module")
def shapes(spark):
    return graph(spark, {"path": PATH5, "star": STAR6, "full": K5, "two": TWO_K4, "lone": (1, []),
                         "split": (5, [(0, 1), (2, 3)])})


@pytest.mark.parametrize("small", [200_000, 0])
def test_components_both_ways(spark, shapes, small):
    comp = G.components(*shapes, KEYS, small=small)
    got = {r["patch_id"]: (r["n_components"], r["lcc_frac"], r["lcc"]) for r in G.component_stats(comp, KEYS).collect()}
    assert got["path"] == (1, 1.0, "n00") and got["lone"] == (1, 1.0, "n00")
    assert got["split"] == (3, 0.4, "n00")


def test_long_chain_by_star_rounds(spark):
    n, e = graph(spark, {"p": (90, [(i, i + 1) for i in range(89)])})
    assert G.components(n, e, KEYS, small=0).select("component").distinct().count() == 1


def test_closed_form_centralities(shapes):
    n, e = shapes
    f = {r["patch_id"]: r for r in GK.path_features(n, e, G.components(n, e)).collect()}
    assert f["path"]["diameter_lcc"] == 4 and f["path"]["avg_shortest_path_lcc"] == pytest.approx(2.0)
    assert f["path"]["bet_mean"] == pytest.approx((0 + .5 + 2 / 3 + .5 + 0) / 5)
    assert f["star"]["bet_mean"] == pytest.approx(1 / 6) and f["star"]["clo_median"] == pytest.approx(5 / 9)
    assert f["full"]["diameter_lcc"] == 1 and f["full"]["eig_mean"] == pytest.approx(1 / math.sqrt(5))
    assert f["lone"]["diameter_lcc"] is None


def leading(edges, weight=None):
    import pandas as pd
    pdf = pd.DataFrame(edges, columns=["src", "dst"])
    ids, tail, head, order, starts = GK._arcs(pdf)
    w = np.ones(len(tail)) if weight is None else np.concatenate([weight, weight])[order]
    return GK._leading_vector(len(ids), tail, head, starts, w)


def test_leading_vector_of_chains_and_grids():
    for n in (2, 3, 50, 64, 65, 2000, 8000):
        want = np.sin(np.pi * np.arange(1, n + 1) / (n + 1))
        assert np.abs(leading([(i, i + 1) for i in range(n - 1)]) - want / np.linalg.norm(want)).max() < 1e-9
    a, b = 70, 40
    grid = [(i * b + j, i * b + j + 1) for i in range(a) for j in range(b - 1)] + [(i * b + j, i * b + j + b) for i in range(a - 1) for j in range(b)]
    want = np.outer(np.sin(np.pi * np.arange(1, a + 1) / (a + 1)), np.sin(np.pi * np.arange(1, b + 1) / (b + 1))).reshape(-1)
    assert np.abs(leading(grid) - want / np.linalg.norm(want)).max() < 1e-9


def test_leading_vector_of_weighted_graphs():
    rng = np.random.default_rng(8)
    for n in (5, 40, 150):
        edges = [(i, int(rng.integers(0, i))) for i in range(1, n)] + [(int(a), int(b)) for a, b in rng.integers(0, n, (2 * n, 2)) if a != b]
        w = rng.random(len(edges)) + 0.01
        m = np.zeros((n, n))
        for (a, b), x in zip(edges, w):
            m[a, b] += x
            m[b, a] += x
        v = np.linalg.eigh(m)[1][:, -1]
        assert np.abs(leading(edges, w) - v * np.sign(v.sum())).max() < 1e-9


def test_source_shares_add_up(shapes, monkeypatch):
    n, e = shapes
    comp = G.components(n, e)
    whole = GK.path_features(n, e, comp).orderBy("patch_id").collect()
    monkeypatch.setattr(GK, "SOURCES_PER_TASK", 2)
    parts = GK.path_features(n, e, comp).orderBy("patch_id").collect()
    for a, b in zip(whole, parts):
        assert [x if isinstance(x, (str, type(None))) else pytest.approx(x) for x in a] == list(b)


def test_coincident_cells_do_not_loop(spark):
    n, e = graph(spark, {"p": (4, [(0, 1, 1e-12), (1, 2, 1), (0, 2, 1), (2, 3, 1)])})
    e = e.withColumn("dist", F.when(F.col("dist") < 1e-6, 0.0).otherwise(F.col("dist")))
    assert GK.path_features(n, e, G.components(n, e)).first()["diameter_lcc"] == 2


def test_communities_of_two_cliques(shapes):
    f = {r["patch_id"]: r for r in GK.community_features(*shapes).collect()}
    assert f["two"]["comm_n"] == 2 and f["two"]["comm_max_frac"] == 0.5 and f["two"]["comm_entropy"] == pytest.approx(1.0)
    assert f["two"]["modularity"] == pytest.approx(2 * (6 / 13 - 0.25))
    assert f["lone"]["comm_n"] is None


def test_clustering(shapes):
    c = {r["patch_id"]: r["clustering_avg"] for r in G.clustering(*shapes).collect()}
    assert c["full"] == pytest.approx(1.0) and c["star"] == 0.0 and c["lone"] == 0.0


def test_degrees_of_star(shapes):
    d = {r["patch_id"]: r for r in G.degree_stats(*shapes).collect()}
    assert d["star"]["deg_max"] == 5.0 and d["star"]["deg_top1pct_mean"] == 5.0 and d["lone"]["deg_mean"] == 0.0


def points(spark, xy):
    return spark.createDataFrame([("s", "p", f"c{i:03}", float(x), float(y)) for i, (x, y) in enumerate(xy)],
                                 "slide_id string, patch_id string, cell_id string, x double, y double")


def test_radius_boundary_and_brute_force(spark):
    rng = np.random.default_rng(1)
    xy = [(0, 0), (40, 0), (40.001, 40), (0, 0), *map(tuple, rng.integers(-300, 300, (150, 2)))]
    got = {(r["src"], r["dst"]) for r in S.radius_edges(points(spark, xy)).collect()}
    want = {(f"c{i:03}", f"c{j:03}") for i, j in itertools.combinations(range(len(xy)), 2)
            if (xy[i][0] - xy[j][0]) ** 2 + (xy[i][1] - xy[j][1]) ** 2 <= 1600}
    assert got == want and ("c000", "c001") in got and ("c000", "c003") in got


def test_knn_brute_force(spark):
    rng = np.random.default_rng(2)
    xy = [tuple(map(float, p)) for p in rng.integers(0, 1000, (80, 2))] + [(5000.0, 5000.0)]
    got = {(r["src"], r["dst"]) for r in S.knn_edges(points(spark, xy), k=3).collect()}
    want = set()
    for i in range(len(xy)):
        near = sorted((math.dist(xy[i], xy[j]), j) for j in range(len(xy)) if j != i)[:3]
        want |= {(f"c{min(i, j):03}", f"c{max(i, j):03}") for _, j in near}
    assert got == want


def test_greedy_selection_equals_sequential(spark):
    rng = np.random.default_rng(3)
    n, pairs = 60, set()
    while len(pairs) < 110:
        a, b = sorted(rng.integers(0, 60, 2).tolist())
        if a != b:
            pairs.add((a, b))
    nodes = spark.createDataFrame([("s", i) for i in range(n)], "slide_id string, vec_id bigint")
    edges = spark.createDataFrame([("s", a, b) for a, b in pairs], "slide_id string, src bigint, dst bigint")
    got = {r["node"] for r in G.select_superpatches(nodes, edges).collect()}
    adj = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)}
    live, want = set(range(n)), set()
    tie = {r[0]: r[1] for r in nodes.select("vec_id", F.xxhash64("vec_id")).collect()}
    for i in sorted(range(n), key=lambda k: (len(adj[k]), tie[k], k), reverse=True):
        if i in live:
            want.add(i)
            live -= adj[i] | {i}
    assert got == want


def test_hungarian_against_all_permutations():
    rng = np.random.default_rng(4)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        c = rng.random((n, m))
        i, j = SEG.hungarian(c)
        small, big = (c, m) if n <= m else (c.T, n)
        best = min(sum(small[r, q] for r, q in enumerate(p)) for p in itertools.permutations(range(big), min(n, m)))
        assert c[i, j].sum() == pytest.approx(best)


def label_px(spark, rows):
    return spark.createDataFrame([(0, y, x, t, p) for y, r in enumerate(rows) for x, (t, p) in enumerate(r)],
                                 "img int, y int, x int, true_id int, pred_id int")


def test_scores_of_identical_and_split_maps(spark):
    same = label_px(spark, [[(1, 1)] * 3 + [(0, 0)] + [(2, 2)] * 3])
    r = SEG.instance_scores(same).first()
    assert [round(r[c], 5) for c in ("dice", "aji", "dq", "pq", "aji_plus")] == [1.0, 1.0, 1.0, 1.0, 1.0]
    split = label_px(spark, [[(1, 1)] * 2 + [(1, 2)] * 2])
    assert SEG.panoptic(split).first()["tp"] == 0  # IoU is exactly one half
    assert SEG.panoptic(split, 0.4).first()["tp"] == 1
    empty = label_px(spark, [[(1, 0)] * 4])
    assert SEG.aji(empty).first()["aji"] == 0.0 and SEG.aji_plus(empty).first()["aji_plus"] == 0.0


def test_regions_by_connectivity(spark):
    d = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 5, 5)], "img int, y int, x int")
    assert SEG.label_regions(d, 8).select("region").distinct().count() == 2
    assert SEG.label_regions(d, 4).select("region").distinct().count() == 3
    assert SEG.label_regions(d, 8, min_size=2).count() == 2


def _regions(px, connectivity, label):
    """{(img, y, x): (region, size)} by search from pixel to pixel."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if abs(a) + abs(b) in ((1, 2) if connectivity == 8 else (1,))]
    out = {}
    for start in sorted(px):
        if start in out:
            continue
        part, todo = {start}, [start]
        while todo:
            g, y, x = todo.pop()
            near = [(g, y + a, x + b) for a, b in steps if (g, y + a, x + b) in px]
            near = [p for p in near if p not in part and (not label or px[p] == px[g, y, x] is not None)]
            part |= set(near)
            todo += near
        out |= {p: (min(part)[1] * (1 << 24) + min(part)[2], len(part)) for p in part}
    return out


def test_regions_are_linked_by_runs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    px = {(g, int(y), int(x)): int(t) for g in (1, 2) for (y, x), t in np.ndenumerate(rng.integers(0, 3, (14, 300))) if t or y == 7}
    d = spark.createDataFrame([(*p, t) for p, t in px.items()], "img int, y int, x int, t int")
    seen, whole = [], SEG.components
    monkeypatch.setattr(SEG, "components", lambda n, e, *a: seen.append((n.count(), e.count())) or whole(n, e, *a))
    for c in (4, 8):
        for label in (None, "t"):
            got = SEG.label_regions(d, c, same=label).collect()
            assert {(r.img, r.y, r.x): (r.region, r["size"]) for r in got} == _regions(px, c, label) and len(got) == len(px)
    runs = sum((g, y, x - 1) not in px for g, y, x in px)
    assert seen[0][0] == runs and seen[0][1] <= 2 * runs < len(px)


def test_regions_of_odd_pixels(spark):
    d = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1), (1, 0, 1, 1), (1, 0, 1, 1), (1, 1, -1, None), (1, 1, 0, None), (1, None, 3, 1), (1, 4, None, 1)],
                              "img int, y int, x int, t int")
    rows = lambda r: sorted((p.y, p.x, p.region, p["size"]) for p in r.collect())
    assert rows(SEG.label_regions(d, 4)) == [(0, 0, 0, 6), *[(0, 1, 0, 6)] * 3, (1, -1, 0, 6), (1, 0, 0, 6)]
    assert rows(SEG.label_regions(d, 4, same="t")) == [(0, 0, 0, 4), *[(0, 1, 0, 4)] * 3, (1, -1, 2**24 - 1, 1), (1, 0, 2**24, 1)]
    assert SEG.label_regions(d.filter("x > 9")).count() == 0
