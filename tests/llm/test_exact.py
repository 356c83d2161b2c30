"""Operators with an exact definition against brute force, on rows with every edge case."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltable.llm import hilbert, jaccard_join, suffix_overlap, url_cascade
from celltable.llm.ball_tree import build_tree, scores, top_k
from celltable.llm.jaccard_join import common_counts, frequency_class, index_entries, jaccard_groups, one_of_each, prefix_length, spanning_links
from celltable.llm.substring_dedup import ladder, remove_repeats
from celltable.llm.words import from_planes, pack, planes, split_words, text_bytes, unpack, windows, byte_classes, lower_table

from .conftest import SCHEMA, document, prose

SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_match_the_patterns():
    import pyarrow as pa
    texts = ["Ab c\u00a0d é1-2", "", None, "x" * 500 + " y" * 3, "\x0b\x0c tab\tnew\nline", "ends", "starts"]
    for kind, pattern in (("space", SPACE), ("alnum", ALNUM)):
        data, off = text_bytes(pa.array(texts))
        w = split_words(data, off, byte_classes(kind), lower_table())
        for i, t in enumerate(texts):
            want = re.findall(pattern, (t or "").translate(FOLD))
            own = range(w.first[i], w.first[i + 1])
            assert [data[w.start[k]:w.stop[k]].tobytes().decode().translate(FOLD) for k in own] == want
    long = pa.array(["a" * 100 + "b", "a" * 100 + "c", "a" * 100 + "b"])
    h = split_words(*text_bytes(long), byte_classes("space")).hash
    assert h[0] == h[2] != h[1]


def test_packing_is_lossless():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (unpack(pack(x), np.uint64) == x).all() and (from_planes(planes(x[::-1]), np.uint64) == x[::-1]).all()
    assert len(unpack(pack(x[:0]), np.uint64)) == 0


def brute_repeats(rows, length):
    first = {}
    for i, t in ((r[0], r[1]) for r in rows):
        w = re.findall(SPACE, t or "")
        for k in range(len(w) - length + 1):
            if i is not None:
                g = tuple(w[k:k + length])
                first[g] = min(first.get(g, i), i)
    out = []
    for r in rows:
        w = re.findall(SPACE, r[1] or "")
        gone = {k + j for k in range(len(w) - length + 1) for j in range(length)
                if r[0] is not None and first[tuple(w[k:k + length])] < r[0]}
        out.append((r[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [13, 4, 3])
def test_repeats(spark, edge, edge_rows, length):
    passage = prose(9, 30)
    more = [document(20 + i, f"{prose(40 + i, 20)} {passage} {prose(60 + i, 20)}") for i in range(12)]
    df = edge.union(spark.createDataFrame(more, SCHEMA))
    got = rows_of(remove_repeats(df, length, block_bytes=2000).select("doc_id", "n_words", "n_removed", "kept_text"))
    assert got == brute_repeats(edge_rows + more, length)


def test_repeats_of_nothing(empty):
    assert remove_repeats(empty).count() == 0 and ladder(4, 13) == [4, 8, 13] and ladder(4, 3) == [3]


def shingle_set(text, size):
    w = re.findall(SPACE, (text or "").translate(FOLD))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, size, percent):
    sets = [(r[0], shingle_set(r[1], size)) for r in rows]
    group = {i: i for i, _ in sets if i is not None}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, x), (j, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(i), root(j)))
            group[b] = a
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("size,percent,rare,chunk", [(3, 90, 256, 240), (5, 80, 2, 7)])
def test_groups(spark, edge, edge_rows, monkeypatch, size, percent, rare, chunk):
    for name, value in (("CHUNK", chunk), ("HALF", chunk), ("CENTRES", 2), ("BAG_ROWS", 20)):
        monkeypatch.setattr(jaccard_join, name, value)

    def near(base, seed, edits):
        r, w = __import__("random").Random(seed), base.split()
        for k in r.sample(range(len(w)), edits):
            w[k] = f"e{seed}_{k}"
        return " ".join(w)

    bases = [prose(100 + b, 150, 5000) for b in range(3)]
    more = [document(100 + 40 * b + i, near(bases[b], 1000 * b + i, i % 6)) for b in range(3) for i in range(40)]
    df = edge.union(spark.createDataFrame(more, SCHEMA))
    got = rows_of(jaccard_groups(df, percent, size, rare, block_bytes=20_000))
    assert got == brute_groups(edge_rows + more, size, percent)
    kept = one_of_each(df, percent, size)
    assert kept.columns == df.columns
    ids = {i for i, _, c in got if i == c}
    assert {r.doc_id for r in kept.collect()} == ids | {None}


def test_groups_of_nothing(empty):
    assert jaccard_groups(empty).count() == 0 and one_of_each(empty).count() == 0


def test_every_similar_pair_shares_an_index_entry():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        base = rng.choice(10_000, 60, replace=False).astype(np.uint64)
        sets = []
        for _ in range(25):
            s = base.copy()
            s[rng.choice(60, rng.integers(0, 8), replace=False)] = rng.integers(20_000, 90_000)
            sets.append(np.unique(s))
        row = np.repeat(np.arange(25), [len(s) for s in sets])
        h = np.concatenate(sets)
        u, inv, df = np.unique(h, return_inverse=True, return_counts=True)
        r, k = index_entries(row, h, frequency_class(df)[inv], np.array([len(s) for s in sets]), percent, 4)
        keys = [set(k[r == i].tolist()) for i in range(25)]
        for i, j in itertools.combinations(range(25), 2):
            common = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) != common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                assert keys[i] & keys[j]
    assert prefix_length(np.array([1, 2, 10]), 90).tolist() == [1, 2, 3]


def test_counts_and_spanning_links():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(9)]
    got = common_counts(sets[:4], sets, width=50)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(4) for j in range(9))
    ids = np.array([10, 20, 30, 40, 50])
    m = np.zeros((5, 5), bool)
    for i, j in ((4, 3), (3, 2), (0, 1)):
        m[i, j] = m[j, i] = True
    a, b = spanning_links(ids, m)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {20: 10, 40: 30, 50: 30}


def brute_overlap(rows, items):
    tests = defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, (t or "").translate(FOLD))
        if i is not None and w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                tests[tuple(w[k:k + n])].add(str(i))
    out = []
    for r in rows:
        w = re.findall(ALNUM, (r[1] or "").translate(FOLD))
        hit, found = set(), set()
        for n in {len(t) for t in tests}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in tests:
                    hit.update(range(k, k + n))
                    found |= tests[g]
        out.append((r[0], len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [1 << 18, 20])
def test_overlap(spark, edge, edge_rows, block_words):
    passage = prose(9, 40)
    more = [document(30, f"{prose(31, 300)} {passage} tail"), document(31, passage.upper()), document(32, f"{passage} {passage}"), document(33, passage[:30])]
    items = [(1, passage), (2, passage[10:150]), (3, "one two"), (4, "Two"), (5, None), (6, ""), (None, passage), (7, prose(50, 30)), (1, prose(1, 120, 10_000)), (8, passage)]
    df = edge.union(spark.createDataFrame(more, SCHEMA))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = suffix_overlap.with_overlaps(df, bench, ["doc_id"], block_words=block_words)
    found = rows_of(got.select("doc_id", "n_words", suffix_overlap.n_hit().alias("h"), "items"))
    assert found == brute_overlap(edge_rows + more, items)
    longest = {r.doc_id: r.longest for r in got.collect()}
    assert longest[31] == len(passage.split()) and longest[14] == 0
    kept = suffix_overlap.decontaminate(df, bench)
    assert kept.columns == df.columns
    bad = {r[0] for r in found if r[2] and 20 * r[2] >= r[1]}
    assert {r.doc_id for r in kept.collect()} & bad <= {None}


def test_overlap_of_nothing(spark, edge, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert suffix_overlap.with_overlaps(empty, none, ["doc_id"]).count() == 0
    assert suffix_overlap.decontaminate(edge, none).count() == edge.count()


def test_hilbert_curve_visits_neighbours(spark):
    pts = list(itertools.product(range(8), repeat=3))
    df = spark.createDataFrame(pts, "x int, y int, z int").withColumns({f"_{c}": F.col(c) for c in "xyz"})
    got = sorted((r.h, r.x, r.y, r.z) for r in hilbert.with_hilbert_index(df, ["_x", "_y", "_z"], 3, "h").collect())
    assert [g[0] for g in got] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in itertools.pairwise(got))


def test_shards(spark, edge, empty):
    got = hilbert.shard_documents(edge, 4).collect()
    assert len(got) == edge.count()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.size for r in got if r.doc_id in (4, 5)} == {1} and next(r for r in got if r.doc_id == 10).size == 10_001
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert hilbert.shard_documents(empty).count() == 0


def test_sources_with_one_beginning_get_their_own_codes(spark):
    r = random.Random(3)
    names = [f"common_crawl_{i}" for i in range(20)] + ["https://a.example/é", "https://a.example/z", None, ""]
    values = [r.choice(names) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "source string")
    (cuts,) = hilbert.edges(df, ["source"], 5)
    known = sorted(v.encode() for v in values if v is not None)
    want = sorted({known[-(-i * len(known) // 32) - 1] for i in range(1, 32)})
    assert cuts == want and len(cuts) >= 20
    got = df.select("source", hilbert.quantised(F.col("source"), "string", cuts).alias("code")).distinct().collect()
    assert {x.source: x.code for x in got} == {v: 0 if v is None else sum(c < v.encode() for c in want) for v in set(values)}


def test_urls(spark):
    urls = [(1, "http://a.Example.NET/en/x?q"), (2, "https://example.net"), (3, "http://net/"), (4, "no scheme"), (5, None), (6, "http://evil.com#x"), (7, "http://x.evil.com/fr/?a"),
            (8, "http://b.org/fr/1"), (9, "x://"), (10, "http://notexample.com/de/"), (11, "http://example.com/de/"), (11, "http://example.com/de/"), (12, "http://example.net/en"), (None, "http://evil.com/")]
    pages = spark.createDataFrame([(*u, "block", True) for u in urls], "page_id bigint, url string, rule string, listed boolean")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block")]
    got = rows_of(url_cascade.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([("evil.com",), (None,)], "host string")))
    want = []
    for i, u in urls:
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        listed = host == "evil.com" or host.endswith(".evil.com")
        want.append((i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "block" if listed else "allow", listed))
    assert got == sorted(want, key=repr)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_cascade.url_filter(pages, none, none.select("host")).collect()} == {"allow"}
    assert url_cascade.url_filter(pages.limit(0), spark.createDataFrame(rules, none.schema), none.select("host")).count() == 0


def test_cascade_is_exact_for_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = url_cascade.build_blocks(keys.filter("substring(key, 2) % 7 = 0"), keys, block_keys=1000)
    assert len(blocks) == 3
    got = url_cascade.with_listed(keys, blocks, {"hit": F.col("key")})
    assert got.filter("hit <> (substring(key, 2) % 7 = 0)").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    vecs += [(600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] * 8), (603, [float("inf")] * 8), (620, vecs[3][1]), (640, vecs[3][1]), (660, [1.0, 2.0]), (661, [2.0, 1.0]),
             (700, vecs[5][1]), (700, vecs[5][1]), (None, vecs[0][1]), (720, [])]
    df = spark.createDataFrame([(*v, 1) for v in vecs], "vec_id bigint, embedding array<float>, rank int")
    live = [(i, tuple(int(np.floor(64 * np.float32(x).astype(float))) for x in v)) for i, v in vecs
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in dict.fromkeys(x for x in live if x[0] % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in live if j != q and len(w) == len(v))
        want += [(q, r + 1, j, -x) for r, (x, j) in enumerate(s[:20])]
    got = rows_of(top_k(df, F.col("vec_id") % 20 == 0))
    assert got == sorted(want, key=repr)
    assert top_k(df.limit(0), F.lit(True)).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(1000, 6))

    def walk(node):
        if node.rows is not None:
            assert (np.linalg.norm(pts[node.rows] - node.centre, axis=1) <= node.radius + 1e-9).all()
            return len(node.rows)
        return sum(walk(p) for p in node.parts)

    assert walk(build_tree(pts)) == 1000
    big = np.full((1, 2), 2**30, np.int64)
    assert scores(big, big)[0, 0] == 2**61


def entries_of(n, percent=80):
    h = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
    return index_entries(np.zeros(n, np.int64), h, np.full(n, 200, np.uint8), np.array([n]), percent, 32)


def test_entries_grow_as_the_shingles():
    per = [len(entries_of(n)[0]) / n for n in (300, 1000, 3000, 20_000)]
    assert max(per) < 1.5 and max(per) < 2.5 * min(per)


def test_frequent_sets_of_every_size_share_an_entry():
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        for n in (5, 9, 16, 31, 33, 63, 127, 129, 250, 260, 600):
            base = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
            sets = [base]
            for _ in range(8):  # some shingles less, some others in their place, some more
                less, more = rng.integers(0, max(1, n * (100 - percent) // 150) + 1, 2)
                sets.append(np.unique(np.concatenate([rng.choice(base, n - less, replace=False), rng.choice(1 << 40, more).astype(np.uint64)])))
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            h = np.concatenate(sets)
            r, k = index_entries(row, h, np.full(len(h), 90, np.uint8), np.array([len(s) for s in sets]), percent, 32)
            keys = [set(k[r == i].tolist()) for i in range(len(sets))]
            for i, j in itertools.combinations(range(len(sets)), 2):
                common = len(np.intersect1d(sets[i], sets[j]))
                if not len(sets[i]) == len(sets[j]) == common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    assert keys[i] & keys[j]


def test_no_group_of_unlinked_likes_is_large(spark, monkeypatch):
    """Documents of one template that share two thirds of their shingles: none linked at 80 %, all in one cluster."""
    counts, bag = [], jaccard_join._with_bag

    def measured(groups, rows):
        out = bag(groups, rows)
        counts.append([r["count"] for r in out.groupBy("bag").count().collect()])
        return out

    monkeypatch.setattr(jaccard_join, "_with_bag", measured)
    base, r, docs = prose(500, 200, 100_000).split(), random.Random(1), []
    for i in range(1200):
        w = base.copy()
        for k in r.sample(range(200), 5):
            w[k] = f"z{i}_{k}"
        docs.append(document(i, " ".join(w)))
    got = jaccard_groups(spark.createDataFrame(docs, SCHEMA), 80, 5)
    linked = got.filter("doc_id <> component_id").count()
    assert linked < 300 and len(counts) == 2
    assert max(max(c) for c in counts) <= 8 * jaccard_join.BAG_ROWS


def test_sets_of_a_batch_are_made_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    class Sent:  # what Spark would run on its batches
        select = lambda self, *c: self
        mapInArrow = lambda self, run, kind: run

    texts = [prose(i, 4000, 9000) for i in range(400)] + [None, "", "a b"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    run = jaccard_join.set_table(Sent(), 5)
    tracemalloc.start()
    got = pa.Table.from_batches(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    data, off = text_bytes(batch["text"])
    row, h = jaccard_join.shingles(data, off, 5)
    assert got["n_shingles"].to_pylist() == np.bincount(row, minlength=len(texts)).tolist() and got["n_shingles"].to_pylist()[-3:] == [0, 0, 1]
    assert np.array_equal((got["a"].to_numpy(), got["b"].to_numpy()), jaccard_join._set_prints(row, h, len(texts)))
    assert peak < 6 * len(data)  # once all words of a batch were held together


def test_growing_tables_of_the_join_are_never_broadcast(spark, monkeypatch):
    """Spark sizes these tables below its broadcast limit; a broadcast of one goes through the driver whole."""
    import celltable.llm.components as components
    import celltable.llm.jaccard_join as jaccard
    from celltable.llm.store import saved

    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return saved(df)

    monkeypatch.setattr(components, "saved", watched)
    monkeypatch.setattr(jaccard, "saved", watched)
    base = prose(5, 60, 10_000).split()
    rows = [document(i, " ".join([*base[:k], f"x{i}", *base[k + 1:]])) for i, k in enumerate(range(0, 40, 2))] + [document(3, prose(6, 40)), document(99, prose(6, 40))]
    out = jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA), 80, 3)
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert out.count() >= 1 and len(plans) > 5
    assert not [p for p in plans if "Broadcast" in p]
