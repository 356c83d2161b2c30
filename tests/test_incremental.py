"""Bucket store and slides that arrive in parts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from celltable.operators.cells import clean_cells, typed_cells
from celltable.operators.patches import composition_report
from celltable.sources import bucket_store as B
from celltable.streaming import inbox as ST
from tests.test_cells import make_cells

RECORD = "uuid string, ts bigint, note string"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_batches_rewrite_their_own_buckets(spark, tmp_path):
    path, r, want = str(tmp_path / "s"), random.Random(1), {}

    def rows(keys, ts):
        got = [(f"k{k}", ts + r.randrange(5), f"n{r.random()}") for k in keys]
        for k, t, n in got:
            want[k] = max(want.get(k, (t, n)), (t, n))
        return spark.createDataFrame(got, RECORD)

    assert B.merge_batch(rows(range(2000), 10), path, 0, "uuid", "ts", "note", 32) == 32
    before = files(path)
    assert len([f for f in before if f.startswith("data")]) == 32
    batch = rows(r.sample(range(2000), 9) + [5000], 20)
    touched = B.merge_batch(batch, path, 1, "uuid", "ts", "note", 32)
    after = files(path)
    new = [f for f in after if f.startswith("data") and f not in before]
    assert 0 < touched <= 10 and len(new) == touched and all(after[f] == before[f] for f in before)
    assert {x.uuid: (x.ts, x.note) for x in B.read_store(spark, path).collect()} == want
    # the same batch again, and an older one, change nothing
    assert B.merge_batch(batch, path, 1, "uuid", "ts", "note", 32) == 0 and B.merge_batch(batch, path, 0, "uuid", "ts", "note", 32) == 0
    assert files(path) == after
    with pytest.raises(ValueError, match="32 buckets"):
        B.merge_batch(batch, path, 2, "uuid", "ts", "note", 16)


def test_lost_batch_leaves_the_former_version(spark, tmp_path):
    path = str(tmp_path / "s")
    B.merge_batch(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")], RECORD), path, 0, "uuid", "ts")
    # a batch that died before its manifest: rows of version 1 lie there, unread
    spark.createDataFrame([("a", 9, "lost", 0)], RECORD + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/data/version=1")
    read = lambda: {x.uuid: x.note for x in B.read_store(spark, path).collect()}
    assert read() == {"a": "x", "b": "y", None: "z"}
    B.merge_batch(spark.createDataFrame([("a", 2, "new", 7), ("a", 1, "old", 7)], RECORD + ", more int"), path, 1, "uuid", "ts")
    assert read() == {"a": "new", "b": "y", None: "z"}
    assert {(x.uuid, x.more) for x in B.read_store(spark, path).collect()} == {("a", 7), ("b", None), (None, None)}
    assert B.merge_batch(spark.createDataFrame([], RECORD), path, 2, "uuid", "ts") == 0 and len(read()) == 3
    with pytest.raises(ValueError, match="no committed"):
        B.read_store(spark, str(tmp_path / "none"))


def test_vacuum_empties_what_no_kept_version_names(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(4):
        B.merge_batch(spark.createDataFrame([(f"k{k}", n, str(n)) for k in (range(200) if n == 0 else range(3))], RECORD), path, n, "uuid", "ts", buckets=8)
    gone = B.superseded(spark, path, 2)
    assert gone and B.vacuum(spark, path, 2) == len(gone) and B.vacuum(spark, path, 2) == 0
    got = {x.uuid: x.note for x in B.read_store(spark, path).collect()}
    assert len(got) == 200 and {got[f"k{k}"] for k in range(3)} == {"3"} and got["k100"] == "0"
    assert all(spark.read.parquet(f).count() == 0 for f in gone)
    B.merge_batch(spark.createDataFrame([("k5", 9, "9")], RECORD), path, 4, "uuid", "ts", buckets=8)
    assert B.read_store(spark, path).filter("note = '9'").count() == 1 and B.read_store(spark, path).count() == 200


def test_slides_in_parts_equal_the_batch_result(spark, tmp_path):
    cells = make_cells(spark, [(s, f"{i % 2}_0_{i}", i, 0, 10, {"CD3": float(i * k + i % 5)}) for k, s in enumerate(["a", "b", "c"]) for i in range(30)])
    d = cells.withColumns({"part": (F.pmod(F.xxhash64("cell_id"), F.lit(3))).cast("int"), "parts": F.lit(3)})
    box, out, staged, ck = (str(tmp_path / n) for n in ("in", "out", "st", "ck"))

    def deliver(rows, max_files=1000):
        rows.repartition("slide_id", "part").write.mode("append").parquet(box)
        ST.watch_parts(spark, box, out, staged, ck, d.schema, max_files=max_files, buckets=4)

    want = sorted(map(tuple, composition_report(typed_cells(clean_cells(cells))).collect()))
    got = lambda: sorted(map(tuple, spark.read.parquet(out).drop("batch").collect()))
    deliver(d.filter("part < 2 or slide_id = 'a'"))
    assert got() == [w for w in want if w[0] == "a"]
    deliver(d.filter("part = 2 and slide_id <> 'a'"), max_files=1)
    assert got() == want
    before = files(out)
    deliver(d.filter("slide_id = 'b'"))  # a slide that comes again is not written again
    assert got() == want and all(files(out)[f] == t for f, t in before.items())
    deliver(d.limit(0))
    assert got() == want


def test_incomplete_and_nameless_parts_wait(spark, tmp_path):
    cells = make_cells(spark, [("a", f"0_0_{i}", i, 0, 10, {"CD3": float(i)}) for i in range(6)])
    d = cells.withColumns({"part": F.lit(0), "parts": F.lit(2)})
    box, out, staged, ck = (str(tmp_path / n) for n in ("in", "out", "st", "ck"))
    d.union(d.withColumn("part", F.lit(None).cast("int"))).write.parquet(box)
    ST.watch_parts(spark, box, out, staged, ck, d.schema)
    ST.watch_parts(spark, box, out, staged, ck, d.schema)
    from celltable.sources.writers import has_files
    assert not has_files(spark, out) or spark.read.parquet(out).count() == 0
    with pytest.raises(ValueError, match="part and parts"):
        ST.watch_parts(spark, box, out, staged, ck, cells.schema)
