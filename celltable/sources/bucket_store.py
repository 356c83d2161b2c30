"""A keyed table in hash buckets, with a manifest per version.

``<path>/data/version=N/bucket=B`` holds the rows of one bucket as version N wrote them; ``<path>/manifest/version=N`` names,
for every bucket that has rows, the version that wrote it last.  A batch reads and rewrites only the buckets of its own
keys.  Its manifest comes last, as one file whose rename commits the version, so a batch that is lost on the way leaves
the former version as it was, and the repeated batch overwrites what was left.  Every manifest remembers the number of
its batch: a batch at or below the newest number changes nothing.

Only manifests, whose size the number of buckets bounds, come to the driver.  Keys are hashed, so buckets fill evenly;
all rows of one key count as one row after the merge, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from celltable.sources.writers import upsert

BUCKETS = 64
_MANIFEST = "bucket int, folder bigint, buckets int, batch bigint"


@dataclass
class Version:
    number: int
    batch: int
    buckets: int
    folders: dict[int, int]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed manifest rows with their ``version``, or None before the first commit."""
    try:
        return spark.read.schema(f"{_MANIFEST}, version bigint").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest(spark: SparkSession, path: str) -> Version | None:
    rows = manifest(spark, path)
    if rows is None:
        return None
    top = rows.agg(F.max("version")).first()[0]
    if top is None:
        return None
    rows = rows.filter(F.col("version") == top).collect()
    return Version(top, rows[0]["batch"], rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None})


def _read(spark: SparkSession, path: str, folders: dict[int, int]) -> DataFrame:
    """Rows of the given buckets; columns that later batches brought are NULL before."""
    files = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(folders.items())]
    return spark.read.option("mergeSchema", True).option("basePath", f"{path}/data").parquet(*files).drop("version", "bucket")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version."""
    now = newest(spark, path)
    if now is None or not now.folders:
        raise ValueError(f"{path} holds no committed rows")
    return _read(spark, path, now.folders)


def merge_batch(batch: DataFrame, path: str, number: int, key: str, ts: str, tie: str | None = None, buckets: int = BUCKETS) -> int:
    """Newest record per key after a batch; returns how many buckets were rewritten (0 for a batch that was there before)."""
    spark = batch.sparkSession
    now = newest(spark, path)
    if now is not None and number <= now.batch:
        return 0
    if now is not None and now.buckets != buckets:
        raise ValueError(f"{path} has {now.buckets} buckets, not {buckets}")
    version = now.number + 1 if now else 0
    marked = batch.withColumn("bucket", bucket_of(key, buckets))
    touched = sorted(r[0] for r in marked.select("bucket").distinct().collect())
    before = {b: now.folders[b] for b in touched if now and b in now.folders}
    if touched:
        base = _read(spark, path, before) if before else batch.limit(0)
        merged = upsert(base, batch, key, ts, tie).withColumn("bucket", bucket_of(key, buckets))
        (merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", key)
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}"))
    folders = {**(now.folders if now else {}), **dict.fromkeys(touched, version)}
    rows = [(b, v, buckets, number) for b, v in sorted(folders.items())] or [(None, None, buckets, number)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return len(touched)


def superseded(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Bucket folders that none of the last ``keep`` versions names."""
    rows = manifest(spark, path)
    if rows is None:
        return []
    rows = rows.filter("bucket is not null")
    top = rows.agg(F.max("version")).first()[0]
    if top is None:
        return []
    live = rows.filter(F.col("version") > top - keep).select("bucket", "folder").distinct()
    # the manifests that are still there are as many as vacuum left, so this stays small
    gone = rows.select("bucket", "folder").distinct().join(live, ["bucket", "folder"], "left_anti").collect()
    return [f"{path}/data/version={r['folder']}/bucket={r['bucket']}" for r in gone]


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Empty the superseded bucket folders; readers of the last ``keep`` versions are not disturbed.

    A folder is emptied by overwriting it with no rows, which any store that Spark writes to can do; it is then
    dropped from the old manifests, so it is not visited again."""
    gone = superseded(spark, path, keep)
    for folder in gone:
        spark.createDataFrame([], "emptied boolean").coalesce(1).write.mode("overwrite").parquet(folder)
    if gone:
        rows = manifest(spark, path)
        top = rows.agg(F.max("version")).first()[0]
        old = [r[0] for r in rows.filter(F.col("version") <= top - keep).select("version").distinct().collect()]
        for version in old:
            spark.createDataFrame([], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return len(gone)
