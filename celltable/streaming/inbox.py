"""Incremental loading: a folder of slides, and a stream of reader records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from celltable.operators.cells import clean_cells, typed_cells
from celltable.operators.patches import composition_report
from celltable.sources.bucket_store import BUCKETS, merge_batch, read_store, vacuum
from celltable.sources.writers import has_files


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there, once, then stop."""
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    q.awaitTermination()


def watch_cells(spark: SparkSession, inbox: str, out: str, checkpoint: str, schema: str,
                report: Callable[[DataFrame], DataFrame] = composition_report, max_files: int = 1000,
                errors: str | None = None) -> None:
    """Patch tables for each new cell file (Parquet, one file per slide; ``watch_parts`` takes slides in several).

    Slide-wide cuts need the whole slide, so a slide spread over several files of a
    batch, or already written earlier, goes to the error table (``<out>-errors`` by
    default: slide_id, reason) and the others go on.  Both are written per batch
    number, so a restarted batch replaces its own rows."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(inbox)
              .select("*", F.col("_metadata.file_path").alias("_file")))

    def each(batch: DataFrame, number: int) -> None:
        several = (batch.groupBy("slide_id").agg(F.countDistinct("_file").alias("n")).filter("n > 1")
                   .select("slide_id", F.lit("arrived in several files").alias("reason")))
        bad = several
        if has_files(batch.sparkSession, out):
            seen = batch.sparkSession.read.parquet(out).filter(F.col("batch") != number).select("slide_id").distinct()
            again = batch.select("slide_id").distinct().join(seen, "slide_id", "left_semi")
            bad = bad.unionByName(again.join(several, "slide_id", "left_anti").select("slide_id", F.lit("was processed before").alias("reason")))
        bad.write.mode("overwrite").parquet(f"{errors or out.rstrip('/') + '-errors'}/batch={number}")
        good = batch.drop("_file").join(bad.select("slide_id"), "slide_id", "left_anti").select(*[c for c in batch.columns if c != "_file"])
        table = report(typed_cells(clean_cells(good)))
        table.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_available(stream, checkpoint, each)


def watch_records(spark: SparkSession, inbox: str, out: str, checkpoint: str, schema: str, key: str = "uuid",
                  ts: str = "ts", tie: str | None = None, max_files: int = 1000, buckets: int = BUCKETS) -> None:
    """Newest record per key from files of records, in a bucket store at ``out``.

    A batch rewrites the buckets of its keys alone; a batch that is run again after a restart changes nothing."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(inbox)

    def each(batch: DataFrame, number: int) -> None:
        merge_batch(batch, out, number, key, ts, tie, buckets)
        vacuum(batch.sparkSession, out)

    run_available(stream, checkpoint, each)


def latest_version(spark: SparkSession, out: str) -> DataFrame:
    return read_store(spark, out)


# ---- slides that arrive in parts -------------------------------------------------------

_SEEN = "parts int, seen string, done boolean"


def completed(parts: DataFrame) -> DataFrame:
    """Streaming rows (slide_id, part, parts) to one row (slide_id, parts) per slide, when all its parts have come.

    The state of a slide is the list of its part numbers, never its cells; each task first reduces its rows to distinct
    parts.  A part that comes again is ignored, also after the slide was complete.  A slide whose rows disagree on the
    number of parts waits for the largest.  Rows without slide or part numbers are left out."""
    import pandas as pd

    def distinct(batches):
        for b in batches:
            yield b.drop_duplicates()

    def gather(key, batches, state):
        total, seen, done = state.get if state.exists else (0, "", False)
        have = {int(x) for x in seen.split(",") if x}
        for b in batches:
            have |= set(b["part"].astype(int))
            total = max(total, int(b["parts"].max()))
        now = not done and len([x for x in have if 0 <= x < total]) == total
        state.update((total, "" if done or now else ",".join(map(str, sorted(have))), done or now))
        if now:
            yield pd.DataFrame({"slide_id": [key[0]], "parts": [total]})

    narrow = parts.filter("slide_id is not null and part is not null and parts > 0").select("slide_id", F.col("part").cast("int"), F.col("parts").cast("int"))
    narrow = narrow.mapInPandas(distinct, "slide_id string, part int, parts int")
    return narrow.groupBy("slide_id").applyInPandasWithState(gather, "slide_id string, parts int", _SEEN, "append", "NoTimeout")


def watch_parts(spark: SparkSession, inbox: str, out: str, staged: str, checkpoint: str, schema: str,
                report: Callable[[DataFrame], DataFrame] = composition_report, max_files: int = 1000, buckets: int = BUCKETS) -> None:
    """Patch tables of slides whose cells come in several files, over several batches and runs.

    ``schema`` has the cell columns with ``part`` and ``parts`` (number of the file in its slide, and how many there are).  One
    stream moves new files to ``staged``, laid out by a hash of the slide; a second one reads that table and keeps the parts
    seen per slide as state.  A slide's features are written once, when its last part is there, from its own buckets of
    the staged table; earlier output is not read.  Parts that come again are dropped: the first rows of a part count."""
    if {"part", "parts"} - set(spark.createDataFrame([], schema).columns):
        raise ValueError("the schema needs the columns part and parts")
    arriving = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(inbox)
                .withColumns({"bucket": F.pmod(F.xxhash64("slide_id"), F.lit(buckets)).cast("int"), "_file": F.col("_metadata.file_path")}))
    arriving.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{checkpoint}/staged").partitionBy("bucket").start(staged, format="parquet").awaitTermination()

    held = spark.read.parquet(staged).schema

    def each(batch: DataFrame, number: int) -> None:
        ready = batch.persist()
        where = [r[0] for r in ready.select(F.pmod(F.xxhash64("slide_id"), F.lit(buckets)).cast("int")).distinct().collect()]
        cells = batch.sparkSession.read.schema(held).parquet(staged).filter(F.col("bucket").isin(where)).join(ready.select("slide_id"), "slide_id", "left_semi")
        first = cells.groupBy("slide_id", "part").agg(F.min("_file").alias("_file"))
        cells = cells.join(first, ["slide_id", "part", "_file"], "left_semi").drop("part", "parts", "bucket", "_file")
        report(typed_cells(clean_cells(cells))).write.mode("overwrite").parquet(f"{out}/batch={number}")
        ready.unpersist()

    whole = completed(spark.readStream.schema(held).option("maxFilesPerTrigger", max_files).parquet(staged))
    run_available(whole, f"{checkpoint}/whole", each, "append")
