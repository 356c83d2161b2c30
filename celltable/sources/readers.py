"""File sources: cell tables, nuclei, polygons, bags, splits and inventories."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from celltable.functions.columns import MARKERS, finite

CELL_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in
                          ["cell_id", "x", "y", "nucleus_area", *MARKERS, *[f"{m}_var" for m in MARKERS], "cell_type"]])
NUCLEI = ("mag double, nuc map<string, struct<bbox: array<array<int>>, centroid: array<double>, "
          "contour: array<array<int>>, type_prob: double, type: int>>")
BAG = "slide_id string, x bigint, y bigint, feature array<float>"


def slide_of_file(pattern: str = r"([^/]+?)(?:_cells|_cell_info)?\.[^./]+(?:\.gz)?$"):
    """Slide id from the file name of each row."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def sniff_delimiter(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Delimiter and trimmed header, read from the first line of one file."""
    line = spark.read.text(path).limit(1).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    head, sep = split_header(line[0])
    return sep, list(head)


def split_header(line: str, sep: str | None = None) -> tuple[tuple[str, ...], str]:
    head = line.lstrip("\ufeff")
    mark = sep or max([",", "\t", ";", "|"], key=head.count)
    return tuple(h.strip().strip('"') for h in head.split(mark)), mark


def header_groups(spark: SparkSession, path: str, sep: str | None = None) -> dict[tuple, list[str]]:
    """Files by (header, delimiter).  One short row per file comes back: its name and first line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value",
                                         F.monotonically_increasing_id().alias("nth"))
    heads = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "nth").alias("head")).collect()
    if not heads:
        raise ValueError(f"{path} is empty")
    out: dict[tuple, list[str]] = {}
    for r in sorted(heads, key=lambda r: r["file"]):
        out.setdefault(split_header(r["head"], sep), []).append(r["file"])
    return out


def read_cells(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Cell CSV (delimiter found by itself, header trimmed) as text columns with ``slide_id``.

    Files are read by their own header and delimiter: one scan for each layout that occurs.
    Columns are read as text; ``clean_cells`` turns them into numbers."""
    parts = []
    for (first, mark), files in header_groups(spark, path, sep).items():
        schema = T.StructType([T.StructField(h, T.StringType()) for h in first])
        df = (spark.read.schema(schema).option("header", True).option("sep", mark).option("enforceSchema", True)
              .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(files))
        parts.append(df.select(slide_of_file().alias("slide_id"), *df.columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_table(spark: SparkSession, path: str, schema: str, null_value: str = "") -> DataFrame:
    """CSV with a stated schema."""
    return spark.read.schema(schema).option("header", True).option("nullValue", null_value).csv(path)


def load_params(json_or_path: str) -> dict:
    """Parameter object from inline JSON or a small JSON file."""
    text = json_or_path
    if os.path.exists(json_or_path):
        with open(json_or_path, encoding="utf-8") as f:
            text = f.read()
    try:
        out = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"cannot read parameters: {e}") from e
    if not isinstance(out, dict):
        raise ValueError("parameters must be a JSON object")
    return out


def explode_nuclei(df: DataFrame) -> DataFrame:
    """One row per nucleus of tables holding ``mag`` and the ``nuc`` map."""
    d = df.select(*[c for c in df.columns if c != "nuc"], F.explode("nuc").alias("nucleus_id", "n"))
    return d.select(*[c for c in d.columns if c != "n"], F.col("n.centroid")[0].alias("cx"), F.col("n.centroid")[1].alias("cy"),
                    "n.type", "n.type_prob", "n.bbox", "n.contour")


def read_nuclei(spark: SparkSession, path: str, slide: str | None = r"([^/]+)\.json$", multi_line: bool = True) -> DataFrame:
    """Nuclei JSON files, one row per nucleus, with ``slide_id`` from the file path by the pattern ``slide``; without one, from
    the objects themselves, so that many slides can share a file.

    A file holds one object, or with ``multi_line=False`` one object per line, which Spark can split over tasks."""
    schema = NUCLEI if slide else f"slide_id string, {NUCLEI}"
    d = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    return explode_nuclei(d.select(slide_of_file(slide).alias("slide_id") if slide else "slide_id", "mag", "nuc"))


def type_lookup(spark: SparkSession, params: dict, n_types: int | None = None) -> DataFrame:
    """Type table (type_id, name, r, g, b); every id below ``n_types`` must be there."""
    rows = [(int(k), v[0], *map(int, v[1])) for k, v in params.items()]
    missing = sorted(set(range(n_types or 0)) - {r[0] for r in rows})
    if missing:
        raise ValueError(f"type lookup lacks ids {missing}")
    return spark.createDataFrame(rows, "type_id int, name string, r int, g int, b int")


def read_type_lookup(spark: SparkSession, path: str, n_types: int | None = None) -> DataFrame:
    """Type table from a JSON file wherever Spark can read; exactly one file must hold it."""
    texts = [r[0] for r in spark.read.text(path, wholetext=True).head(2)]
    if len(texts) != 1:
        raise ValueError(f"{path} must hold one file with the type lookup")
    return type_lookup(spark, load_params(texts[0]), n_types)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygon XML as (slide_id, annotation, ord, x, y).

    Files with ``Annotation/Coordinates/Coordinate`` are read in that form, others as
    ``Region/Vertices/Vertex``; a file with neither is an error."""
    def form(row_tag: str, outer: str, point: str) -> DataFrame:
        schema = f"{outer} struct<{point}: array<struct<_X: double, _Y: double>>>"
        d = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
        d = d.select(slide_of_file(r"([^/]+)\.xml$").alias("slide_id"), F.monotonically_increasing_id().alias("_at"), F.col(f"{outer}.{point}").alias("_points"))
        # numbered by place in the file, however the files are split
        d = d.withColumn("annotation", F.row_number().over(Window.partitionBy("slide_id").orderBy("_at")).cast("bigint") - 1)
        d = d.select("slide_id", "annotation", F.posexplode("_points").alias("ord", "p"))
        return d.select("slide_id", "annotation", "ord", F.col("p._X").alias("x"), F.col("p._Y").alias("y"))

    a, r = form("Annotation", "Coordinates", "Coordinate"), form("Region", "Vertices", "Vertex")
    both = a.unionByName(r.join(a.select("slide_id").distinct(), "slide_id", "left_anti"))
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("slide_id"))
    empty = files.join(both.select("slide_id").distinct(), "slide_id", "left_anti").take(1)
    if empty:
        raise ValueError(f"no polygon in {empty[0][0]}.xml")
    return both


def read_bags(spark: SparkSession, path: str) -> DataFrame:
    """Embedding bags from Parquet; a leading axis of length one is dropped."""
    d = spark.read.parquet(path)
    if isinstance(d.schema["feature"].dataType.elementType, T.ArrayType):
        d = d.withColumn("feature", F.element_at("feature", 1))
    return d.select("slide_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"),
                    F.col("feature").cast("array<float>").alias("feature"))


def list_images(spark: SparkSession, root: str, exts: list[str], recursive: bool = True) -> DataFrame:
    """File inventory without reading contents; hidden, ``checkpoint`` and ``new`` names are skipped."""
    pattern = r"(?i)\.(" + "|".join(e.lstrip(".") for e in exts) + ")$"
    d = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
         .select("path", "length", "modificationTime"))
    name = F.substring_index("path", "/", -1)
    return (d.withColumn("name", name).filter(F.col("name").rlike(pattern))
            .filter(~F.col("name").startswith(".") & ~F.col("name").contains("checkpoint") & ~F.col("name").startswith("new")))


def long_split(wide: DataFrame, splits: list[str] = ["train", "val"]) -> DataFrame:
    """Ragged split columns to (split, slide_id) rows."""
    return (wide.select(*splits).unpivot([], splits, "split", "slide_id")
            .filter(F.col("slide_id").isNotNull() & (F.trim("slide_id") != "")))


def read_split(spark: SparkSession, path: str, splits: list[str] = ["train", "val"]) -> DataFrame:
    d = spark.read.option("header", True).csv(path)
    return long_split(d, [s for s in splits if s in d.columns])


def pending(inputs: DataFrame, outputs: DataFrame, key: str | list[str]) -> DataFrame:
    """Inputs that have no output yet."""
    keys = [key] if isinstance(key, str) else key
    return inputs.join(outputs.select(*keys).distinct(), keys, "left_anti")


def safe_load(df: DataFrame, checks: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Split rows by named SQL conditions: rows meeting all of them, and the others with
    the list of failed rule names in ``errors``."""
    fails = F.filter(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(n))
                               for n, c in checks.items()]), lambda e: e.isNotNull())
    d = df.withColumn("errors", fails)
    return d.filter(F.size("errors") == 0).drop("errors"), d.filter(F.size("errors") > 0)


def bounded_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in cols})
