"""Domain tables derived from the star-schema input tables.

Each view is one SQL text used for both Spark and the SQL check, so both sides
start from the same rows.  Every view is a narrow projection, an explode or a
plain aggregate of whole input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from celltable.operators.skew import shared_dir

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_CELLS_IN = """select l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
    l_tax, l_shipdate, l_returnflag, l_linestatus,
    (l_partkey*7919+l_linenumber*104729)%768 as x, (l_orderkey*6151+l_partkey*31)%768 as y from {lineitem}"""

VIEWS: dict[str, str | tuple[str, str]] = {
    "cells": tuple(f"""
select cast(l_suppkey as string) as slide_id,
  concat(cast(cast(floor(y/256) as int)*256 as string), '_', cast(cast(floor(x/256) as int)*256 as string), '_',
         cast(l_orderkey as string), cast(l_linenumber as string), lpad(cast(l_partkey as string), 9, '0'),
         cast({day} as string),
         lpad(cast(cast(l_quantity as int) as string), 2, '0')) as cell_id,
  cast(x as double) as x, cast(y as double) as y, 20+l_quantity*3 as nucleus_area, l_quantity as DAPI,
  round(l_discount*100,0) as Foxp3, round(l_tax*100,0) as CD19, sqrt(l_extendedprice)/10 as CD68,
  cast(l_partkey % 23 as double) as CD4, cast(l_orderkey % 29 as double) as CD3,
  cast((l_partkey*3+l_orderkey) % 19 as double) as CD8,
  case when l_linenumber = 7 then null else cast(l_linenumber as double) end as SampleAF,
  sqrt(l_extendedprice)*0.37 as CD3_var, l_returnflag as side, l_linestatus as status
from ({_CELLS_IN})""" for day in ("unix_date(cast(l_shipdate as date))", "(cast(l_shipdate as date) - date '1970-01-01')")),
    "bags": """
select cast(label as string) as slide_id, vec_id, (vec_id % 16)*256 as x,
  cast(floor(vec_id/16) as bigint)*256 as y, embedding as feature
from {embeddings}""",
    "slides": """
select cast(s_suppkey as string) as slide_id, 700 + s_suppkey % 37 * 11 as w, 640 + s_nationkey * 13 as h
from {supplier}""",
    # label maps: one 40x40 image per supplier, truth and prediction shifted per image
    "labels_px": ("""
select s_suppkey as img, y, x, s_nationkey as nk,
  case when y%8<6 and x%8<6 then 1+cast(floor(y/8) as int)*5+cast(floor(x/8) as int) else 0 end as true_id,
  case when (y+s_nationkey%4)%8<6 and (x+s_suppkey%3)%8<6
       then 1+cast(floor((y+s_nationkey%4)/8) as int)*6+cast(floor((x+s_suppkey%3)/8) as int) else 0 end as pred_id
from {supplier} lateral view explode(sequence(0,39)) ty as y lateral view explode(sequence(0,39)) tx as x""", """
select img, y, x, s_nationkey as nk,
  case when y%8<6 and x%8<6 then 1+cast(floor(y/8) as int)*5+cast(floor(x/8) as int) else 0 end as true_id,
  case when (y+s_nationkey%4)%8<6 and (x+img%3)%8<6
       then 1+cast(floor((y+s_nationkey%4)/8) as int)*6+cast(floor((x+img%3)/8) as int) else 0 end as pred_id
from (select *, unnest(range(40))::int as x from
  (select s_suppkey as img, s_nationkey, unnest(range(40))::int as y from {supplier}))"""),
    # RGB image pair per supplier
    "rgb_px": ("""
select s_suppkey as img, y, x, (y*7+x*3+s_suppkey*11)%256 as r, (y*5+x*13+s_nationkey*17)%256 as g,
  (y*3+x*5+s_suppkey)%256 as b, (y*7+x*3+s_suppkey*11+(y*x)%9)%256 as r2,
  (y*5+x*13+s_nationkey*17+(y+x)%7)%256 as g2, (y*3+x*5+s_suppkey+x%5)%256 as b2
from {supplier} lateral view explode(sequence(0,23)) ty as y lateral view explode(sequence(0,23)) tx as x""", """
select img, y, x, (y*7+x*3+img*11)%256 as r, (y*5+x*13+s_nationkey*17)%256 as g, (y*3+x*5+img)%256 as b,
  (y*7+x*3+img*11+(y*x)%9)%256 as r2, (y*5+x*13+s_nationkey*17+(y+x)%7)%256 as g2,
  (y*3+x*5+img+x%5)%256 as b2
from (select *, unnest(range(24))::int as x from
  (select s_suppkey as img, s_nationkey, unnest(range(24))::int as y from {supplier}))"""),
    "raster": ("""
select cast(s_suppkey as string) as slide_id, ay, ax, ((ax*7+ay*13+s_suppkey*29)%256)/255.0D as value
from {supplier} lateral view explode(sequence(0,47)) ty as ay lateral view explode(sequence(0,47)) tx as ax""", """
select slide_id, ay, ax, ((ax*7+ay*13+k*29)%256)/255.0::double as value
from (select *, unnest(range(48))::int as ax from
  (select cast(s_suppkey as varchar) as slide_id, s_suppkey as k, unnest(range(48))::int as ay from {supplier}))"""),
    "cohort": ("""
select c_custkey as id, any_value(c_acctbal) as risk, any_value(c_mktsegment) as segment,
  any_value(case when c_mktsegment='HOUSEHOLD' then 'none' else cast(c_nationkey%2 as string) end) as recurrent,
  any_value(cast(c_nationkey%3 <> 0 as int)) as event,
  any_value(case when c_nationkey%5 = 0 then 'val' else 'train' end) as split,
  datediff(max(o_orderdate), min(o_orderdate)) as days
from {customer} join {orders} on c_custkey = o_custkey group by c_custkey""", """
select c_custkey as id, any_value(c_acctbal) as risk, any_value(c_mktsegment) as segment,
  any_value(case when c_mktsegment='HOUSEHOLD' then 'none' else cast(c_nationkey%2 as varchar) end) as recurrent,
  any_value(cast(c_nationkey%3 <> 0 as int)) as event,
  any_value(case when c_nationkey%5 = 0 then 'val' else 'train' end) as split,
  cast(date_diff('day', min(o_orderdate), max(o_orderdate)) as int) as days
from {customer} join {orders} on c_custkey = o_custkey group by c_custkey"""),
    "logits": ("""
select id, event, cast(days/30.4375 as double) as time, cast(least(3, floor(days/700)) as int) as bin,
  transform(sequence(0,3), i -> cast(risk/10000*(1+i) - 0.3*i + event*0.2 as double)) as logits from cohort""", """
select id, event, cast(days/30.4375 as double) as time, cast(least(3, floor(days/700)) as int) as bin,
  list_transform(range(4), lambda i: cast(risk/10000*(1+i) - 0.3*i + event*0.2 as double)) as logits from cohort"""),
    "task_labels": """
select cast(doc_id as string) as slide_id, quality as er, toxic as pr,
  case when quality = 1 and toxic = 1 then -1 else quality end as her2 from {labels}""",
    "reader_records": """
select concat(cast(user_id as string), '-', event_type) as uuid, ts, event_id, user_id as doctor,
  event_type as marker, cast(1 + event_id % 5 as int) as quality_score, value from {events}""",
    "image_names": """
select p_partkey, concat('/pool/', p_brand, case when p_size%2=0 then '_real_' else '_FAKE_' end,
  case when p_type='ECONOMY' then 'if_' else 'HE_' end, cast(p_size as string), '.png') as path,
  p_brand as brand, p_type as kind, p_size as size from {part}""",
    # an L-shaped and a square outline per supplier; ring 1 of the square is a hole
    "rings": ("""
select cast(s_suppkey as string) as slide_id, tissue_id, ring, ring > 0 as is_hole,
  transform(raw, p -> named_struct('x', cast(p[0] + s_nationkey*4 as double), 'y', cast(p[1] + s_nationkey*3 as double))) as pts
from {supplier} lateral view inline(array(
  struct(1, 0, array(array(11, 7), array(311, 7), array(311, 157), array(161, 157), array(161, 307), array(11, 307))),
  struct(2, 0, array(array(333, 333), array(633, 333), array(633, 633), array(333, 633))),
  struct(2, 1, array(array(401, 401), array(501, 401), array(501, 501), array(401, 501))),
  struct(2, 2, array(array(551, 551), array(571, 551), array(571, 571), array(551, 571))))) i as tissue_id, ring, raw""", """
select cast(s_suppkey as varchar) as slide_id, e.tissue_id as tissue_id, e.ring as ring, e.ring > 0 as is_hole,
  list_transform(e.pts, lambda p: struct_pack(x := cast(p.x + s_nationkey*4 as double), y := cast(p.y + s_nationkey*3 as double))) as pts
from (select *, unnest([
  {{tissue_id: 1, ring: 0, pts: [{{x: 11, y: 7}}, {{x: 311, y: 7}}, {{x: 311, y: 157}}, {{x: 161, y: 157}}, {{x: 161, y: 307}}, {{x: 11, y: 307}}]}},
  {{tissue_id: 2, ring: 0, pts: [{{x: 333, y: 333}}, {{x: 633, y: 333}}, {{x: 633, y: 633}}, {{x: 333, y: 633}}]}},
  {{tissue_id: 2, ring: 1, pts: [{{x: 401, y: 401}}, {{x: 501, y: 401}}, {{x: 501, y: 501}}, {{x: 401, y: 501}}]}},
  {{tissue_id: 2, ring: 2, pts: [{{x: 551, y: 551}}, {{x: 571, y: 551}}, {{x: 571, y: 571}}, {{x: 551, y: 571}}]}}]) as e from {supplier})"""),
}
DEPENDS = {"logits": ["cohort"]}


_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of the session."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer tasks than the session has cores.

    A large table already splits into many tasks and passes through untouched."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def _text(name: str, side: int) -> str:
    v = VIEWS[name]
    return v if isinstance(v, str) else v[side]


class Views:
    """Input tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: spread(self.table(t)) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used) if used else self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        if name == "cells":
            return self._written(name)
        return self._derived(name)

    def _derived(self, name: str) -> DataFrame:
        text = _text(name, 0)
        for dep in DEPENDS.get(name, []):
            text = f"with {dep} as ({_text(dep, 0)}) {text}"
        d = self.sql(text)
        # an explode keeps the estimated size of its input, so Spark would take the pixels of all
        # images for a small table and send them through the driver to every executor
        return d.hint("merge") if "explode(" in text or "inline(" in text else d

    def _written(self, name: str) -> DataFrame:
        """The view as a table in the shared folder, written once per session and input
        folder.  Most queries read it several times with few columns, so a stored
        table (pruned, split into many tasks) beats deriving it in every branch."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = shared_folder(self.spark, name)
            self._derived(name).write.parquet(_WRITTEN[key])
        return self.spark.read.parquet(_WRITTEN[key])


def with_views(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """SQL check text: the named views as CTEs in front of ``body``."""
    need: list[str] = []
    for n in names.split():
        for d in [*DEPENDS.get(n, []), n]:
            if d not in need:
                need.append(d)
    parts = [f"{n} as ({_text(n, 1).format(**{t: t for t in TABLES})})" for n in need]
    parts += [f"{k} as ({v})" for k, v in (extra or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
