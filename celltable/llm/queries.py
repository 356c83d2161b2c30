"""Registered queries of the package and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from celltable.llm import byte_gru, text_cnn
from celltable.llm.ball_tree import top_k
from celltable.llm.brown_classes import scored
from celltable.llm.hilbert import shard_documents
from celltable.llm.jaccard_join import jaccard_groups
from celltable.llm.kneser_ney import quality
from celltable.llm.phrases import collocations
from celltable.llm.raking import mixed
from celltable.llm.substring_dedup import remove_repeats
from celltable.llm.suffix_overlap import contaminated, n_hit, with_overlaps
from celltable.llm.turn_repair import damaged, repair
from celltable.llm.url_cascade import url_filter, url_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


@query("op4_hilbert_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang")


#: fixed values of the URL query: rules (host, path, verdict), and the words that list a host
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_HOST = r"(^|[.-])(spam|pills|casino|xxx)([.-]|$)"

_URLS_SQL = """with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut),
rules(rhost, rpath, rverdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hosts as (select distinct host as lhost from parts where regexp_matches(host, '(^|[.-])(spam|pills|casino|xxx)([.-]|$)')),
best as (select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(rverdict, length(rhost || rpath)) as rverdict
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id),
listed as (select distinct page_id from parts join hosts on host = lhost or ends_with(host, '.' || lhost))
select page_id, host, path, rule, coalesce(rverdict, case when l.page_id is not null then 'block' else 'allow' end) as verdict,
  l.page_id is not null as listed
from parts left join best using (page_id) left join listed l using (page_id)"""


@query("op6_bloom_cascade", _URLS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    hosts = pages.select(url_parts(F.col("url"))[0].alias("host")).filter(F.col("host").rlike(LISTED_HOST)).distinct()
    return url_filter(pages, rules, hosts)


_TOP_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from (select * from v where vec_id % 20 = 0) q join v c on c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from
  (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20"""


@query("op10_ball_tree", _TOP_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_OVERLAP_SQL = """with words as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
tests as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
  from (select *, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct n from tests),
places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)),
hits as (select distinct doc_id, p.n, i, item_id from places p join tests t on p.n = t.n and p.g = t.g),
hit as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(i, i + n)) as spot from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from words left join hit using (doc_id) left join named using (doc_id)"""


@query("op3_suffix_overlap", _OVERLAP_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    found = found.withColumn("n_hit", n_hit())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def crc_of(name: str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(name).cast("string")) % n


@query("op7_text_cnn")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored, _ = text_cnn.scored_with(docs, table(spark, sf_dir, "labels"), crc_of("doc_id", 5) != 0, ["doc_id", "lang"])
    return scored.select("doc_id", (crc_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.col("threshold").alias("lang_threshold"), (F.col("score") >= F.col("threshold")).alias("flagged"))


@query("op1_byte_gru")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = byte_gru.fit(docs, crc_of("doc_id", 3) != 1)
    found = byte_gru.with_language(docs, net, ["doc_id"])
    return found.select("doc_id", (crc_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


_REPEATS_SQL = """with words as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
places as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13)),
firsts as (select g, min(doc_id) as d from places group by g),
gone as (select doc_id, list(distinct spot) as spots from (select doc_id, unnest(range(i, i + 13)) as spot from places join firsts using (g) where d < doc_id) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(spots), 0)::bigint as n_removed,
  sha256(array_to_string(case when spots is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: not list_contains(spots, z[2])), lambda z: z[1]) end, ' ')) as kept_sha256
from words left join gone using (doc_id)"""


@query("op5_substring_doubling", _REPEATS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_JACCARD_SQL = """with recursive words as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
sh as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
sizes as (select doc_id, len(s) as n from sh), flat as (select doc_id, unnest(s) as g from sh),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from flat a join flat b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) as (select doc_id, doc_id from sizes union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, n::bigint as n_shingles, component_id from sizes join comp using (doc_id)"""


@query("op9_jaccard_join", _JACCARD_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def _repair_sql() -> str:
    """The cheapest edits by one recursion over the rows: for each last role (none, system, user, assistant) the least
    (cost, audit), with the text that it leaves."""
    def plus(state: str, cost: str, edit: str, line: str = "''") -> str:
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', r := {state}.r || {line})"

    never = "struct_pack(c := 1000000000::bigint, a := '', r := '')"
    user, assistant, own = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
    put = {2: user, 3: assistant}

    def when(test: str, state: str) -> str:
        return f"case when {test} then {state} else {never} end"

    def least(*states: str) -> str:
        return f"least({', '.join(states)})"

    deleted = {k: plus(f"c{k}", "3", "D") for k in range(4)}
    kept = {1: [when("not must and initial = 's'", plus("c0", "cut", "K", own))], 2: [when("not must and initial = 'u'", plus(f"c{k}", "cut", "K", own)) for k in (0, 1, 3)],
            3: [when("not must and initial = 'a'", plus("c2", "cut", "K", own))]}
    reroled = {to: [when("not must", plus(f"c{k}", "2 + cut", "R", f"{put[to]} || text")) for k in ks] for to, ks in ((2, (0, 1, 3)), (3, (2,)))}
    moved = ", ".join(f"{least(deleted[k], *kept.get(k, []), *reroled.get(k, []))} as b{k}" for k in range(4))
    opened = f"select *, b0 as c0, b1 as c1, {least('b2', *[plus(f'b{k}', '2', 'I', user) for k in (0, 1, 3)])} as c2 from walk"
    closed = f"select *, {least('b3', plus('c2', '2', 'I', assistant))} as c3 from opened"
    opened, closed = opened.replace(" from walk", " from {}"), closed.replace(" from opened", " from ({})")
    return f"""with recursive crc as (select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
  lambda ch: ascii(ch)::bigint)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 20 as kind from conversations, crc),
hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select * from keyed where kind > 0 union all select * from keyed where kind = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as core from hurt),
faulty as (select *, left(role, 1) as initial, case when core = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
  when right(core, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from placed),
rows as (select conv_id, i, role, text, initial, fault in ('blank', 'duplicate') as must, (fault = 'truncated')::bigint as cut from faulty),
sums as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where prior is not null and prior || initial not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(initial) over (partition by conv_id order by i) as prior from faulty) group by conv_id),
walk as (select conv_id, 0::bigint as i, struct_pack(c := 0::bigint, a := '', r := '') as b0, {never} as b1, {never} as b2, {never} as b3 from sums
  union all select conv_id, i, b0, b1, b2, b3 from (select conv_id, next as i, {moved} from (select w.*, r.* exclude (conv_id, i), r.i as next from ({closed.format(opened.format("walk"))}) w
    join rows r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1) s) t),
ends as (select s.*, least(b0, c3) as best from sums s join ({closed.format(opened.format("walk"))}) w on s.conv_id is not distinct from w.conv_id and s.n = w.i)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(substr(best.r, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join ends e on o.conv_id is not distinct from e.conv_id"""


@query("op12_turn_repair", _repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damaged(table(spark, sf_dir, "conversations")))
    return found.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


_PHRASES_SQL = """with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
words as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select unnest(range(1, 6)) as k) where len(w) >= k)),
f as (select lang, k as size, phrase, count(*) as a from grams group by all having count(*) >= 100),
cuts as (select f.lang, f.phrase, f.a, n, c, l.a as l, r.a as r, (1000::hugeint * f.a * n // (l.a::hugeint * r.a))::bigint as score from
  (select *, unnest(range(1, size)) as c, string_split(phrase, ' ') as w from f where size > 1) f join totals using (lang)
  join f l on l.lang = f.lang and l.phrase = array_to_string(w[1:c], ' ') join f r on r.lang = f.lang and r.phrase = array_to_string(w[c + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1),
nested as (select distinct b.lang, b.phrase from best b join f on f.lang = b.lang and f.a >= b.a and len(f.phrase) > len(b.phrase) and contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from (select * from best anti join nested using (lang, phrase))) where rank <= 2000"""


@query("op13_phrase_parsing", _PHRASES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("op11_brown_classes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), crc_of("doc_id", 7) == 2)


@query("op8_raking")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "chance", "sampled")


@query("op2_kneser_ney")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
