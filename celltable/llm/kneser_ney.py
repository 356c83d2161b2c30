"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

The model learns from trusted texts only.  Its tables are DataFrames keyed by n-gram: raw counts for the highest order,
numbers of distinct left neighbours for the lower ones, three discounts per order, and a back-off weight per context;
probabilities come from joins of each order with its contexts and with the order below.  Bytes keep the tables small
(a language uses few of the possible sequences) and leave no word unknown.

All n-grams that occur anywhere in the corpus get their probability by the same joins, spread by key.  Most positions
fall on few n-grams: those, ``HEAD`` of them at most, go to the tasks as arrays; positions on any other n-gram are
counted per document and joined with the table.  Either way every position counts.

A document is kept if its perplexity is within the given quantile of the trusted documents of its language.

Rules: a text starts after ``ORDER - 1`` zero bytes.  NULL and empty texts have NULL perplexity and are not kept.  A
NULL language is a language of its own; one without trusted documents gets the threshold of all of them.  Without any
trusted text the model is uniform over bytes.  Repeated rows count each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from celltable.llm.store import saved
from celltable.llm.words import pieces, text_bytes

ORDER, HEAD, QUANTILE = 5, 1 << 20, 0.99
UNIFORM = 1 / 256


def byte_grams(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at every byte, as an integer; places before the text are zero bytes."""
    n = np.diff(off)
    nth = np.arange(len(data)) - np.repeat(off[:-1], n)
    out = np.zeros(len(data), np.int64)
    for k in range(order):
        part = np.zeros(len(data), np.int64)
        part[k:] = data[:len(data) - k] if k else data
        out |= np.where(nth >= k, part, 0) << (8 * k)
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n_all, n_trusted): occurrences in the whole corpus and in the rows whose ``trusted`` is true."""
    def run(batches):
        for b in batches:
            data, off = text_bytes(b["text"])
            trusted = b["trusted"].to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in pieces(off, 1 << 21):
                g = byte_grams(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                own = np.repeat(trusted[lo:hi], np.diff(off[lo:hi + 1]))
                both = np.sort((g << 1) | own)
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(both)))
                key = both[first]
                yield pa.RecordBatch.from_pydict({"gram": key >> 1, "n_all": count, "n_trusted": np.where(key & 1, count, 0)})

    return (docs.select("text", "trusted").mapInArrow(run, "gram bigint, n_all bigint, n_trusted bigint")
            .groupBy("gram").agg(F.sum("n_all").alias("n_all"), F.sum("n_trusted").alias("n_trusted")))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams seen one to four times."""
    n = {r["c"]: r["k"] for r in counts.filter("c between 1 and 4").groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


def model_tables(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1: (gram, p) of seen n-grams and (ctx, gamma) of seen contexts."""
    by_order = {order: saved(counts.filter("n_trusted > 0").select("gram", F.col("n_trusted").alias("c")))}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
        by_order[k] = saved(by_order[k + 1].groupBy(suffix.alias("gram")).agg(F.count(F.lit(1)).alias("c")))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(by_order[k])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = by_order[k].withColumns({"ctx": F.shiftright("gram", 8), "cut": cut})
        contexts = rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("mass"))
        rows = rows.join(contexts, "ctx")
        if k == 1:
            rows = rows.withColumn("lower", F.lit(UNIFORM))
        else:
            below = out[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(below, "suffix")
        p = (F.col("c") - F.col("cut") + F.col("mass") * F.col("lower")) / F.col("total")
        out.append((saved(rows.select("gram", p.alias("p"))), saved(contexts.select("ctx", (F.col("mass") / F.col("total")).alias("gamma")))))
    return out


def log_probabilities(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, logp) of any highest-order n-grams, seen or not: from the lowest order up, back off where unseen."""
    order = len(tables)
    below = None
    for k, (probs, gammas) in enumerate(tables, 1):
        asked = grams.select(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).distinct() if k < order else grams.select("gram")
        rows = asked.join(probs, "gram", "left").withColumn("ctx", F.shiftright("gram", 8)).join(gammas, "ctx", "left")
        if below is None:
            rows = rows.withColumn("lower", F.lit(UNIFORM))
        else:
            rows = (rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
                    .join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix"))
        below = saved(rows.select("gram", F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("lower")).alias("p")))
    return below.select("gram", F.log("p").alias("logp"))


def head_of(table: DataFrame, most: int = HEAD) -> DataFrame:
    """The n-grams above the lowest frequency class at which they are ``most`` at the most."""
    step = F.floor(8 * F.log2("n_all"))
    sizes = table.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("s")).collect()  # a row per class
    total, least = 0, math.inf
    for r in sizes:
        total += r["k"]
        if total > most:
            break
        least = r["s"]
    return table.filter(step >= least) if least != math.inf else table.limit(0)


def perplexities(docs: DataFrame, table: DataFrame, keep: list[str], most: int = HEAD) -> DataFrame:
    """The ``keep`` columns with ``n_bytes`` and ``perplexity`` per byte; ``table`` is (gram, n_all, logp)."""
    head = head_of(table, most).select("gram", "logp").toArrow().sort_by("gram")
    known, logp = head["gram"].to_numpy(), head["logp"].to_numpy()
    # most entries are bounded by HEAD: 16 bytes each, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((known, logp))
    df = docs.select(*keep, F.col("text").alias("_text"), F.xxhash64("text", *keep).alias("_h1"), F.xxhash64(F.lit(1), "text", *keep).alias("_h2"))
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "_text"],
                           *T._parse_datatype_string("n_bytes bigint, _sum double, _rest array<struct<gram:bigint,n:bigint>>").fields])
    rest_type = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))
    names = [*keep, "_h1", "_h2"]

    def run(batches):
        known, logp = shared.value
        for b in batches:
            data, off = text_bytes(b["_text"])
            for lo, hi in pieces(off, 1 << 20):
                n = np.diff(off[lo:hi + 1])
                row = np.repeat(np.arange(hi - lo), n)
                grams, place = np.unique(byte_grams(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]), return_inverse=True)
                at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
                hit = known[at] == grams if len(known) else np.zeros(len(grams), bool)
                value = np.where(hit, logp[at], 0.0) if len(known) else np.zeros(len(grams))
                rest: list[list[dict]] = [[] for _ in range(hi - lo)]
                if not hit.all():
                    miss = np.flatnonzero(~hit[place])
                    pair, count = np.unique(np.stack([row[miss], grams[place[miss]]]), axis=1, return_counts=True)
                    for r, g, c in zip(*pair.tolist(), count.tolist(), strict=True):
                        rest[r].append({"gram": g, "n": c})
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in names], pa.array(n), pa.array(np.bincount(row, value[place], hi - lo)), pa.array(rest, rest_type)],
                                                 [*names, "n_bytes", "_sum", "_rest"])

    rows = saved(df.mapInArrow(run, schema))
    # equal rows have equal rests, so one of them speaks for all
    rest = rows.filter(F.size("_rest") > 0).select("_h1", "_h2", F.explode("_rest").alias("_r")).select("_h1", "_h2", "_r.gram", "_r.n").distinct()
    more = rest.join(table.select("gram", "logp"), "gram").groupBy("_h1", "_h2").agg(F.sum(F.col("n") * F.col("logp")).alias("_more"))
    total = F.col("_sum") + F.coalesce("_more", F.lit(0.0))
    return rows.join(more, ["_h1", "_h2"], "left").select(*keep, "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-total / F.col("n_bytes"))).alias("perplexity"))


def with_trust(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text, trusted) of every document; ``trusted`` holds distinct ids.

    Texts are large, so only those are moved to meet the ids that a Bloom filter of them lets through: all trusted ones and
    a few others, whom the join sorts out.  The filter has ten bits for an id and 2^25 in all (more ids let more texts through)."""
    kind = docs.schema["doc_id"].dataType
    ids = trusted.select(F.col("doc_id").try_cast(kind).alias("doc_id")).dropna()
    size = 1 << min(25, max(6, (10 * ids.count()).bit_length()))
    hashes = [F.xxhash64(F.lit(i), "doc_id").bitwiseAND(size - 1).alias(f"_h{i}") for i in range(4)]
    words = (ids.select(F.explode(F.array(*hashes)).alias("at")).groupBy(F.shiftright("at", 5).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toArrow())
    packed = np.zeros(size >> 5, np.int64)
    packed[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def sieve(wanted: bool):
        def run(batches):
            for b in batches:
                passed = np.ones(b.num_rows, bool)
                for i in range(4):
                    at = b[f"_h{i}"].to_numpy()
                    passed &= (shared.value[at >> 5] >> (at & 31)) & 1 == 1
                yield b.select(["doc_id", "text"]).filter(pa.array(passed == wanted))
        rows = docs.select("doc_id", "text", *hashes)
        return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["text"]]))

    # the same join at every size: a table of ids is never sent to all tasks
    asked = sieve(True).join(trusted.hint("merge"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return asked.unionByName(sieve(False).select("text", F.lit(False).alias("trusted")))


def quality(docs: DataFrame, trusted_ids: DataFrame, q: float = QUANTILE, most: int = HEAD) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold (of the language) and keep of every document."""
    trusted = trusted_ids.select("doc_id").dropna().distinct().withColumn("trusted", F.lit(True))
    counts = saved(gram_counts(with_trust(docs, trusted)))
    table = saved(counts.select("gram", "n_all").join(log_probabilities(counts, model_tables(counts)), "gram"))
    scored = saved(perplexities(docs, table, ["doc_id", "lang"], most))
    good = scored.join(trusted.select("doc_id"), "doc_id", "left_semi").filter("perplexity is not null")
    own = good.groupBy("lang").agg(F.percentile_approx("perplexity", q, 10_000).alias("own")).select(F.col("lang").alias("_lang"), "own")
    every = good.agg(F.percentile_approx("perplexity", q, 10_000).alias("every"))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(every))  # one row
    threshold = F.coalesce("own", "every", F.lit(256.0))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))
