"""Phrase collocations over a prefix-free parse of the corpus.

1. Parse: pieces between punctuation are cut at trigger windows, runs of ``longest - 1`` words whose hash is 0 modulo
   TRIGGER, so equal passages are cut alike wherever they stand.  A chunk reaches from one trigger to the end of the next
   trigger's window; neighbours overlap by that window.  Distinct chunks with their frequencies are the dictionary.
2. Counting goes over the dictionary, weighted by frequency.  A chunk owns the phrases that begin before its closing
   window, so each occurrence is counted in one chunk alone, and each lies inside it whole.
3. Words, then pairs of frequent words, then longer runs of frequent pairs are counted: blocks of the dictionary ask shards of
   the fingerprint space for the totals (``exchange``), and one asking block of each frequent phrase spells it.
4. Scores, nesting and ranks are joins over the frequent phrases.

Everything is per language.  Fingerprints have 64 bits.  Rules: A-Z are lower-cased, pieces end at ``[.,;:!?\\x0A-\\x0D]``, words
are ``[^\\x20\\x09]+``; a NULL text has no words, a NULL language is ``und``.  Repeated rows count as often as they stand.  A table
without words gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from celltable.llm import exchange as X
from celltable.llm.store import ready, saved
from celltable.llm.words import from_planes, lower_table, mix, pack, pieces, planes, split_words, text_bytes, unpack

LEAST, LONGEST, TOP, TRIGGER = 100, 5, 2000, 16
SHARES = 64
BLOCK_BYTES, BLOCKS_A_TASK = 8 << 20, 4

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_INSIDE = np.ones(256, bool)
_INSIDE[0x20] = False


def spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Byte ranges, which may overlap, as a string array."""
    size = stop - start
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    raw = data[np.arange(off[-1]) + np.repeat(start - off[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())


def run_hash(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(at), np.uint64(size))
    for k in range(size):
        out = mix(out, h[at + k])
    return out


def parsed(data: np.ndarray, off: np.ndarray, overlap: int, trigger: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, chunk, does it close its piece) of lower-cased texts."""
    w = split_words(data, off, _WORD)
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, bool)
    row, ends = w.rows(), np.cumsum(_ENDS[data])[w.start]
    fresh = np.ones(n, bool)
    fresh[1:] = (row[1:] != row[:-1]) | (ends[1:] != ends[:-1])
    piece = np.cumsum(fresh) - 1
    stop = np.append(np.flatnonzero(fresh)[1:], n)[piece]
    at = np.flatnonzero(stop - np.arange(n) >= overlap)
    cut = fresh.copy()
    cut[at[run_hash(w.hash, at, overlap) % np.uint64(trigger) == 0]] = True
    a = np.flatnonzero(cut)
    after = np.append(a[1:], n)
    inner = np.append(piece[a[1:]] == piece[a[:-1]], False)
    b = np.where(inner, after + overlap, stop[a])
    # words side by side, one space behind each
    size = w.stop - w.start
    place = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(place[-1], 0x20, np.uint8)
    held = np.ones(place[-1], bool)
    held[place[1:] - 1] = False
    text[held] = data[_WORD[data]]
    return row[a], spans(text, place[a], place[b] - 1), ~inner


def dictionary(docs: DataFrame, overlap: int, trigger: int) -> DataFrame:
    """lang, chunk, closes, freq: the distinct chunks of the corpus."""
    def run(batches):
        for batch in batches:
            lang = pc.fill_null(batch["lang"].cast(pa.string()), "und")
            data, off = text_bytes(batch["text"])
            data = lower_table()[data]
            for lo, hi in pieces(off):
                row, chunk, closes = parsed(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], overlap, trigger)
                t = pa.table({"lang": lang.take(pa.array(row + lo)), "chunk": chunk, "closes": closes})
                t = t.group_by(["lang", "chunk", "closes"]).aggregate([([], "count_all")]).select(["lang", "chunk", "closes", "count_all"])
                yield from t.rename_columns(["lang", "chunk", "closes", "freq"]).to_batches()

    found = docs.select("lang", "text").mapInArrow(run, "lang string, chunk string, closes boolean, freq bigint")
    return found.groupBy("lang", "chunk", "closes").agg(F.sum("freq").alias("freq"))


def language_seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


_BLOCK_SQL = "block bigint, langs array<string>, n array<bigint>, words array<string>, word_lang binary, prints binary, ids binary, sizes binary, freq binary, closes binary"


def packed_block(number: int, table: pa.Table, overlap: int) -> dict:
    """One row: the block's lexicon of (language, word), and its chunks as numbers of the lexicon."""
    langs, of = np.unique(np.array(table["lang"].to_pylist(), object), return_inverse=True)
    data, off = text_bytes(table["chunk"])
    w = split_words(data, off, _INSIDE)
    sizes = np.diff(w.first)
    seeds = np.array([language_seed(x) for x in langs], np.uint64)
    word_lang = np.repeat(of, sizes)
    prints, first, ids = np.unique(mix(w.hash, seeds[word_lang]), return_index=True, return_inverse=True)
    freq, closes = table["freq"].to_numpy(), table["closes"].to_numpy(zero_copy_only=False)
    owned = freq * np.where(closes, sizes, sizes - overlap)
    return {"block": number, "langs": langs.tolist(), "n": [int(owned[of == k].sum()) for k in range(len(langs))], "words": spans(data, w.start[first], w.stop[first]).to_pylist(),
            "word_lang": planes(word_lang[first].astype(np.uint32)), "prints": pack(prints), "ids": planes(ids.astype(np.uint32)), "sizes": planes(sizes.astype(np.uint32)),
            "freq": planes(freq.astype(np.uint64)), "closes": X.bits(closes)}


def packed(entries: DataFrame, overlap: int, block_bytes: int) -> DataFrame:
    """The dictionary in blocks of about ``block_bytes``, one row each."""
    schema = pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("word_lang", "prints", "ids", "sizes", "freq", "closes")]])

    def run(batches):
        from pyspark import TaskContext
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            held.append(batch)
            size += batch["chunk"].nbytes
            if size >= block_bytes:
                yield pa.RecordBatch.from_pylist([packed_block(base + number, pa.Table.from_batches(held), overlap)], schema)
                number, held, size = number + 1, [], 0
        if size:
            yield pa.RecordBatch.from_pylist([packed_block(base + number, pa.Table.from_batches(held), overlap)], schema)

    return entries.mapInArrow(run, _BLOCK_SQL)


class _Block:
    """A block's word numbers, with the weight of every place, and the phrases that survive level by level."""

    def __init__(self, table: pa.Table, overlap: int):
        row = table.to_pylist()[0]
        self.number, self.row = row["block"], row
        self.prints, self.ids = unpack(row["prints"], np.uint64), from_planes(row["ids"], np.uint32).astype(np.int64)
        sizes, freq = from_planes(row["sizes"], np.uint32).astype(np.int64), from_planes(row["freq"], np.uint64)
        closes = X.from_bits(row["closes"], len(sizes))
        place = np.arange(len(self.ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.left = np.repeat(sizes, sizes) - place
        self.weight = np.where(place < np.repeat(np.where(closes, sizes, sizes - overlap), sizes), np.repeat(freq, sizes), np.uint64(0)).astype(np.float64)

    def words(self):
        """(fingerprint, count) of every (language, word)."""
        return self.prints, np.bincount(self.ids, self.weight, len(self.prints))

    def pairs(self, often: np.ndarray):
        """(fingerprint, count, first place) of the pairs of frequent words, and the pair number of every place (or -1)."""
        ok = often[self.ids]
        at = np.flatnonzero(ok[:-1] & ok[1:] & (self.left[:-1] > 1)) if len(ok) > 1 else np.zeros(0, np.int64)
        _, first, of = np.unique(self.ids[at] * len(self.prints) + self.ids[at + 1], return_index=True, return_inverse=True)
        number = np.full(len(self.ids), -1)
        number[at] = of
        first = at[first]
        return self.run(first, 2), np.bincount(of, self.weight[at], len(first)), first, number

    def run(self, at: np.ndarray, size: int) -> np.ndarray:
        return run_hash(self.prints[self.ids], at, size)

    def longer(self, often: np.ndarray, number: np.ndarray, longest: int):
        """(fingerprint, count, first place, length) of the runs of frequent pairs, three words and more."""
        good = np.append(often, False)[number]
        out, ok = [], good.copy()
        for size in range(3, longest + 1):
            ok = ok[:-1] & good[size - 2:] if len(ok) > 1 else ok[:0]
            at = np.flatnonzero(ok & (self.left[:len(ok)] >= size))
            prints, first, of = np.unique(self.run(at, size), return_index=True, return_inverse=True)
            out.append((prints, np.bincount(of, self.weight[at], len(first)), at[first], np.full(len(first), size)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _asked(block: int, shards: int, prints: np.ndarray, counts: np.ndarray, state: tuple = ()) -> pa.Table:
    shard = (prints % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((prints, shard))
    n = counts[order].astype(np.uint64)
    rows = X.ask(block, shards, shard[order], [(prints[order], pack)], lambda a, z: planes(n[a:z]))
    return X.as_table([*rows, X.keep_for(block, pickle.dumps((order.astype(np.int32), *state)))])


def _totals(got: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(total, or 0 where it is not frequent; is this block to spell it) in the order asked, and the kept state."""
    state, found = X.answers(got)
    order, *rest = pickle.loads(state)
    said = np.concatenate([np.zeros(0, np.uint64), *[from_planes(f, np.uint64) for f in found]])
    out = np.empty(len(order), np.uint64)
    out[order] = said
    return out >> np.uint64(1), (out & np.uint64(1)).astype(bool), tuple(rest)


def _answered(asked: DataFrame, least: int, tasks: int) -> DataFrame:
    """Twice the total of every frequent phrase, plus one for the first block that asks about it."""
    def run(table):
        if table["shard"][0].as_py() < 0:
            return table.select(["block", "shard", "info"])
        table = table.sort_by("block")
        key = np.concatenate([unpack(k, np.uint64) for k in table["keys"].to_pylist()])
        own = np.concatenate([from_planes(i, np.uint64) for i in table["info"].to_pylist()])
        order = np.argsort(key, kind="stable")
        first = X.runs_of_equal(key[order])
        total = np.add.reduceat(own[order], first)
        total[total < least] = 0
        said = np.repeat(total * np.uint64(2), np.diff(np.append(first, len(key))))
        said[first] += total > 0
        out = np.empty(len(key), np.uint64)
        out[order] = said
        parts = [planes(x) for x in np.split(out, np.cumsum(table["n"].to_numpy())[:-1])]
        return pa.table({"block": table["block"], "shard": table["shard"], "info": pa.array(parts, pa.binary())})

    return asked.repartition(tasks, "shard").groupBy("shard").applyInArrow(run, X.ANSWERED)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, trigger: int = TRIGGER, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of 1 to ``longest`` words with f >= least, and (lang, n)."""
    spark, overlap = docs.sparkSession, longest - 1
    ready(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/phrases-{uuid.uuid4().hex}"
    packed(dictionary(docs, overlap, trigger), overlap, block_bytes).write.parquet(path)
    blocks = spark.read.parquet(path)
    shards = max(1, blocks.count())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shards / BLOCKS_A_TASK))
    narrow = blocks.drop("words", "langs", "n", "word_lang").repartition(tasks, "block")

    def both(left: DataFrame, got: DataFrame, run, schema: str) -> DataFrame:
        return left.groupBy("block").cogroup(got.repartition(tasks, "block").groupBy("block")).applyInArrow(run, schema)

    def ask_words(table):
        b = _Block(table, overlap)
        return _asked(b.number, shards, *b.words())

    def ask_pairs(table, got):
        b = _Block(table, overlap)
        total, spell, _ = _totals(got)
        prints, counts, _, _ = b.pairs(total > 0)
        return _asked(b.number, shards, prints, counts, (X.bits(total > 0), X.bits(spell), total[spell]))

    def ask_longer(table, got):
        b = _Block(table, overlap)
        total, spell, (often, *ones) = _totals(got)
        _, _, _, number = b.pairs(X.from_bits(often, len(b.prints)))
        prints, counts, _, _ = b.longer(total > 0, number, longest)
        return _asked(b.number, shards, prints, counts, (often, *ones, X.bits(total > 0), X.bits(spell), total[spell]))

    def chosen(table, got):
        """The phrases that this block is to spell, as numbers of its lexicon."""
        b = _Block(table, overlap)
        total, spell, (often, word_bits, word_total, pairs_often, pair_bits, pair_total) = _totals(got)
        one = np.flatnonzero(X.from_bits(word_bits, len(b.prints)))
        _, _, first, number = b.pairs(X.from_bits(often, len(b.prints)))
        two = first[np.flatnonzero(X.from_bits(pair_bits, len(first)))]
        _, _, at, size = b.longer(X.from_bits(pairs_often, len(first)), number, longest)
        ids = [[i] for i in one.tolist()] + [b.ids[a:a + k].tolist() for a, k in zip([*two.tolist(), *at[spell].tolist()], [2] * len(two) + size[spell].tolist())]
        return pa.table({"block": pa.array([b.number] * len(ids), pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())),
                         "f": pa.array(np.concatenate([word_total, pair_total, total[spell]]).astype(np.int64))})

    def spelled(table, got):
        row, ids = table.to_pylist()[0] if len(table) else {}, got["ids"].to_pylist()
        of = from_planes(row["word_lang"], np.uint32) if row else None
        return pa.table({"lang": pa.array([row["langs"][of[i[0]]] for i in ids], pa.string()), "size": pa.array([len(i) for i in ids], pa.int32()),
                         "phrase": pa.array([" ".join(row["words"][k] for k in i) for i in ids], pa.string()), "f": got["f"]})

    got = _answered(narrow.groupBy("block").applyInArrow(ask_words, X.ASKED), least, tasks)
    for ask in (ask_pairs, ask_longer):
        got = _answered(both(narrow, got, ask, X.ASKED), least, tasks)
    numbers = both(narrow, got, chosen, "block bigint, ids array<bigint>, f bigint")
    lexicons = blocks.select("block", "langs", "words", "word_lang").repartition(tasks, "block")
    found = both(lexicons, numbers, spelled, "lang string, size int, phrase string, f bigint")
    totals = blocks.select(F.explode(F.arrays_zip("langs", "n")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.n").alias("n"))
    return saved(found), totals


def _part(first: Column, size: Column) -> Column:
    """Words ``first`` to ``first + size - 1`` of the phrase, joined by spaces."""
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, trigger: int = TRIGGER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words or more.

    a counts the phrase, l and r the two parts of its lowest-scoring cut, score = floor(1000 a n / (l r)); phrases inside a longer
    one that stands as often are left out."""
    found, totals = frequent_phrases(docs, least, longest, trigger, block_bytes)
    long = found.filter("size > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = long.join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "n", "size", cut.alias("k"))
    cuts = cuts.withColumns({"head": _part(F.lit(1), F.col("k")), "tail": _part(F.col("k") + 1, F.col("size") - F.col("k"))})
    known = found.select("lang", "phrase", "f")
    cuts = cuts.join(known.toDF("lang", "head", "l"), ["lang", "head"]).join(known.toDF("lang", "tail", "r"), ["lang", "tail"])
    wide = "(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    cuts = cuts.withColumn("score", F.expr(wide))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = long.filter("size > 2").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    inner = inner.select("lang", _part(F.col("at"), F.col("k")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter("around is null or around < a")
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within shares of a language, so that the last step sees SHARES * top rows of it at most
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*best))).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
