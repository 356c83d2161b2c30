"""Substring dedup by level-wise doubling.

A window of 2L words can repeat across documents only where its two halves of L words do.  Level 1 asks for all
windows of ``base`` words which of them occur in two documents; every further level doubles the length, and asks only
for windows whose halves both survived, until the length is reached (or, without a length, until nothing survives).
At the last level the smallest document that holds a window comes back, and every other holder loses the words.

Levels before the last use short fingerprints, where a chance collision only keeps a candidate too many; the last
level compares 96 bits.

Rules: words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  NULL and empty texts have no words.  Texts shorter than a window
keep everything.  Rows with a NULL id lose nothing and take nothing from others; rows that share an id are one
document to each other and lose the same words to smaller ids.  Repeats inside one document stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from celltable.llm import exchange as X
from celltable.llm.words import byte_classes, from_planes, mix, pack, pieces, planes, split_words, unpack, Words

NONE = np.iinfo(np.int64).max
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,stop:bigint>>"


def ladder(base: int, length: int) -> list[int]:
    """Window lengths: doubled from ``base``, the last one cut to ``length``."""
    out = [min(base, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


class Block:
    """The words of one block, and the windows asked about at each level."""

    def __init__(self, table: pa.Table, second: bool):
        table = X.in_order(table, "mark", "doc_id")
        self.ids = table["doc_id"].to_numpy(zero_copy_only=False)
        self.named = ~np.asarray(table["doc_id"].is_null())
        self.ids = np.where(self.named, self.ids, 0).astype(np.int64)
        self.data, self.off = X.block_texts(table)
        parts, offsets, base = [], [0], 0
        for lo, hi in pieces(self.off):
            a, z = self.off[lo], self.off[hi]
            for seed in (0, 1) if second else (0,):
                w = split_words(self.data[a:z], self.off[lo:hi + 1] - a, byte_classes("space"), seed=seed)
                parts.append((seed, w, a))
            offsets.extend(w.first[1:] + base)
            base += len(w.hash)
        one = [p for p in parts if p[0] == 0]
        empty = np.zeros(0, np.int64)
        self.words = Words(np.concatenate([empty, *[w.start + a for _, w, a in one]]), np.concatenate([empty, *[w.stop + a for _, w, a in one]]),
                           np.concatenate([empty.astype(np.uint64), *[w.hash for _, w, _ in one]]), np.array(offsets, np.int64))
        self.hash2 = np.concatenate([empty.astype(np.uint64), *[w.hash for s, w, _ in parts if s == 1]])
        self.doc_of = self.words.rows()
        self.left = self.words.first[1:][self.doc_of] - np.arange(len(self.words.hash))

    def candidates(self, level: int, lengths: list[int], alive: np.ndarray | None) -> np.ndarray:
        """Places whose window of this level may repeat: both halves do."""
        size = lengths[level]
        ok = (self.left >= size) & self.named[self.doc_of]
        if level:
            step = size - lengths[level - 1]
            at = np.flatnonzero(ok & alive)
            return at[alive[at + step]]
        return np.flatnonzero(ok)

    def fingerprints(self, at: np.ndarray, size: int, hashes: np.ndarray) -> np.ndarray:
        h = np.full(len(at), np.uint64(size))
        for k in range(size):
            h = mix(h, hashes[at + k])
        return h


def _short(block: Block, at: np.ndarray, size: int, shards: int):
    """Distinct (shard, 32 bits) of the windows: sorted keys, place of each window among them, and which of them two
    documents of this block hold."""
    h = block.fingerprints(at, size, block.words.hash)
    key = ((h % np.uint64(shards)) << np.uint64(32)) | (h >> np.uint64(32))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = X.runs_of_equal(key)
    place = np.empty(len(at), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
    doc = block.ids[block.doc_of[at[order]]]
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    return key[first], place, many


def _long(block: Block, at: np.ndarray, size: int, shards: int):
    """Distinct 96-bit windows in shard order, place of each window among them, smallest document of each."""
    h = block.fingerprints(at, size, block.words.hash)
    check = (block.fingerprints(at, size, block.hash2) >> np.uint64(32)).astype(np.uint32)
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((check, h, shard))
    first = X.runs_of_equal(h[order], check[order])
    place = np.empty(len(at), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
    doc = block.ids[block.doc_of[at[order]]]
    least = np.minimum.reduceat(doc, first) if len(first) else doc
    return shard[order][first], h[order][first], check[order][first], place, least


def _merge_short(counts, keys, infos):
    """Answer a bit per entry: do two documents hold the window?"""
    key = np.concatenate([unpack(k, np.uint32) for k in keys])
    many = np.concatenate([X.from_bits(i, n) for i, n in zip(infos, counts, strict=True)])
    order = np.argsort(key, kind="stable")
    first = X.runs_of_equal(key[order])
    size = np.diff(np.append(first, len(key)))
    repeated = (size > 1) | np.logical_or.reduceat(many[order], first)
    flags = np.empty(len(key), bool)
    flags[order] = np.repeat(repeated, size)
    return [X.bits(f) for f in np.split(flags, np.cumsum(counts)[:-1])]


def _merge_long(counts, keys, infos):
    """Answer the smallest document per entry."""
    h = np.concatenate([unpack(k[:8 * n], np.uint64) for k, n in zip(keys, counts, strict=True)])
    check = np.concatenate([from_planes(k[8 * n:], np.uint32) for k, n in zip(keys, counts, strict=True)])
    doc = np.concatenate([from_planes(i, np.int64) for i in infos])
    order = np.lexsort((check, h))
    first = X.runs_of_equal(h[order], check[order])
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(h))))
    return [planes(x) for x in np.split(least, np.cumsum(counts)[:-1])]


def _question(block: Block, number: int, level: int, lengths: list[int], alive, shards: int) -> list[dict]:
    at = block.candidates(level, lengths, alive)
    if level < len(lengths) - 1:
        key, _, many = _short(block, at, lengths[level], shards)
        shard = (key >> np.uint64(32)).astype(np.int64)
        rows = X.ask(number, shards, shard, [(key.astype(np.uint32), pack)], lambda a, z: X.bits(many[a:z]))
    else:
        shard, h, check, _, least = _long(block, at, lengths[level], shards)
        rows = X.ask(number, shards, shard, [(h, pack), (check, planes)], lambda a, z: planes(least[a:z]))
    return [*rows, X.keep_for(number, b"" if alive is None else X.bits(alive))]


def _apply(block: Block, level: int, lengths: list[int], state: bytes, got: list[bytes], shards: int) -> np.ndarray:
    """Places whose window of this level repeats (or, at the last level, is held by a smaller document)."""
    n = len(block.words.hash)
    at = block.candidates(level, lengths, X.from_bits(state, n) if level else None)
    out = np.zeros(n, bool)
    if level < len(lengths) - 1:
        key, place, _ = _short(block, at, lengths[level], shards)
        sizes = np.diff(np.searchsorted(key >> np.uint64(32), np.arange(shards + 1).astype(np.uint64)))
        flags = np.concatenate([np.zeros(0, bool), *[X.from_bits(g, k) for g, k in zip(got, sizes[sizes > 0], strict=True)]])
        out[at] = flags[place]
    else:
        _, _, _, place, _ = _long(block, at, lengths[level], shards)
        least = np.concatenate([np.zeros(0, np.int64), *[from_planes(g, np.int64) for g in got]])
        out[at] = least[place] < block.ids[block.doc_of[at]]
    return out


def _result(block: Block, hit: np.ndarray, size: int) -> pa.Table:
    n, docs = len(block.words.hash), len(block.off) - 1
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    gone = np.cumsum(cover)[:n] > 0
    # bytes of kept words and the one byte behind each, which becomes a space
    spans = np.zeros(len(block.data) + 2, np.int32)
    end = np.minimum(block.words.stop + 1, block.off[1:][block.doc_of])
    np.add.at(spans, block.words.start[~gone], 1)
    np.add.at(spans, end[~gone], -1)
    inside = np.cumsum(spans)[:len(block.data)] > 0
    space = byte_classes("space")
    text = np.where(space[block.data], block.data, np.uint8(0x20))[inside]
    cut = np.concatenate([[0], np.cumsum(inside)])[block.off]
    blob = text.tobytes()
    kept = [blob[a:z].rstrip(b" ").decode() for a, z in zip(cut[:-1], cut[1:], strict=True)]
    edge = np.zeros(n + 1, bool)
    edge[block.words.first] = True
    begin = np.flatnonzero(gone & (~np.concatenate([[False], gone[:-1]]) | edge[:-1])) if n else np.zeros(0, np.int64)
    stop = np.flatnonzero(gone & (~np.concatenate([gone[1:], [False]]) | edge[1:])) + 1 if n else begin
    removed: list[list[dict]] = [[] for _ in range(docs)]
    for a, z in zip(begin, stop, strict=True):
        d = block.doc_of[a]
        removed[d].append({"start": int(a - block.words.first[d]), "stop": int(z - block.words.first[d])})
    lost = np.bincount(block.doc_of[gone], minlength=docs)
    return pa.table({"doc_id": pa.array(block.ids, mask=~block.named), "n_words": np.diff(block.words.first), "n_removed": lost.astype(np.int64),
                     "kept_text": pa.array(kept, pa.string()),
                     "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))})


def remove_repeats(docs: DataFrame, length: int = 13, base: int = 4, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the removed word spans of every document.

    One plan: the texts are dealt to their blocks once, and every level reads that same exchange."""
    lengths = ladder(base, length)
    shards = X.blocks_of(docs, block_bytes=block_bytes)
    mark = F.xxhash64("doc_id", "text")
    dealt = docs.select("doc_id", "text", mark.alias("mark"), X.block_number(mark, shards).alias("block"))
    last = len(lengths) - 1

    def first_pass(table):
        number = table["block"][0].as_py()
        return X.as_table(_question(Block(table, last == 0), number, 0, lengths, None, shards))

    def next_pass(level):
        def run(table, got):
            if not len(table):
                return X.as_table([])
            state, found = X.answers(got)
            block = Block(table, level + 1 == last)
            alive = _apply(block, level, lengths, state, found, shards)
            return X.as_table(_question(block, table["block"][0].as_py(), level + 1, lengths, alive, shards))
        return run

    def last_pass(table, got):
        if not len(table):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()),
                             "removed": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))})
        state, found = X.answers(got)
        block = Block(table, True)
        return _result(block, _apply(block, last, lengths, state, found, shards), lengths[last])

    asked = dealt.groupBy("block").applyInArrow(first_pass, X.ASKED)
    for level in range(last):
        got = X.answered(asked, _merge_short)
        asked = dealt.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(next_pass(level), X.ASKED)
    got = X.answered(asked, _merge_long)
    return dealt.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(last_pass, RESULT)
