"""Benchmark decontamination with suffix arrays of the training texts.

Every task sorts the suffixes of its own texts (word by word) and binary-searches every suffix of the test texts in
them: the run of equal prefixes holds all verbatim occurrences.  A window is 13 consecutive words of a test item; a
shorter item is one window.  Only suffixes made of test vocabulary for a whole window can match, so only those are
sorted.  The test texts are a stated set: they go to the tasks in blocks of bounded size, one pass per block, and each
pass adds to what the earlier ones found.  Nothing is shuffled, and the rows keep their identity.

Rules: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  NULL or empty texts have no words and
no hits.  Items with a NULL id or without words take no part; an item given twice counts once, with the windows of
both texts.  Repeated documents are judged each.  Extra columns are ignored or carried along, as asked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from celltable.llm.store import with_own
from celltable.llm.words import byte_classes, lower_table, pieces, split_words, text_bytes

WINDOW, BLOCK_WORDS, PAIRS = 13, 1 << 18, 1 << 21
FOUND = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>, longest bigint"


@dataclass
class TestBlock:
    """Test texts as ranks in their own vocabulary (1 and up), with suffixes grouped by window length."""

    vocabulary: np.ndarray
    ranks: np.ndarray
    ids: np.ndarray
    item_of: np.ndarray
    suffixes: dict[int, np.ndarray]

    @classmethod
    def of(cls, ids: list[str], texts: list[str]) -> TestBlock:
        data, off = text_bytes(pa.array(texts, pa.large_string()))
        words = split_words(data, off, byte_classes("alnum"), lower_table())
        vocabulary, ranks = np.unique(words.hash, return_inverse=True)
        names, number = np.unique(np.array(ids, object).astype(str), return_inverse=True)
        suffixes: dict[int, list] = {}
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b > a:
                size = min(WINDOW, int(b - a))
                suffixes.setdefault(size, []).append(np.arange(a, b - size + 1))
        return cls(vocabulary, ranks.astype(np.int64) + 1, names, number[words.rows()] if len(ids) else np.zeros(0, np.int64),
                   {k: np.concatenate(v) for k, v in suffixes.items()})

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            seen = np.zeros(1 << 20, bool)
            seen[self.vocabulary >> np.uint64(44)] = True
            maybe = np.flatnonzero(seen[hashes >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == hashes[maybe]
            out[maybe[hit]] = at[hit] + 1
        return out


def suffix_array(ranks: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in the order of their first ``depth`` words."""
    return starts[np.lexsort([ranks[starts + k] for k in range(depth - 1, -1, -1)])]


def search(ranks: np.ndarray, array: np.ndarray, tests: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) in the suffix array of the suffixes that begin with each test suffix's first ``depth`` words."""
    def cut(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(array), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            at = array[np.minimum(mid, len(array) - 1)]
            order = np.zeros(len(wanted), np.int8)
            for k in range(depth):
                a, b = ranks[at + k], tests[wanted + k]
                order = np.where(order == 0, (a > b).astype(np.int8) - (a < b), order)
            right = open_ & ((order < 0) | (after_equal & (order == 0)))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    return cut(False), cut(True)


def _runs(mark: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, stop) of marked runs; a run ends at the end of its row."""
    edge = np.zeros(len(mark) + 1, bool)
    edge[first] = True
    begin = mark & (~np.concatenate([[False], mark[:-1]]) | edge[:-1])
    end = mark & (~np.concatenate([mark[1:], [False]]) | edge[1:])
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _overlaps(block: TestBlock, data: np.ndarray, off: np.ndarray, earlier: dict | None) -> dict:
    """What one run of texts shares with one block of test texts."""
    words = split_words(data, off, byte_classes("alnum"), lower_table())
    n, docs = len(words.hash), len(off) - 1
    ranks = block.rank(words.hash)
    stop = np.minimum.accumulate(np.where(ranks == 0, np.arange(n), n)[::-1])[::-1] if n else np.zeros(0, np.int64)
    doc_of = words.rows()
    run = np.minimum(stop, words.first[1:][doc_of]) - np.arange(n)
    cover = np.zeros(n + 1, np.int64)
    longest = np.zeros(docs, np.int64)
    found = []
    if earlier is not None:
        for d, (spans, items, most) in enumerate(zip(earlier["spans"], earlier["items"], earlier["longest"], strict=True)):
            longest[d] = most
            for s in spans:
                cover[words.first[d] + s["start"]] += 1
                cover[words.first[d] + s["stop"]] -= 1
            found += [(d, i) for i in items]
    pairs = []
    for depth, wanted in block.suffixes.items():
        starts = np.flatnonzero(run >= depth)
        if not len(starts):
            continue
        array = suffix_array(ranks, starts, depth)
        low, high = search(ranks, array, block.ranks, wanted, depth)
        some = np.flatnonzero(high > low)
        size = np.cumsum(high[some] - low[some])
        slices = np.split(some, np.searchsorted(size, np.arange(PAIRS, size[-1], PAIRS))) if len(some) else []
        for part in slices:
            count = high[part] - low[part]
            test = np.repeat(wanted[part], count)
            place = array[np.repeat(low[part] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + depth, -1)
            pairs.append(np.unique(doc_of[place] * len(block.ids) + block.item_of[test]))
            # occurrences on one diagonal that follow each other are one longer match
            order = np.lexsort((place, place - test))
            p, diagonal, d = place[order], (place - test)[order], doc_of[place][order]
            item = block.item_of[test][order]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1] + 1) | (diagonal[1:] != diagonal[:-1]) | (d[1:] != d[:-1]) | (item[1:] != item[:-1])
            at = np.flatnonzero(new)
            np.maximum.at(longest, d[at], np.diff(np.append(at, len(p))) + depth - 1)
    mark = np.cumsum(cover)[:n] > 0
    begin, end = _runs(mark, words.first)
    for x in pairs:
        found += [(int(v // len(block.ids)), block.ids[v % len(block.ids)]) for v in x]
    items: list[list[str]] = [[] for _ in range(docs)]
    for d, i in dict.fromkeys(found):
        items[d].append(str(i))
    spans: list[list[dict]] = [[] for _ in range(docs)]
    for a, b in zip(begin, end, strict=True):
        base = words.first[doc_of[a]]
        spans[doc_of[a]].append({"start": int(a - base), "stop": int(b - base)})
    return {"n_words": np.diff(words.first).tolist(), "spans": spans, "items": [sorted(i) for i in items], "longest": longest.tolist()}


def test_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list[TestBlock]:
    """The test texts in blocks of about ``block_words`` words, dealt by id; each block comes to the driver alone."""
    items = (benchmark.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / 6 / block_words))
    out = []
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == b).toArrow()
        out.append(TestBlock.of(rows["id"].to_pylist(), rows["text"].to_pylist()))
    return out


def with_overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The ``keep`` columns of every document, its word count, the word spans shared with the benchmark, the ids of
    the items they come from, and the length of the longest verbatim match."""
    blocks = test_blocks(benchmark, block_words=block_words)
    extra = T._parse_datatype_string(FOUND)
    df = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    for number, block in enumerate(blocks):
        last = number == len(blocks) - 1
        fields = [f for f in df.schema.fields if f.name in keep or (f.name == "_text" and not last)] + list(extra.fields)
        names = [f.name for f in fields]
        found_type = {f.name: f.type for f in to_arrow_schema(extra)}

        def run(batches, block=block, names=names, number=number, found_type=found_type):
            for b in batches:
                data, off = text_bytes(b["_text"])
                for lo, hi in pieces(off):
                    part = b.slice(lo, hi - lo)
                    earlier = {k: part[k].to_pylist() for k in ("spans", "items", "longest")} if number else None
                    got = _overlaps(block, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], earlier)
                    cols = [pa.array(got[c], found_type[c]) if c in got else part[c] for c in names]
                    yield pa.RecordBatch.from_arrays(cols, names)

        df = df.mapInArrow(run, T.StructType(fields))
    return df


def n_hit(spans: Column | str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])


def contaminated(hit: Column, words: Column) -> Column:
    """At least one word in twenty lies in a window of the benchmark."""
    return (hit > 0) & (20 * hit >= words)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with their own columns, that are not contaminated."""
    found = with_overlaps(with_own(docs, "text"), benchmark, ["own"])
    return found.filter(~contaminated(n_hit(), F.col("n_words"))).select("own.*")
