"""URL filter by cascades of Bloom filters.

A cascade answers "is this key listed?" for every key of the corpus, without error and without a join.  Level 1 holds
the listed keys; level 2 holds the unlisted keys that level 1 lets through; level 3 the listed keys that level 2 lets
through; and so on until a level lets nothing wrong through.  A key's answer is read off the first level it misses.

Rules: a URL that is NULL or has no ``://`` has empty host and path.  A rule (host, path) fits that host and its
subdomains where the path starts with the rule's; the longest fitting rule wins, of equally long ones the larger text.
A URL without a rule is blocked if its host or a parent host is listed, else allowed.  Repeated rules and hosts count
once; a rule given as both allow and block blocks.  Empty tables are fine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from celltable.llm.store import quoted, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_KEYS = 1 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to ``/?#`` in lower case, path from there up to ``?#``."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fingerprints(key: Column) -> list[Column]:
    """128 bits of a key."""
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def _spots(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    a = a + np.uint64(0x9E3779B97F4A7C15 * level % 2**64)
    a ^= a >> np.uint64(31)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    return np.stack([(a + np.uint64(j) * b) >> np.uint64(7) for j in range(k)]) % np.uint64(bits)


@dataclass
class Cascade:
    """Filter levels; each is (bits, number of hashes)."""

    levels: list[tuple[np.ndarray, int]]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        live = np.arange(len(h1))
        for depth, (bits, k) in enumerate(self.levels):
            live = live[_inside(h1[live], h2[live], depth, bits, k)]
            out[live] = depth % 2 == 0
        return out


def _inside(h1, h2, depth, bits, k) -> np.ndarray:
    spots = _spots(h1, h2, depth, k, len(bits) * 64)
    return ((bits[spots >> np.uint64(6)] >> (spots & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)


def _level(keys: DataFrame, n: int, depth: int, rate: float) -> tuple[np.ndarray, int]:
    """One filter of n keys: tasks turn keys into words of bits, which are or-ed per word before they come together."""
    k = max(1, round(-math.log2(rate)))
    words = max(1, math.ceil(n * k / math.log(2) / 64))

    def bits(batches):
        own = np.zeros(words, np.uint64)
        for b in batches:
            spots = _spots(b["h1"].to_numpy(), b["h2"].to_numpy(), depth, k, words * 64).ravel()
            np.bitwise_or.at(own, spots >> np.uint64(6), np.uint64(1) << (spots & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"word": at.astype(np.int64), "set": own[at].view(np.int64)})

    got = keys.select("h1", "h2").mapInArrow(bits, "word bigint, set bigint").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got["word"].to_numpy()] = got["set"].to_numpy().view(np.uint64)
    return out, k


def build_cascade(listed: DataFrame, universe: DataFrame, first_rate: float = 1 / 64) -> Cascade:
    """Cascade of the ``key`` column of ``listed``, exact for every ``key`` of ``universe``.

    Levels come to the driver as bits only: about n x 9 bits for the first, fewer for each further one."""
    def hashed(df):
        h1, h2 = fingerprints(F.col("key"))
        return df.select("key").dropna().distinct().select("key", h1.alias("h1"), h2.alias("h2"))

    inside = saved(hashed(listed))
    outside = saved(hashed(universe).join(inside.select("key"), "key", "left_anti"))
    levels: list[tuple[np.ndarray, int]] = []
    held, other, n = inside, outside, inside.count()
    while n:
        levels.append(_level(held, n, len(levels), 0.5 if levels else first_rate))
        bits, k = levels[-1]

        def through(batches, depth=len(levels) - 1, bits=bits, k=k):
            for b in batches:
                yield b.filter(pa.array(_inside(b["h1"].to_numpy(), b["h2"].to_numpy(), depth, bits, k)))

        held, other = saved(other.mapInArrow(through, other.schema)), held
        n = held.count()
        if len(levels) > 200:
            raise RuntimeError("two keys share all 128 bits of their fingerprints")
    return Cascade(levels)


def build_blocks(listed: DataFrame, universe: DataFrame, block_keys: int = BLOCK_KEYS) -> list[tuple[int, int, Cascade]]:
    """(block, blocks, cascade): a list of any length is cut by key hash, so that one cascade stays near a megabyte."""
    blocks = max(1, math.ceil(listed.count() / block_keys))
    if blocks == 1:
        return [(0, 1, build_cascade(listed, universe))]
    mine = F.pmod(F.xxhash64("key"), F.lit(blocks))
    return [(b, blocks, build_cascade(listed.filter(mine == b), universe.filter(mine == b))) for b in range(blocks)]


def with_listed(df: DataFrame, cascades: list[tuple[int, int, Cascade]], keys: dict[str, Column]) -> DataFrame:
    """A boolean column per key column: is the key listed?  One pass of the rows for each block of the list."""
    df = df.withColumns({name: F.lit(False) for name in keys})
    for block, blocks, cascade in cascades:
        @F.pandas_udf("boolean")
        def has(h1, h2, cascade=cascade):
            import pandas as pd
            return pd.Series(cascade.has(h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

        found = {}
        for name, key in keys.items():
            h1, h2 = fingerprints(key)
            found[name] = F.col(name) | (key.isNotNull() & (F.pmod(h1, F.lit(blocks)) == block) & has(h1, h2))
        df = df.withColumns(found)
    return df


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> list[Column]:
    """Host suffixes of up to ``labels`` labels with path prefixes of the given lengths; NULL where the URL is shorter."""
    parts = F.split(host, r"\.")
    out = []
    for n in range(1, labels + 1):
        suffix = F.when((F.size(parts) >= n) & (host != ""), F.array_join(F.slice(parts, -n, n), "."))
        for size in lengths:
            out.append(F.when(F.length(path) >= size, F.concat(suffix, F.substring(path, 1, size))))
    return out


def url_filter(pages: DataFrame, rules: DataFrame, hosts: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, ``rule`` and ``verdict``, and ``listed`` (the host list's answer).

    ``rules``: host, path, verdict (allow or block).  ``hosts``: host, each blocked with all its subdomains."""
    host, path = url_parts(F.col(quoted(url_col)))
    urls = pages.select(F.col(quoted(id_col)), host.alias("host"), path.alias("path"))
    rules = rules.select(F.concat("host", "path").alias("key"), "host", "path", "verdict").dropna()
    hosts = hosts.select(F.col("host").alias("key"), "host", F.lit("").alias("path")).dropna()

    def shape(df):  # label count and prefix lengths: a row per length that occurs
        rows = df.groupBy(F.length("path").alias("size")).agg(F.max(F.size(F.split("host", r"\."))).alias("labels")).collect()
        return max((r["labels"] for r in rows), default=0), sorted(r["size"] for r in rows)

    keys = {kind: candidate_keys(F.col("host"), F.col("path"), *shape(df)) for kind, df in (("rule", rules), ("host", hosts))}

    def universe(kind):
        own = keys[kind]
        return urls.select(F.explode(F.array(*own) if own else F.array().cast("array<string>")).alias("key")).dropna().distinct()

    all_rules, all_hosts = saved(universe("rule")), saved(universe("host"))
    asked = {"_r": (build_blocks(rules, all_rules), keys["rule"]),
             "_b": (build_blocks(rules.filter("verdict = 'block'"), all_rules), keys["rule"]),
             "_h": (build_blocks(hosts, all_hosts), keys["host"])}
    df = urls
    for mark, (cascades, own) in asked.items():
        df = with_listed(df, cascades, {f"{mark}{i}": c for i, c in enumerate(own)})
    hits = [F.when(F.col(f"_r{i}"), F.struct(F.length(k).alias("n"), k.alias("key"), F.col(f"_b{i}").alias("block")))
            for i, k in enumerate(keys["rule"])]
    best = F.array_max(F.filter(F.array(*hits), lambda x: x.isNotNull())) if hits else F.lit(None).cast("struct<n:int,key:string,block:boolean>")
    listed = F.lit(False)
    for i in range(len(keys["host"])):
        listed = listed | F.col(f"_h{i}")
    return (df.withColumns({"_best": best, "listed": listed})
            .select(F.col(quoted(id_col)), "host", "path", F.col("_best.key").alias("rule"),
                    F.when(F.coalesce(F.col("_best.block"), F.col("listed")), "block").otherwise("allow").alias("verdict"), "listed"))
