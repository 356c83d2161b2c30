"""Two-way exchange of fingerprints between blocks of texts and shards of the fingerprint space.

A block is a bounded bundle of whole texts, dealt by hash.  It asks every shard about its own distinct fingerprints in
one packed row; the shard merges the rows of all blocks and answers each row in its own order.  A fingerprint in a
third of all texts is one entry per block, so no group grows with a hot value.  What a block needs again later travels
beside its questions under a shard number of its own (negative).

Blocks and shards grow in number with the corpus, not in size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from celltable.llm.words import text_bytes

BLOCK_BYTES = 8 << 20
ASKED = "block bigint, shard bigint, n bigint, keys binary, info binary"
ANSWERED = "block bigint, shard bigint, info binary"


def blocks_of(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks that hold about ``block_bytes`` of text each."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, math.ceil(size / block_bytes))


def block_number(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(blocks)).cast("bigint")


def in_order(table: pa.Table, *by: str) -> pa.Table:
    """The rows of a block in the same order every time."""
    return table.take(table.select(list(by)).append_column("_i", pa.array(np.arange(len(table)))).sort_by([(c, "ascending") for c in by])["_i"])


def block_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(table["text"])


def ask(block: int, shards: int, shard: np.ndarray, keys: list[tuple[np.ndarray, Callable]], info: Callable | None) -> list[dict]:
    """Rows for entries sorted by shard: ``keys`` are arrays with their packers, laid one behind the other."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    rows = []
    for s in np.flatnonzero(np.diff(cut)):
        a, z = cut[s], cut[s + 1]
        rows.append({"block": block, "shard": int(s), "n": int(z - a), "keys": b"".join(p(k[a:z]) for k, p in keys), "info": info(a, z) if info else None})
    return rows


def keep_for(block: int, state: bytes) -> dict:
    """A row that comes back to its block unchanged."""
    return {"block": block, "shard": -1 - block, "n": 0, "keys": None, "info": state}


def as_table(rows: list[dict]) -> pa.Table:
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("info", pa.binary())])
    return pa.Table.from_pylist(rows, schema)


def answered(asked: DataFrame, merge: Callable) -> DataFrame:
    """``merge(counts, keys, infos) -> answers``: one bytes object per row of a shard."""
    def run(table):
        if table["shard"][0].as_py() < 0:
            return table.select(["block", "shard", "info"])
        out = merge(table["n"].to_numpy(), table["keys"].to_pylist(), table["info"].to_pylist())
        return pa.table({"block": table["block"], "shard": table["shard"], "info": pa.array(out, pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, ANSWERED)


def answers(table: pa.Table) -> tuple[bytes | None, list[bytes]]:
    """(kept state, answers in shard order) of one block."""
    rows = sorted(zip(table["shard"].to_pylist(), table["info"].to_pylist(), strict=True), key=lambda r: r[0])
    state = next((i for s, i in rows if s < 0), None)
    return state, [i for s, i in rows if s >= 0]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(blob: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob or b"", np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


def runs_of_equal(*keys: np.ndarray) -> np.ndarray:
    """First index of every run of equal entries in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)
