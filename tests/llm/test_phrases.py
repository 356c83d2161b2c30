"""Phrase mining against plain counting: parse, counts, cuts, nesting and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from celltable.llm import phrases as P
from celltable.llm.words import text_bytes

from .conftest import SCHEMA, document, prose

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD))]


def brute(rows, least, longest, top):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        own = {p: a for (x, p), a in often.items() if x == lang and len(p) > 1}
        kept = []
        for p, a in own.items():
            if any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in own.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out, key=repr)


def texts():
    r = random.Random(4)
    passage = prose(9, 40, 30)
    rows = [document(100 + i, ". ".join(prose(200 + 10 * i + k, r.randrange(1, 12), 12) for k in range(6)), r.choice(["en", "de", None])) for i in range(40)]
    rows += [document(200 + i, f"{prose(300 + i, 5)}, {passage}! {passage} {prose(i, 3)}", "en") for i in range(15)]
    rows += [document(300, "so " * 500, "en"), document(301, "so so so. SO\tso  so;so", "de"), document(302, "ñandú Über ñandú über,É é É", "en"), document(303, "a\x0bb\x0cc\rd\ne", "")]
    return rows


@pytest.mark.parametrize("least,longest,trigger,block_bytes", [(3, 5, 4, 3000), (2, 3, 2, 500), (5, 2, 1, 1 << 20)])
def test_collocations(spark, edge, edge_rows, least, longest, trigger, block_bytes):
    rows = [*texts(), *edge_rows]
    df = spark.createDataFrame(texts(), SCHEMA).union(edge).withColumns({"rank": F.lit(0), "n": F.lit(1), "phrase": F.lit("x"), "block": F.lit(2)})
    got = P.collocations(df.repartition(5), least, longest, 25, trigger, block_bytes)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows, least, longest, 25)


def test_chunks_hold_every_run_once():
    rows = [t[1] for t in texts()]
    for overlap, trigger in ((4, 4), (2, 3), (1, 2)):
        data, off = text_bytes(pa.array([x.translate(FOLD) for x in rows]))
        row, chunk, closes = P.parsed(data, off, overlap, trigger)
        got = Counter()
        for r, c, last in zip(row.tolist(), chunk.to_pylist(), closes.tolist()):
            w = c.split(" ")
            owned = len(w) if last else len(w) - overlap
            assert owned > 0
            got.update((r, tuple(w[i:i + k])) for i in range(owned) for k in range(1, overlap + 2) if i + k <= len(w))
        assert got == Counter((r, tuple(w[i:i + k])) for r, x in enumerate(rows) for w in pieces_of(x) for k in range(1, overlap + 2) for i in range(len(w) - k + 1))


def test_equal_passages_share_their_chunks():
    passage = prose(77, 400, 5000)
    data, off = text_bytes(pa.array([f"{prose(s, 30, 5000)} {passage} {prose(s + 1, 30, 5000)}" for s in (1, 5)]))
    row, chunk, _ = P.parsed(data, off, 4, 16)
    a, b = ({c for r, c in zip(row.tolist(), chunk.to_pylist()) if r == k} for k in (0, 1))
    assert len(a & b) > 0.6 * min(len(a), len(b))


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    got = spark.sql(f"select (cast({big}L as decimal(19,0)) * cast({7 * big}L as decimal(19,0)) * 1000BD) div (cast({big + 1}L as decimal(19,0)) * cast({big - 1}L as decimal(19,0))) as s").first().s
    assert got == 1000 * big * 7 * big // ((big + 1) * (big - 1))


def test_nothing(empty, spark):
    assert P.collocations(empty).count() == 0
    blank = spark.createDataFrame([document(1, None), document(2, " .,! "), document(3, "")], SCHEMA)
    assert P.collocations(blank, 1).count() == 0
    assert P.spans(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).to_pylist() == []
