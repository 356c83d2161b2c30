"""Class model: exchange moves, counts and probabilities against plain Python, sums to one, edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from celltable.llm import brown_classes as B
from celltable.llm.words import from_planes

from .conftest import SCHEMA, document, prose

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def texts():
    """Sentences that alternate two kinds of words, with rare and unseen ones."""
    r = random.Random(8)
    rows = []
    for i in range(120):
        w = [f"{'ab'[k % 2]}{min(r.randrange(12), r.randrange(12))}" if r.random() < 0.93 else f"x{r.randrange(10_000)}" for k in range(r.randrange(40))]
        rows.append(document(1000 + i, " ".join(w)))
    return rows


def test_moves_are_the_best_exchange():
    rng = np.random.default_rng(0)
    many, k = 25, 5
    big = rng.poisson(1.5, (many, many)).astype(float)
    of = rng.integers(1, k + 1, many)

    def table(of):
        n = np.zeros((k + 1, k + 1))
        np.add.at(n, (of[:, None].repeat(many, 1), of[None, :].repeat(many, 0)), big)
        return n

    for w in range(many):
        n, own = table(of), big[w, w]
        right, left = np.bincount(of, big[w], k + 1), np.bincount(of, big[:, w], k + 1)
        right[of[w]] -= own
        left[of[w]] -= own
        tried = [B.likelihood(table(np.where(np.arange(many) == w, c, of))) for c in range(1, k + 1)]
        of[w] = B.moved(n, int(of[w]), right, left, own, np.arange(1, k + 1))
        assert of[w] == 1 + int(np.argmax(tried)) and np.allclose(n, table(of))


@pytest.mark.parametrize("vocabulary,classes,block_bytes", [(20, 3, 2000), (1 << 13, 6, 8 << 20), (4, 2, 300)])
def test_model(spark, edge, edge_rows, monkeypatch, vocabulary, classes, block_bytes):
    monkeypatch.setattr(B, "FAN", 3)
    rows = [*texts(), *edge_rows]
    df = spark.createDataFrame(texts(), SCHEMA).union(edge).withColumns({"held": F.lit(1), "n": F.lit(2), "cls": F.lit("c")})
    coded, model = B.fitted(df.repartition(4), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, vocabulary, classes, 6, block_bytes)
    lexicon = {}
    for row in coded.collect():
        b = B.Block(row.asDict())
        for h, n, c in zip(b.prints.tolist(), from_planes(row["count"], np.uint64).tolist(), from_planes(row["cls"], np.uint16).tolist()):
            assert lexicon.setdefault(h, (n, c)) == (n, c)
    learned = Counter(w for i, t, *_ in rows if not held(i) for w in words_of(t))
    train = sum(not held(r[0]) for r in rows)
    total, types = sum(learned.values()) + train, len(learned) + 1
    assert (model.train_tokens, model.types) == (total, types)

    # the class of a word, through the words' fingerprints
    from celltable.llm.words import byte_classes, split_words, text_bytes
    import pyarrow as pa
    every = sorted({w for r in rows for w in words_of(r[1])})
    prints = split_words(*text_bytes(pa.array(every)), byte_classes("space")).hash.tolist()
    of = {w: lexicon[h][1] for w, h in zip(every, prints)}
    assert all(lexicon[h][0] == learned[w] for w, h in zip(every, prints))
    assert all(1 <= of[w] <= classes for w in learned)
    n = np.zeros((classes + 1, classes + 1))
    for i, t, *_ in rows:
        if not held(i):
            line = [0, *(of[w] for w in words_of(t)), 0]
            np.add.at(n, (line[:-1], line[1:]), 1)
    assert np.array_equal(n.sum(0), model.tokens)
    kinds, once = (np.bincount([of[w] for w in learned if f(learned[w])], minlength=classes + 1).astype(float) for f in (lambda c: True, lambda c: c == 1))
    assert np.allclose(B.Model.of(n, kinds, once).t, model.t)
    emit = lambda w: (learned[w] - model.discount[of[w]]) / model.tokens[of[w]]
    mass = np.bincount([of[w] for w in learned], [emit(w) for w in learned], classes + 1) + model.unseen
    mass[0] = 1
    assert np.allclose((model.t * mass).sum(1), 1)

    def plain(words):
        """Sum over the classes of every token, one token after the other."""
        state, logs = np.eye(classes + 1)[0], 0.0
        for w in [*words, None]:
            if w is None:
                step = np.eye(classes + 1)[0]
            elif w in learned:
                step = np.eye(classes + 1)[of[w]] * emit(w)
            else:
                step = model.unseen
            state = (state @ model.t) * step
            logs += math.log10(state.sum())
            state /= state.sum()
        return logs

    got = sorted((tuple(r) for r in B.scores(coded, model).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        w = words_of(t)
        c = [*(learned[x] for x in w), train]
        want.append((i, held(i), len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + types + 1)) for x in c), plain(w)))
    want = sorted(((*x, 10 ** (-x[6] / x[2])) for x in want), key=repr)
    assert [g[:5] for g in got] == [x[:5] for x in want]
    assert np.allclose([g[5:] for g in got], [x[5:] for x in want], rtol=1e-8)


def test_classes_beat_single_words(spark):
    rows = [document(i, " ".join(f"{'ab'[k % 2]}{random.Random(100 * i + k).randrange(60)}" for k in range(60))) for i in range(150)]
    got = B.scored(spark.createDataFrame(rows, SCHEMA), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, 1 << 13, 4).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] + 0.2 * 60 * 10
    assert prose(1, 1)


def test_no_training_text_and_nothing(spark, edge, empty):
    assert B.scored(empty, F.lit(False)).count() == 0
    got = B.scored(edge, F.lit(True)).collect()
    assert len(got) == edge.count() and all(r.score == r.base_score == 0 and r.n_known == r.train_tokens == 0 for r in got)
    alone = B.scored(spark.createDataFrame([document(1, None)], SCHEMA), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in alone] == [(1, 1, 1, 0.0)]
