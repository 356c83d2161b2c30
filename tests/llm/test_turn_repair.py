"""Turn repair: the search against full enumeration, conversations against a plain recursion, pieces and edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from celltable.llm import turn_repair as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece int, cost string, gone_too int"
BLANK = r"[^\x20\x09-\x0D]"


def enumerate_all(rows, entry=T.START, ends=T.LEGAL_ENDS, inserts=3):
    found = []

    def go(i, state, cost, audit, left):
        if i == len(rows) and state in ends:
            found.append((cost, audit))
        if left:
            go(i, T.NEXT[state], cost + 2, audit + "I", left - 1)
        if i == len(rows):
            return
        initial, must, cut = rows[i]
        go(i + 1, state, cost + 3, audit + "D", inserts)
        if not must:
            if T.step(state, "K", initial) is not None:
                go(i + 1, T.step(state, "K", initial), cost + cut, audit + "K", inserts)
            go(i + 1, T.NEXT[state], cost + 2 + cut, audit + "R", inserts)

    go(0, entry, 0, "", inserts)
    return min(found, default=None)


def some_rows(r, n):
    return [(r.choice("uuaas x"), r.random() < 0.15, r.random() < 0.2) for _ in range(n)]


def test_search_finds_the_least_of_all_edits():
    r = random.Random(1)
    for _ in range(60):
        rows = some_rows(r, r.randrange(6))
        assert T.cheapest(rows) == enumerate_all(rows)
    for _ in range(10):
        rows = some_rows(r, 4)
        for entry in range(4):
            for end in range(4):
                assert T.cheapest(rows, entry, frozenset({end})) == enumerate_all(rows, entry, {end})


def plain_best(rows):
    """Least (cost, audit) by states, row after row."""
    at = {T.START: (0, "")}
    for row in [*rows, None]:
        for _ in range(2):
            for s, (c, a) in list(at.items()):
                to, way = T.NEXT[s], (c + 2, a + "I")
                at[to] = min(at.get(to, way), way)
        if row is None:
            return min(at[s] for s in T.LEGAL_ENDS if s in at)
        new = {}
        for s, (c, a) in at.items():
            for edit in "DKR":
                to = T.step(s, edit, row[0])
                if to is None or row[1] and edit != "D":
                    continue
                way = (c + {"D": 3, "K": row[2], "R": 2 + row[2]}[edit], a + edit)
                new[to] = min(new.get(to, way), way)
        at = new


def brute(rows):
    text = lambda v: " " if v is None else str(v)
    byte_order = lambda s: s.encode()
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = []
        for _, turn, role, said, *_ in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
            if kind:
                said = "" if kind == 1 else re.sub("[.!?]", "", text(said)) if kind == 2 else text(said)
                own += [(turn, "user" if kind == 4 else text(role), said)] * (2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, byte_order(r[1]), byte_order(r[2])))
        seen, facts, faults = set(), [], []
        for _, role, said in own:
            core = re.findall(BLANK, said)
            faults.append("blank" if not core else "duplicate" if (role, said) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, said))
            facts.append((role[:1], faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
        cost, audit = plain_best(facts)
        lines, at, state = [], 0, T.START
        for e in audit:
            role, said = ("", "") if e == "I" else own[at][1:]
            at += e != "I"
            state = T.step(state, e, role[:1])
            if e != "D":
                lines.append(f"{role if e == 'K' else 'user' if state == T.USER else 'assistant'}:{said}")
        turns = {r[0] for r in own} - {None}
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
                    sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    r = random.Random(7)
    rows = []
    for c in range(40):
        for t in range(r.randrange(1, 12)):
            rows.append((c, t + r.randrange(2), r.choice(["user", "assistant", "system", "tool", "", None]) if r.random() < 0.4 else ("user", "assistant")[t % 2], r.choice(["Yes.", "no", "ok!", "  ", None, f"word {t}?", "é" * 50 + "."])))
    rows += [(100, t, ("user", "assistant")[t % 2] if r.random() < 0.9 else "system", f"said {r.randrange(300)}{r.choice(['.', ''])}") for t in range(400)]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (101, None, None, None), (101, None, "user", "Why?"), (102, 5, "user", "x" * 200_000 + "."), (102, 6, "assistant", "y.")]
    rows += [(103, 1, "user", "Same.")] * 5
    return [(*x, 1, "c", 0) for x in rows]


@pytest.mark.parametrize("piece,partitions", [(64, 4), (5, 7), (1, 3)])
def test_conversations(spark, monkeypatch, piece, partitions):
    monkeypatch.setattr(T, "PIECE", piece)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = T.repair(T.damaged(df)).withColumn("sha", F.sha2("repaired", 256)).drop("repaired")
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows)


def test_nothing_and_text_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.repair(T.damaged(none)).count() == 0
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "user", "There.")], "conv_id string, turn int, role string, text string")
    assert [(x.conv_id, x.cost, x.audit, x.repaired) for x in T.repair(df).collect()] == [("a", 2, "KR", "user:Hi.\nassistant:There.")]
    gone = T.repair(df.withColumn("gone", F.lit(True))).collect()
    assert [(x.cost, x.audit, x.repaired, x.gaps) for x in gone] == [(0, "", "", 0)]
