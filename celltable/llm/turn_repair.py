"""Repair of a conversation's turn structure by depth-first branch and bound.

A conversation is legal when its role initials read ``(s?(ua)+)?``.  Edits: Keep a row (0), Rerole it to user or assistant
(2), Delete it (3; blank rows and repeats must go), Insert an empty user or assistant row anywhere (2).  A truncated
row that stays costs 1 more.  The cheapest edits win, ties go to the ASCII-least audit, the string of edit initials.

The search keeps an explicit stack and visits edits in ASCII order.  A node is (rows consumed, last role put out).  A
prefix is dropped when its cost plus the suffix bound (the cheapest fate of every row left, whatever its neighbours)
passes the incumbent, when it ties with it under a greater audit, or when the node's dominance table holds a prefix
that is as cheap and no greater.  Two different prefixes of one node and cost are never prefixes of each other (a
further Insert costs), so the least prefix also gives the least whole audit.  The search ends with an empty stack: nothing
left can beat the incumbent.

Rows are range-partitioned by (conversation, turn, role, text), so a conversation of any share of the rows spreads
over tasks.  A conversation inside one partition and of at most PIECE rows is solved at once.  Longer ones, and those on
the edge of a partition, are cut into pieces; every piece is solved for each role that may stand before it and each
role it may end with, and the pieces of a conversation are put together in order, four candidates at a time.

Order: by turn (NULL first), ties by role, then text, in byte order.  NULL roles and texts stand as one space, as
do NULLs in ``key_of``.  A NULL conv_id is a conversation of its own.  Roles other than those beginning with s, u or a can
only be reroled or deleted.  Repeated rows are repeats.  A repaired conversation is one value of a row, so
it must fit Spark's limit of 2 GB.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from celltable.llm.store import saved

PIECE = 64
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL_ENDS = frozenset({START, ASSISTANT})
LEGAL_PAIRS = frozenset({"su", "ua", "au"})


def key_of(*columns: str) -> Column:
    """The columns as text, NULL as one space, joined by colons."""
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in columns])


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` (dropped, kept as a mark of its conversation) after the damage that the row's key deals."""
    kind = F.crc32(key_of("conv_id", "turn")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), (kind == 0).alias("gone"),
                       F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0))).alias("_copy")).drop("_copy")


# ---- one stretch of rows --------------------------------------------------------------

def step(state: int, edit: str, initial: str) -> int | None:
    """The last role after an edit, or None where the edit is not allowed."""
    if edit == "D":
        return state
    if edit in "IR":
        return NEXT[state]
    if initial == "s":
        return SYSTEM if state == START else None
    wanted = {"u": USER, "a": ASSISTANT}.get(initial)
    return wanted if wanted == NEXT[state] else None


def cheapest(rows: list[tuple[str, bool, bool]], entry: int = START, ends: frozenset = LEGAL_ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the best edits of rows (initial, must go, truncated) from the role before them to one of ``ends``.

    None where no edits lead there."""
    n = len(rows)
    bound = ([0] * (n + 1), [0] * (n + 1))  # nothing put out yet, or something: then a system row cannot stay
    for i in range(n - 1, -1, -1):
        initial, must, cut = rows[i]
        other = min(3, 2 + cut)
        bound[0][i] = bound[0][i + 1] + (3 if must else int(cut) if initial in ("s", "u", "a") else other)
        bound[1][i] = bound[1][i + 1] + (3 if must else int(cut) if initial in ("u", "a") else other)
    out = frozenset(range(4)) - {START}
    reach = {START: frozenset(range(4)), SYSTEM: out, USER: out - {SYSTEM}, ASSISTANT: out - {SYSTEM}}
    best = greedy(rows, entry, ends)
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        low = cost + bound[state != START][i]
        if not reach[state] & ends or best is not None and (low > best[0] or low == best[0] and audit > best[1][:len(audit)]):
            continue
        seen = table.get((i, state))
        if seen is not None and seen <= (cost, audit):
            continue
        table[i, state] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        more = []
        initial, must, cut = rows[i] if i < n else ("", True, False)
        if i < n:
            more.append((i + 1, state, cost + 3, audit + "D"))
        more.append((i, NEXT[state], cost + 2, audit + "I"))
        if not must:
            if (kept := step(state, "K", initial)) is not None:
                more.append((i + 1, kept, cost + cut, audit + "K"))
            more.append((i + 1, NEXT[state], cost + 2 + cut, audit + "R"))
        stack += reversed(more)
    return best


def greedy(rows: list[tuple[str, bool, bool]], entry: int, ends: frozenset) -> tuple[int, str] | None:
    """A first incumbent: keep what fits, rerole what does not, insert at the end."""
    state, cost, audit = entry, 0, ""
    for initial, must, cut in rows:
        edit = "D" if must else "K" if step(state, "K", initial) is not None else "R"
        state = step(state, edit, initial)
        cost += {"D": 3, "K": cut, "R": 2 + cut}[edit]
        audit += edit
    for _ in range(3):
        if state in ends:
            return cost, audit
        state, cost, audit = NEXT[state], cost + 2, audit + "I"
    return None


def apply(audit: str, rows: list[tuple[str, str]], state: int = START) -> tuple[list[str], int]:
    """The lines ``role:text`` that the edits leave of (role, text), and the last role's state."""
    lines, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        new = step(state, edit, role[:1])
        if edit in "IR":
            role = "user" if new == USER else "assistant"
        if edit != "D":
            lines.append(f"{role}:{text}")
        state = new
    return lines, state


# ---- conversations over partitions ----------------------------------------------------

_PIECE = [("piece", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
          ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("repaired", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_PIECE_SQL = ("piece bigint, whole boolean, n bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
              "costs array<bigint>, audits array<string>, repaired string, roles array<string>, texts array<string>")
_BLANK = " \t\n\v\f\r"


def _faults(rows: list[dict]) -> list[tuple[str, bool, bool]]:
    """(initial, must go, truncated) and, through the row's ``fault``, its first fault."""
    out = []
    for r in rows:
        core = r["text"].rstrip(_BLANK)
        r["fault"] = "blank" if not core else "duplicate" if r["again"] else "truncated" if core[-1] not in ".!?" else ""
        out.append((r["role"][:1], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated"))
    return out


def _piece(rows: list[dict], number: int, whole: bool) -> dict:
    facts = _faults(rows)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out = {"piece": number, "whole": whole, "n": len(rows), "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
           "illegal": sum(a[0] + b[0] not in LEGAL_PAIRS for a, b in zip(facts, facts[1:])), "first": facts[0][0] if facts else None, "last": facts[-1][0] if facts else None}
    out |= {k: sum(r["fault"] == k for r in rows) for k in ("blank", "duplicate", "truncated")}
    text = [(r["role"], r["text"]) for r in rows]
    if whole:
        cost, audit = cheapest(facts)
        return out | {"costs": [cost], "audits": [audit], "repaired": "\n".join(apply(audit, text)[0]), "roles": None, "texts": None}
    found = [cheapest(facts, entry, frozenset({end})) for entry in range(4) for end in range(4)]
    return out | {"costs": [f and f[0] for f in found], "audits": [f and f[1] for f in found], "repaired": None, "roles": [t[0] for t in text], "texts": [t[1] for t in text]}


def _pieces_of(kind: pa.DataType):
    """Pieces of the conversations of a sorted partition, read row by row."""
    schema = pa.schema([("conv_id", kind), *_PIECE])

    def run(batches):
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 32
        number, current, rows, before, pieces = 0, None, [], None, 0

        def close(last):
            """The open conversation as its last piece."""
            nonlocal number
            number += 1
            return {"conv_id": current[0], **_piece(rows, base + number, pieces == 0 and not first and not last)}

        first, out, last_row = True, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if current is None or r["conv_id"] != current[0]:
                    if current is not None:
                        out.append(close(False))
                        first = False
                    current, rows, pieces, last_row = (r["conv_id"],), [], 0, None
                if r["gone"]:
                    continue
                same = (r["turn"], r["role"], r["text"])
                r["again"] = r["again"] or same == last_row
                last_row = same
                if len(rows) == PIECE:
                    number += 1
                    out.append({"conv_id": current[0], **_piece(rows, base + number, False)})
                    rows, pieces = [], pieces + 1
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if current is not None:
            yield pa.RecordBatch.from_pylist([close(True)], schema)

    return run


def _joined(batches, schema: pa.Schema):
    """Pieces of conversations in order: the summary of each, with its audit."""
    current, total, states, out = None, None, None, []

    def done():
        cost, audit = min(s for s in (states[START], states[ASSISTANT]) if s is not None)
        return total | {"cost": cost, "audit": audit}

    for batch in batches:
        for p in batch.to_pylist():
            if current is None or p["conv_id"] != current[0]:
                if current is not None:
                    out.append(done())
                current, states = (p["conv_id"],), [(0, ""), None, None, None]
                total = {"conv_id": p["conv_id"], "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None}
            if not p["n"]:
                continue
            if total["last"] is not None:
                total["illegal"] += total["last"] + p["first"] not in LEGAL_PAIRS
            if p["low"] is not None:
                total["turns"] -= total["high"] == p["low"]
                total |= {"low": p["low"] if total["low"] is None else total["low"], "high": p["high"]}
            for k in ("turns", "blank", "duplicate", "truncated", "illegal"):
                total[k] += p[k]
            total["last"] = p["last"]
            new = [None] * 4
            for entry in range(4):
                for end in range(4):
                    c, a = p["costs"][4 * entry + end], p["audits"][4 * entry + end]
                    if states[entry] is not None and c is not None:
                        way = (states[entry][0] + c, states[entry][1] + a)
                        new[end] = way if new[end] is None else min(new[end], way)
            states = new
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if current is not None:
        yield pa.RecordBatch.from_pylist([done()], schema)


def _rewritten(batches, schema: pa.Schema):
    """Repaired text of every piece: the audit of a conversation comes first, then its pieces in order."""
    audit, at, state, out = "", 0, START, []
    for batch in batches:
        for p in batch.to_pylist():
            if p["audit"] is not None:
                audit, at, state = p["audit"], 0, START
                continue
            end, left = at, len(p["roles"])
            while end < len(audit) and (left or audit[end] == "I"):
                left -= audit[end] != "I"
                end += 1
            lines, state = apply(audit[at:end], list(zip(p["roles"], p["texts"], strict=True)), state)
            at = end
            out.append({"conv_id": p["conv_id"], "piece": p["piece"], "lines": "\n".join(lines) if lines else None})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the ``repaired`` text
    (lines ``role:text``).

    ``rows``: conv_id, turn, role, text and, if there, ``gone`` for rows that count as missing.  A conversation without rows
    gets zeros and empty texts.  No rows, no result."""
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    live = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.when(gone, F.lit("")).otherwise(text).alias("text"), gone.alias("gone"))
    live = live.withColumn("print", F.when(F.col("gone"), F.lit(None)).otherwise(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)))
    # only what is said more than once in a conversation needs its first turn; a missing turn comes before all
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = (live.filter("not gone").groupBy("conv_id", "print").agg(F.min(turn).alias("_at"), F.max(turn).alias("_last")).filter("_at <> _last")
              .select(F.col("conv_id").alias("_conv"), F.col("print").alias("_print"), "_at"))
    live = live.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("print") == F.col("_print")), "left")
    live = live.select("conv_id", "turn", "role", "text", "gone", F.coalesce(turn != F.col("_at"), F.lit(False)).alias("again"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    kind = live.schema["conv_id"].dataType
    arrow = pa.string() if isinstance(kind, StringType) else pa.int64()
    if not isinstance(kind, StringType):
        live = live.withColumn("conv_id", F.col("conv_id").cast("bigint"))
    id_sql = "conv_id " + ("string" if isinstance(kind, StringType) else "bigint")
    laid = live.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = saved(laid.mapInArrow(_pieces_of(arrow), f"{id_sql}, {_PIECE_SQL}"))

    counts = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal"]
    whole = pieces.filter("whole").select("conv_id", *counts, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), "repaired")
    cut = pieces.filter("not whole")
    total = pa.schema([("conv_id", arrow), *[(c, pa.int64()) for c in counts], ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
    sums = saved(cut.drop("repaired", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
                 .mapInArrow(lambda b: _joined(b, total), f"{id_sql}, {', '.join(f'{c} bigint' for c in counts)}, last string, cost bigint, audit string"))
    nothing = F.lit(None).cast("array<string>")
    heads = sums.select("conv_id", F.lit(-1).cast("bigint").alias("piece"), "audit", nothing.alias("roles"), nothing.alias("texts"))
    bodies = cut.select("conv_id", "piece", F.lit(None).cast("string").alias("audit"), "roles", "texts")
    lines = pa.schema([("conv_id", arrow), ("piece", pa.int64()), ("lines", pa.string())])
    texts = (heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
             .mapInArrow(lambda b: _rewritten(b, lines), f"{id_sql}, piece bigint, lines string")
             .groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "lines"))), lambda x: x["lines"]), "\n").alias("repaired")))
    texts = texts.withColumnRenamed("conv_id", "_conv")
    long = sums.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *counts, "cost", "audit", "repaired")
    found = whole.unionByName(long)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    return found.select(F.col("conv_id").cast(kind).alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired", F.lit("")).alias("repaired"))
