"""Brown class model: exchange clustering of words, class transitions and word emissions, perplexity of texts.

P(text) is a product over tokens, the words and one end, of T(class | class before) E(word | class); the end is a class of its
own and stands before the first word.

1. Texts become blocks of word numbers, written once to the shared folder; shards of the fingerprint space add up counts.
2. The VOCABULARY most frequent words are clustered by exchange: words move to the class that raises the likelihood of
   the class bigrams most.  Their bigram counts, over all training texts, lie in one row per word; each round visits the rows in
   parallel, every task moving its words one after the other from the round's common state.  Rounds end when the likelihood
   no longer grows, and the best assignment stands.
3. Every other training word goes to the class under which its neighbours' classes are likeliest, by the counts of all training texts.
4. Transitions are discounted towards class frequencies.  Emissions are discounted by a class's share of words seen once; what
   is freed is the class's chance of an unseen word.  An unseen word leaves its class open: the sum over classes is carried
   on to the next token.  So the probabilities of all continuations, unseen word included, add up to 1.

Only the clustered vocabulary and tables of classes reach the driver; their sizes are parameters.  Fingerprints have 64 bits.

Rules: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; NULL texts have none, so only their end is scored.  Rows with a NULL
id are not held out; repeated rows count each.  Without training texts the score is the base score.  An empty
table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from celltable.llm import exchange as X
from celltable.llm.store import ready
from celltable.llm.words import byte_classes, from_planes, lower_table, pack, pieces, planes, split_words, text_bytes, unpack

VOCABULARY, CLASSES, ROUNDS, DISCOUNT = 1 << 13, 64, 12, 0.5
BLOCK_BYTES, SHARD_BYTES, BLOCKS_A_TASK = 2 << 20, 4 << 20, 8
TOP_TASKS, STRETCH, END, LN10 = 16, 1 << 17, 0, math.log(10)

_BLOCK = [("block", pa.int64()), ("bytes", pa.int64()), ("doc_id", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("held", "sizes", "ids", "prints")]]
_BLOCK_SQL = "block bigint, bytes bigint, doc_id array<bigint>, held binary, sizes binary, ids binary, prints binary"


def text_blocks(docs: DataFrame, held_out: Column, block_bytes: int) -> DataFrame:
    """Texts as numbers of their block's lexicon, one row per block."""
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = text_bytes(batch["text"])
            ids, held = batch["doc_id"].to_pylist(), batch["held"].to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in pieces(off, block_bytes):
                w = split_words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], byte_classes("space"), lower_table())
                prints, at = np.unique(w.hash, return_inverse=True)
                yield pa.RecordBatch.from_pylist([{"block": number, "bytes": int(off[hi] - off[lo]), "doc_id": ids[lo:hi], "held": X.bits(held[lo:hi]), "sizes": planes(np.diff(w.first).astype(np.uint32)),
                                                   "ids": planes(at.astype(np.uint32)), "prints": pack(prints)}], pa.schema(_BLOCK))
                number += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    return rows.mapInArrow(run, _BLOCK_SQL)


def one_by_one(batch: pa.RecordBatch):
    """Rows as dictionaries; only one block is in Python's memory at a time."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


class Block:
    """Tokens of a block's texts, one end behind each text; ``lexicon`` numbers of words, -1 for ends."""

    def __init__(self, row: dict):
        self.number, self.docs = row["block"], row["doc_id"]
        self.prints = unpack(row["prints"], np.uint64) if row.get("prints") is not None else None
        self.size = from_planes(row["sizes"], np.uint32).astype(np.int64)
        self.held = X.from_bits(row["held"], len(self.size))
        ids = from_planes(row["ids"], np.uint32)
        self.first = np.concatenate([[0], np.cumsum(self.size + 1)])
        self.word = np.full(self.first[-1], -1, np.int32)
        inside = np.ones(self.first[-1], bool)
        inside[self.first[1:] - 1] = False
        self.word[inside] = ids
        self.train = np.repeat(~self.held, self.size + 1)

    def counts(self) -> np.ndarray:
        """Occurrences of each word in training texts."""
        return np.bincount(self.word[self.train & (self.word >= 0)], minlength=len(self.prints))

    def classes(self, of: np.ndarray) -> np.ndarray:
        """Class of every token; the end is END."""
        return np.append(of, END).astype(np.int32)[self.word]


def before(cls: np.ndarray) -> np.ndarray:
    """The token before each; an end stands before the first."""
    return np.concatenate([np.full(1, END, cls.dtype), cls[:-1]]) if len(cls) else cls


def lookup(known: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: int) -> np.ndarray:
    """Values of the keys in a sorted list."""
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return np.where(known[at] == keys, values[at], missing) if len(known) else np.full(len(keys), missing)


# ---- exchange clustering --------------------------------------------------------------

def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(n: np.ndarray) -> float:
    """Log likelihood of class bigrams n, up to what no exchange changes."""
    return float(xlogx(n).sum() - xlogx(n.sum(1)).sum() - xlogx(n.sum(0)).sum())


def moved(n: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, self_count: float, free: np.ndarray) -> int:
    """The class among ``free`` that gains most from a word with these class contexts; ``n`` becomes the table after the move.

    ``right`` and ``left`` count the classes behind and before the word, without the word itself."""
    n[own] -= right
    n[:, own] -= left
    n[own, own] -= self_count
    total = right.sum() + self_count, left.sum() + self_count
    rows, cols = n[free], n[:, free].T
    at = np.arange(len(free)), free
    gain_rows, gain_cols = xlogx(rows + right) - xlogx(rows), xlogx(cols + left) - xlogx(cols)
    gain_rows[at] = gain_cols[at] = 0
    both = n[free, free]
    gain = gain_rows.sum(1) + gain_cols.sum(1) + xlogx(both + right[free] + left[free] + self_count) - xlogx(both)
    # a neighbour's own total keeps its bigrams with the word, whatever class the word goes to
    for size, more in (((n.sum(1) + left)[free], total[0]), ((n.sum(0) + right)[free], total[1])):
        gain -= xlogx(size + more) - xlogx(size)
    # a class wins only by a real margin, else the word stays
    new = int(free[np.argmax(gain)])
    if own in free and gain[np.flatnonzero(free == own)[0]] >= gain.max() - 1e-9 * max(1.0, abs(gain.max())):
        new = own
    n[new] += right
    n[:, new] += left
    n[new, new] += self_count
    return new


_WORDS_SQL = "word bigint, c0 binary, n0 binary, c1 binary, n1 binary"
FAN = 16


def added(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of packed lists, sorted, and their sums."""
    key = np.concatenate([unpack(k, np.uint64) for k in keys])
    n = np.concatenate([from_planes(x, np.uint64) for x in counts])
    order = np.argsort(key, kind="stable")
    first = X.runs_of_equal(key[order])
    return key[order][first], np.add.reduceat(n[order], first)


def contexts(blocks: DataFrame, number: int, top: np.ndarray) -> DataFrame:
    """One row per clustered word: its neighbours (0 the end, 1.. clustered words, then one number for all others) and counts.

    The counts of the blocks are added up FAN at a time, so no task holds more than FAN tables of vocabulary pairs."""
    wide, shards = len(top) + 2, max(1, min(64, len(top)))
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])

    def pairs(batches):
        for batch in batches:
            for row in one_by_one(batch):
                b = Block(row)
                line = b.classes(lookup(top, np.arange(1, len(top) + 1), b.prints, wide - 1))
                prior, rows = before(line), []
                for side, (w, c) in enumerate(((line, prior), (prior, line))):
                    use = b.train & (w > 0) & (w < wide - 1)
                    own = w[use].astype(np.int64)
                    key, n = np.unique(((own % shards * wide + own) * 2 + side) * wide + c[use], return_counts=True)
                    cut = np.searchsorted(key, np.arange(shards + 1) * 2 * wide * wide)
                    rows += [{"shard": s, "part": (b.number ^ b.number >> 32) & 0x7FFFFFFF, "keys": pack(key[cut[s]:cut[s + 1]].astype(np.uint64)), "n": planes(n[cut[s]:cut[s + 1]].astype(np.uint64))} for s in np.flatnonzero(np.diff(cut)).tolist()]
                yield pa.RecordBatch.from_pylist(rows, schema)

    def merge(table):
        key, n = added(table["keys"].to_pylist(), table["n"].to_pylist())
        return pa.Table.from_pylist([{"shard": table["shard"][0].as_py(), "part": table["part"][0].as_py(), "keys": pack(key), "n": planes(n)}], schema)

    def rows(table):
        key, n = added(table["keys"].to_pylist(), table["n"].to_pylist())
        key, n = key.astype(np.int64), n.astype(np.int64)
        group, c = key // wide, key % wide
        cut = np.append(X.runs_of_equal(group), len(group))
        out: dict[int, dict] = {}
        for a, z in zip(cut[:-1], cut[1:]):
            w, side = int(group[a]) // 2 % wide, int(group[a]) % 2
            out.setdefault(w, {"word": w, "c0": b"", "n0": b"", "c1": b"", "n1": b""}).update({f"c{side}": c[a:z].astype(np.int32).tobytes(), f"n{side}": n[a:z].tobytes()})
        return pa.Table.from_pylist(list(out.values()), pa.schema([("word", pa.int64()), *[(f"{k}{s}", pa.binary()) for s in (0, 1) for k in "cn"]]))

    found, parts, sql = blocks.mapInArrow(pairs, "shard bigint, part bigint, keys binary, n binary"), number, "shard bigint, part bigint, keys binary, n binary"
    while parts > FAN:
        parts = -(-parts // FAN)
        found = found.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("shard", "part").applyInArrow(merge, sql)
    return found.groupBy("shard").applyInArrow(rows, _WORDS_SQL)


def neighbours(row: dict, side: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"c{side}"], np.int32), np.frombuffer(row[f"n{side}"], np.int64)


def sides(row: dict, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Class counts behind and before a word, without itself, and how often it follows itself."""
    (c0, n0), (c1, n1) = neighbours(row, 0), neighbours(row, 1)
    left, right = np.bincount(of[c0], n0, k), np.bincount(of[c1], n1, k)
    twice = float(n0[c0 == row["word"]].sum())
    right[of[row["word"]]] -= twice
    left[of[row["word"]]] -= twice
    return right, left, twice


def class_table(words: DataFrame, others: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Class bigrams; class 0 is the end, the last one holds the words outside the vocabulary.

    ``others``: bigrams among those two, which no word's row holds."""
    def run(batches):
        n = np.zeros((k, k))
        for batch in batches:
            for row in batch.to_pylist():
                own = of[row["word"]]
                (c0, n0), (c1, n1) = neighbours(row, 0), neighbours(row, 1)
                n[own] += np.bincount(of[c1], n1, k)
                fixed = (c0 == 0) | (c0 == len(of) - 1)
                n[:, own] += np.bincount(of[c0[fixed]], n0[fixed], k)
        i, j = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n[i, j])], ["i", "j", "n"])

    n = np.zeros((k, k))
    for i, j, x in words.mapInArrow(run, "i bigint, j bigint, n double").groupBy("i", "j").agg(F.sum("n")).collect():
        n[i, j] = x
    n[np.ix_([END, k - 1], [END, k - 1])] += others
    return n


def cluster(words: DataFrame, others: np.ndarray, top: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class (1..classes) of each number, and the class bigrams; the end and the words outside keep classes of their own."""
    k, free = classes + 2, np.arange(1, classes + 1)
    of = np.concatenate([[END], 1 + np.arange(top) % classes, [classes + 1]])
    n = class_table(words, others, of, k)
    best, value, stale = (of, n), likelihood(n), 0
    for _ in range(rounds):
        def visit(batches, now=of, state=n):
            mine, own = now.copy(), state.copy()
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    right, left, twice = sides(row, mine, k)
                    mine[row["word"]] = moved(own, int(mine[row["word"]]), right, left, twice, free)
                    out.append((row["word"], int(mine[row["word"]])))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["word", "cls"])

        found = words.mapInArrow(visit, "word bigint, cls bigint").collect()
        of = of.copy()
        changed = sum(of[w] != c for w, c in found)
        for w, c in found:
            of[w] = c
        n = class_table(words, others, of, k)
        new = likelihood(n)
        stale = 0 if new > value + 1e-5 * abs(value) else stale + 1
        if new > value:
            best, value = (of, n), new
        if not changed or stale == 2:
            break
    return best


# ---- model ----------------------------------------------------------------------------

@dataclass
class Model:
    """Transitions t, natural logarithms of them, and per class: training tokens, discount and chance of an unseen word."""

    t: np.ndarray
    tokens: np.ndarray
    discount: np.ndarray
    unseen: np.ndarray
    train_tokens: int
    types: int

    @staticmethod
    def of(n: np.ndarray, types: np.ndarray, once: np.ndarray) -> Model:
        """n: class bigrams; types and once: words, and words seen once, of every class (the end has none)."""
        tokens = n.sum(0)
        share = np.where(tokens > 0, tokens + 1.0, 0.0)
        share = share / max(share.sum(), 1.0)
        size = n.sum(1, keepdims=True)
        freed = DISCOUNT * (n > 0).sum(1, keepdims=True)
        t = np.where(size > 0, (np.maximum(n - DISCOUNT, 0) + freed * share) / np.maximum(size, 1), share)
        discount = np.where(types > 0, (once + 1.0) / (types + 2.0), 0.0)
        return Model(t, tokens, discount, np.where(tokens > 0, discount * types / np.maximum(tokens, 1), 0.0), int(tokens.sum()), int(types.sum() + (tokens[END] > 0)))

    def emission(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """E(word | class) of words seen ``count`` times."""
        return (count - self.discount[cls]) / np.maximum(self.tokens[cls], 1)

    def token_logs(self, cls: np.ndarray, emitted: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """log P of each token given all before it in its text; ``emitted`` is its log emission, unseen words are not ``seen``."""
        prior = before(cls)
        known = np.concatenate([[True], seen[:-1]]) if len(seen) else seen
        out = np.zeros(len(cls))
        easy = seen & known
        with np.errstate(divide="ignore"):
            out[easy] = np.log(self.t[prior[easy], cls[easy]]) + emitted[easy]
            hidden = self.t * self.unseen
            starts = np.flatnonzero(~seen & known)
            for lo in range(0, len(starts), 20_000):
                at = starts[lo:lo + 20_000]
                state = hidden[prior[at]]
                while len(at):
                    p = state.sum(1)
                    out[at] = np.log(p)
                    state = state / np.maximum(p, 1e-300)[:, None]
                    at = at + 1
                    end = seen[at]
                    reach = (state[end] @ self.t)[np.arange(int(end.sum())), cls[at[end]]]
                    out[at[end]] = np.log(reach) + emitted[at[end]]
                    at, state = at[~end], state[~end] @ hidden
        return out


def _top(blocks: DataFrame, shards: int, tasks: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, sorted, and counts of the most frequent training words."""
    def ask(batches):
        for batch in batches:
            for row in one_by_one(batch):
                b = Block(row)
                n = b.counts()
                shard = (b.prints % np.uint64(shards)).astype(np.int64)
                live = np.flatnonzero(n)
                order = live[np.lexsort((b.prints[live], shard[live]))]
                yield from X.as_table(X.ask(b.number, shards, shard[order], [(b.prints[order], pack)], lambda a, z: planes(n[order][a:z].astype(np.uint64)))).to_batches()

    def add(table):
        key, n = added(table["keys"].to_pylist(), table["info"].to_pylist())
        key, n = key.view(np.int64), n.astype(np.int64)
        best = np.lexsort((key, -n))[:most]
        return pa.table({"print": key[best], "n": n[best]})

    counted = blocks.mapInArrow(ask, X.ASKED).repartition(tasks, "shard").groupBy("shard").applyInArrow(add, "print bigint, n bigint")
    # every task of the last step hands its best to the driver, so their number must not grow
    rows = counted.repartition(TOP_TASKS, "print").orderBy(F.desc("n"), "print").limit(most).collect()
    prints, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(prints)
    return prints[order], n[order]


def scored(docs: DataFrame, held_out: Column, vocabulary: int = VOCABULARY, classes: int = CLASSES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row; texts that are not
    ``held_out`` teach the model."""
    coded, model = fitted(docs, held_out, vocabulary, classes, rounds, block_bytes, keep_prints=False)
    return scores(coded, model)


def fitted(docs: DataFrame, held_out: Column, vocabulary: int = VOCABULARY, classes: int = CLASSES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES,
           keep_prints: bool = True) -> tuple[DataFrame, Model]:
    """The texts as blocks with the count and class of each word of their lexicons (and its fingerprint), and the model."""
    spark = docs.sparkSession
    ready(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/classes-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    blocks = stored(text_blocks(docs, held_out, block_bytes), "blocks")
    number, size = blocks.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    shards = max(1, math.ceil((size or 0) / block_bytes * BLOCK_BYTES / SHARD_BYTES))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(number / BLOCKS_A_TASK))
    k = classes + 1

    top, top_n = _top(blocks, shards, tasks, vocabulary)
    words = stored(contexts(blocks, number, top), "contexts")
    others = np.zeros((2, 2))
    for i, j, n in blocks.mapInArrow(lambda b: _outside(b, top), "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n")).collect():
        others[i, j] = n
    of, near = cluster(words, others, len(top), classes, rounds)

    answers = stored(_placed(blocks, top, of, near, shards, tasks, k), "placed")
    coded = stored(_coded(blocks, answers.filter("block >= 0"), top, top_n, of, shards, tasks, k, keep_prints), "coded")
    n, types, once = np.zeros((k, k)), np.bincount(of[1:-1], minlength=k).astype(float), np.bincount(of[1:-1][top_n == 1], minlength=k).astype(float)
    for (info,) in answers.filter("block < 0").select("info").toLocalIterator():
        both = np.frombuffer(info, np.int64).reshape(2, -1)
        types, once = types + both[0], once + both[1]
    pairs = coded.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy("x.pair").agg(F.sum("x.n"))
    for pair, x in pairs.collect():
        n[pair // k, pair % k] = x
    return coded.drop("pair", "n"), Model.of(n, types, once)


def _outside(batches, top: np.ndarray):
    """Bigrams of the end (0) and the words outside the vocabulary (1)."""
    for batch in batches:
        for row in one_by_one(batch):
            b = Block(row)
            kind = b.classes(lookup(top, np.full(len(top), 2), b.prints, 1))
            prior = before(kind)
            use = b.train & (kind < 2) & (prior < 2)
            n = np.bincount(prior[use] * 2 + kind[use], minlength=4)
            yield pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1], pa.int32()), pa.array([0, 1, 0, 1], pa.int32()), pa.array(n)], ["i", "j", "n"])


def _placed(blocks: DataFrame, top: np.ndarray, of: np.ndarray, near: np.ndarray, shards: int, tasks: int, k: int) -> DataFrame:
    """Answers to every block about its words outside the vocabulary: twice 2**8 the count, plus the class.

    Rows with a negative block hold the shard's number of words, and of words seen once, by class."""
    wide = k + 1
    smooth = near + 0.5
    follows = np.log(smooth / smooth.sum(1, keepdims=True))
    logs = np.concatenate([follows.T, follows])[:, :k]
    size = np.log(np.maximum(near.sum(0), 1))

    def ask(batches):
        for batch in batches:
            for row in one_by_one(batch):
                b = Block(row)
                cls = lookup(top, of[1:-1], b.prints, wide - 1)
                rare = np.flatnonzero(cls == wide - 1)
                line = b.classes(cls)
                prior, after = before(line), np.append(line[1:], END)
                use = b.train & (b.word >= 0)
                use[use] = cls[b.word[use]] == wide - 1
                w = b.word[use]
                rare = asked_order(b.prints, rare, shards)
                place = np.empty(len(b.prints), np.int64)
                place[rare] = np.arange(len(rare))
                key, n = np.unique(np.concatenate([place[w] * 2 * wide + after[use], place[w] * 2 * wide + wide + prior[use]]), return_counts=True)
                entries = np.bincount(key // (2 * wide), minlength=len(rare))
                start = np.concatenate([[0], np.cumsum(entries)])
                prints = b.prints[rare]
                shard = (prints % np.uint64(shards)).astype(np.int64)

                def info(a, z):
                    lo, hi = start[a], start[z]
                    return planes(entries[a:z].astype(np.uint32)) + planes((key[lo:hi] % (2 * wide)).astype(np.uint16)) + planes(n[lo:hi].astype(np.uint32))

                yield from X.as_table(X.ask(b.number, shards, shard, [(prints, pack)], info)).to_batches()

    def choose(table):
        table = table.sort_by("block")
        keys, ctx, n, owner, base = [], [], [], [], 0
        for count, key, info in zip(table["n"].to_pylist(), table["keys"].to_pylist(), table["info"].to_pylist()):
            entries = from_planes(info[:4 * count], np.uint32).astype(np.int64)
            m, at = int(entries.sum()), 4 * count
            keys.append(unpack(key, np.uint64))
            ctx.append(from_planes(info[at:at + 2 * m], np.uint16))
            n.append(from_planes(info[at + 2 * m:], np.uint32))
            owner.append(np.repeat(np.arange(base, base + count), entries))
            base += count
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        ctx, n, word = np.concatenate(ctx).astype(np.int64), np.concatenate(n).astype(np.int64), place[np.concatenate(owner)]
        order = np.argsort(word * 2 * wide + ctx, kind="stable")
        both = (word * 2 * wide + ctx)[order]
        first = X.runs_of_equal(both) if len(both) else np.zeros(0, np.int64)
        both, n = both[first], np.add.reduceat(n[order], first) if len(first) else n
        word, ctx = both // (2 * wide), both % (2 * wide)
        count = np.bincount(word[ctx < wide], n[ctx < wide], len(known)).astype(np.int64)
        # log likelihood of a word's neighbours under every class, by slices of words
        best = np.zeros(len(known), np.int64)
        for lo in range(0, len(known), 4096):
            a, z = np.searchsorted(word, [lo, lo + 4096])
            value = np.zeros((min(4096, len(known) - lo), k))
            if z > a:
                cut = X.runs_of_equal(word[a:z])
                value[word[a:z][cut] - lo] = np.add.reduceat(n[a:z, None] * logs[ctx[a:z]], cut, axis=0)
            value -= count[lo:lo + 4096, None] * size[None, :k]
            best[lo:lo + 4096] = 1 + np.argmax(value[:, 1:], axis=1)
        said = np.where(count > 0, count * 256 + best, 0).astype(np.uint64)[place]
        parts = [planes(x) for x in np.split(said, np.cumsum(table["n"].to_numpy())[:-1])]
        live = count > 0
        stats = np.concatenate([np.bincount(best[live], minlength=k), np.bincount(best[live & (count == 1)], minlength=k)]).astype(np.int64)
        own = pa.table({"block": pa.array([-1], pa.int64()), "shard": table["shard"].combine_chunks().slice(0, 1), "info": pa.array([stats.tobytes()], pa.binary())})
        return pa.concat_tables([pa.table({"block": table["block"], "shard": table["shard"], "info": pa.array(parts, pa.binary())}), own])

    return blocks.mapInArrow(ask, X.ASKED).repartition(tasks, "shard").groupBy("shard").applyInArrow(choose, X.ANSWERED)


def asked_order(prints: np.ndarray, rare: np.ndarray, shards: int) -> np.ndarray:
    """The words in the order in which their block asks the shards about them."""
    return rare[np.lexsort((prints[rare], (prints[rare] % np.uint64(shards)).astype(np.int64)))]


def _coded(blocks: DataFrame, answers: DataFrame, top: np.ndarray, top_n: np.ndarray, of: np.ndarray, shards: int, tasks: int, k: int, keep_prints: bool) -> DataFrame:
    """The blocks with the count and the class of each word, and the class bigrams of their training texts."""
    kind = pa.list_(pa.int64())
    schema = pa.schema([*_BLOCK, ("count", pa.binary()), ("cls", pa.binary()), ("pair", kind), ("n", kind)])

    def run(table, got):
        row = table.to_pylist()[0]
        b = Block(row)
        cls, count = lookup(top, of[1:-1], b.prints, 0), lookup(top, top_n, b.prints, 0)
        rare = asked_order(b.prints, np.flatnonzero(cls == 0), shards)
        if len(rare):
            said = np.concatenate([from_planes(f, np.uint64) for f in X.answers(got)[1]]).astype(np.int64)
            cls[rare], count[rare] = said % 256, said // 256
        line = b.classes(cls)
        pair, n = np.unique(before(line)[b.train] * k + line[b.train], return_counts=True)
        if not keep_prints:
            row["prints"] = None
        return pa.Table.from_pylist([row | {"count": planes(count.astype(np.uint64)), "cls": planes(cls.astype(np.uint16)), "pair": pair.tolist(), "n": n.tolist()}], schema)

    both = blocks.repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block"))
    return both.applyInArrow(run, _BLOCK_SQL + ", count binary, cls binary, pair array<bigint>, n array<bigint>")


def scores(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every text.

    A block is scored in stretches of texts of about STRETCH tokens, one longer text alone."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def part(b: Block, count: np.ndarray, cls: np.ndarray, lo: int, hi: int) -> pa.RecordBatch:
        word = b.word[b.first[lo]:b.first[hi]]
        c = np.append(count, int(model.tokens[END]))[word]
        base = np.log10((c + 1) / (model.train_tokens + model.types + 1))
        logs = base
        if model.train_tokens:
            line = np.append(cls, END)[word]
            with np.errstate(divide="ignore", invalid="ignore"):
                emitted = np.where(word < 0, 0.0, np.log(model.emission(line, c)))
            logs = model.token_logs(line, emitted, c > 0) / LN10
        add = lambda x: np.add.reduceat(x, b.first[lo:hi] - b.first[lo])
        n, score = b.size[lo:hi] + 1, add(logs)
        return pa.RecordBatch.from_arrays([pa.array(b.docs[lo:hi], pa.int64()), pa.array(b.held[lo:hi]), pa.array(n), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(hi - lo, model.train_tokens)),
                                           pa.array(add(base)), pa.array(score), pa.array(10 ** (-score / n))], names)

    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                b = Block(row)
                count, cls = from_planes(row["count"], np.uint64).astype(np.int64), from_planes(row["cls"], np.uint16).astype(np.int64)
                for lo, hi in pieces(b.first, STRETCH):
                    yield part(b, count, cls, lo, hi)

    return coded.select("block", "doc_id", "held", "sizes", "ids", "count", "cls").mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
