"""Language-model scoring by prediction by partial matching over bytes.

The model is a byte-context trie: for every context of 0 to ``order`` symbols, how often
each symbol followed it in the training texts.  A symbol is coded in the longest context
seen in training; where it never followed there, an escape is coded (method D: each of d
distinct followers gives half an occurrence to the escape, d / 2n in all, which leaves
(2c - 1) / 2n to a follower seen c times) and the next shorter context is tried, leaving out
the symbols that the longer context has already ruled out (symbol exclusion); at last all
symbols not ruled out are equally likely.  A text is its words (A-Z in lower case) joined
by one space, then an end symbol; its code length is the sum over all symbols.

``score`` uses a trie pretrained on the whole training part of the corpus; nothing of it is
pruned or passes through the driver, but for the two shortest contexts (66,306 sums at most).
The texts of a scan's partition make blocks of about BLOCK_BYTES; each block counts its
distinct grams of ``order + 1`` symbols once.  Grams are dealt into parts by their last two
context symbols, so that a part has whole contexts; a block's grams of one part travel as
one packed row (words go likewise, by their hash).  A part sums the blocks' counts, rolls them up from the longest context to the
shorter ones, and costs each distinct gram once; the costs go back to the blocks, packed,
and each block adds up its texts'.  Blocks of a part are summed in groups of MOST_BLOCKS, so
that no task holds more than those.
``adaptive`` codes each document by itself with a trie that starts empty.

Cases: null counts as empty text, which is one end symbol.  Rows repeated in the table
count each.  Null doc_ids count as the empty id for the fold.  With no training text all
symbols are equally likely.  Other columns are not looked at.  Empty tables give no rows.
"""

from __future__ import annotations

import io
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, materialize, mix

#: Symbols of context.
ORDER = 5
BLOCK_BYTES = 8 << 20
#: Bytes of text for each part of the grams; parts, at most (two context symbols tell them apart); blocks of a part in one task.
PART_BYTES, MOST_PARTS, MOST_BLOCKS = 16 << 20, 4096, 16384
BITS = 9
END, BEGIN, SYMBOLS = 256, 257, 257


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").lower().split())


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of all symbols of some normal texts, and where each text's grams begin."""
    raw = np.frombuffer(b"".join(bytes(order) + t + b"\0" for t in texts), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1 + order
    starts = np.cumsum(lengths) - lengths
    for k in range(order):
        raw[starts + k] = BEGIN
    raw[starts + lengths - 1] = END
    n = len(raw) - order
    grams = np.zeros(n, U64)
    for k in range(order + 1):
        grams <<= U64(BITS)
        grams |= raw[k : k + n]
    last = np.ones(n, bool)  # grams that end in a text's own symbol
    for k in range(order):
        other = starts[1:] + k - order
        last[other] = False
    return grams[last], np.cumsum(lengths - order) - (lengths - order)


def groups(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def packed(values: np.ndarray) -> bytes:
    """Compressed numbers of eight bytes: all first bytes, then all second ones, ..."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def pack_grams(grams: np.ndarray) -> bytes:
    """Ascending grams as differences."""
    return packed(np.diff(grams, prepend=U64(0)))


def unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U64), dtype=U64)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(b" ".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(counts, heads)


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def sorted_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each stands there."""
    return np.unique(values, return_counts=True)


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Part of each gram, by its last two context symbols."""
    return (mix((grams >> U64(BITS)) & U64((1 << 2 * BITS) - 1)) % U64(parts)).astype(np.int64)


COUNTS = "kind string, block long, part int, data binary, more binary, n long"
_COUNTS_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("n", pa.int64())])


def count_block(block: int, texts: list[bytes], ids: list, held: np.ndarray, order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """COUNTS rows of a block: its texts, compressed; its words; its distinct grams with their count in training texts, by part."""
    found, words, seen = [], Counter(), set()
    for i, j in groups(texts):
        grams, at = grams_of(texts[i:j], order)
        train = np.repeat(~held[i:j], np.diff(np.append(at, len(grams))))
        # trained occurrences are counted, the others only noted
        found.append(sorted_counts(grams[train]))
        keys, _ = sorted_counts(grams[~train])
        found.append((keys, np.zeros(len(keys), np.int64)))
        if len(found) > 8:
            found = [merged_counts(found)]
    for t, h in zip(texts, held.tolist(), strict=True):
        if h:
            seen.update(t.split())
        else:
            words.update(t.split())
    words.update(dict.fromkeys(seen, 0))
    file = io.BytesIO()
    own = pa.table({"doc_id": pa.array(ids, pa.int64()), "held": pa.array(held), "text": pa.array(texts, pa.large_binary())})
    with pa.ipc.new_stream(file, own.schema) as out:
        out.write_table(own)
    rows = lambda kind, part, data, more, n: pa.RecordBatch.from_arrays([pa.array([kind] * len(n)), pa.array([block] * len(n), pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary()), pa.array(n, pa.int64())], schema=_COUNTS_ARROW)
    yield rows("text", [-1], [zstandard.compress(file.getvalue(), 1)], [None], [len(texts)])
    named: dict[int, list[bytes]] = defaultdict(list)
    for w in words:
        named[zlib.crc32(w) % parts].append(w)
    yield rows("word", list(named), [pack_words(x) for x in named.values()], [packed(np.array([words[w] for w in x], np.int64)) for x in named.values()], list(map(len, named.values())))
    keys, counts = merged_counts(found)
    part = part_of(keys, parts)
    turn = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[turn], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(ends)).tolist()
    chosen = [turn[ends[p] : ends[p + 1]] for p in full]
    yield rows("gram", full, [pack_grams(keys[c]) for c in chosen], [packed(counts[c]) for c in chosen], [len(c) for c in chosen])


def count_blocks(docs: DataFrame, held: Column, order: int, block_bytes: int, parts: int) -> DataFrame:
    """COUNTS rows of ``docs(doc_id, text)``, by blocks of the scan's partitions: no text is shuffled for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        texts, ids, out, size = [], [], [], 0
        for batch in batches:
            for i, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                texts.append(normal(t.as_py()))
                ids.append(i)
                out.append(h)
                size += len(texts[-1]) + 1
                if size >= block_bytes:
                    yield from count_block(block, texts, ids, np.array(out, bool), order, parts)
                    block, texts, ids, out, size = block + 1, [], [], [], 0
        if texts:
            yield from count_block(block, texts, ids, np.array(out, bool), order, parts)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), held.alias("held")).mapInArrow(run, COUNTS)


def symbols_mask(symbols: int) -> np.uint64:
    return U64((1 << BITS * symbols) - 1)


class Level:
    """Contexts of one length: trained keys (a context and its follower) with counts, and each context's sums."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: Level | None, symbols: int):
        self.keys, self.counts = keys, counts
        context = keys >> U64(BITS)
        heads = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[heads]
        sums = lambda x: np.add.reduceat(x, heads) if len(heads) else np.zeros(0, np.int64)
        self.total, self.followers = sums(counts), np.diff(np.append(heads, len(keys)))
        #: counts that the followers have in the context one symbol shorter
        self.excluded = sums(shorter.count(keys & symbols_mask(symbols))) if shorter else np.zeros(len(heads), np.int64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 where it wasn't trained."""
        return looked_up(self.keys, self.counts, keys)


def looked_up(known: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, values[at], 0)


def levels_of(grams: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray], order: int) -> list[Level]:
    """Levels 0 to ``order`` from a part's trained grams; ``short`` has the corpus' keys of level 1 (or 0, if that is the order)."""
    rolled = {order: (grams, counts)}
    for d in range(order - 1, 1, -1):
        rolled[d] = summed(rolled[d + 1][0] & symbols_mask(d + 1), rolled[d + 1][1])
    if order < 2:
        rolled[order] = short
    else:
        rolled[1] = short
    if order:
        rolled[0] = summed(rolled[1][0] & symbols_mask(1), rolled[1][1])
    levels: list[Level] = []
    for d in range(order + 1):
        levels.append(Level(*rolled[d], levels[-1] if levels else None, d))
    return levels


def costs_of(grams: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 of the probability of each gram's last symbol after the others; ``grams`` ascend, ``counts`` may be 0."""
    trained = counts > 0
    levels = levels_of(grams[trained], counts[trained], short, order)
    costs = np.zeros(len(grams))
    top, own = levels[order], counts[trained]
    if len(own):
        costs[trained] = np.log10((2 * own - 1) / (2 * looked_up(top.contexts, top.total, grams[trained] >> U64(BITS))))
    asked = np.flatnonzero(~trained)
    out, ruled = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    left, cost = np.arange(len(asked)), np.zeros(len(asked))
    for d in range(order, -1, -1):
        level = levels[d]
        if not len(level.keys) or not len(left):
            continue
        key = grams[asked[left]] & symbols_mask(d + 1)
        context = key >> U64(BITS)
        at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
        known = level.contexts[at] == context
        mine, at, m = left[known], at[known], level.count(key[known])
        whole = 2.0 * (level.total[at] - out[mine])
        fresh = level.followers[at] - ruled[mine]  # followers that no longer context has ruled out
        found = m > 0
        cost[mine[found]] += np.log10((2 * m[found] - 1) / whole[found])
        escaped = ~found & (fresh > 0)
        cost[mine[escaped]] += np.log10(fresh[escaped] / whole[escaped])
        out[mine], ruled[mine] = level.excluded[at], level.followers[at]
        done = np.zeros(len(asked), bool)
        done[mine[found]] = True
        left = left[~done[left]]
    cost[left] -= np.log10(SYMBOLS - ruled[left])
    costs[asked] = cost
    return costs


def sum_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of packed grams (keys, data, more): one row for each ``keys``, counts summed."""

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for data, more in zip(table.column("data"), table.column("more"), strict=True):
            found.append((unpack_grams(data.as_py()), unpacked(more.as_py(), np.int64)))
            size += len(found[-1][0])
            if size > 1 << 22:
                found = [merged_counts(found)]
                size = 0
        grams, counts = merged_counts(found)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "data": pa.array([pack_grams(grams)]), "more": pa.array([packed(counts)])})

    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", data binary, more binary")


def sum_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As sum_parts, for packed words."""

    def run(table: pa.Table) -> pa.Table:
        found: Counter = Counter()
        for data, more in zip(table.column("data"), table.column("more"), strict=True):
            for w, n in zip(unpack_words(data.as_py()), unpacked(more.as_py(), np.int64).tolist(), strict=True):
                found[w] += n
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "data": pa.array([pack_words(list(found))]), "more": pa.array([packed(np.fromiter(found.values(), np.int64, len(found)))])})

    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", data binary, more binary")


def word_totals(model: DataFrame) -> tuple[int, int]:
    """Words in the training texts, and distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [unpacked(x.as_py(), np.int64) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c > 0).sum()) for c in counts], pa.int64())], names=["n", "v"])

    found = model.select("more").mapInArrow(run, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return found["n"] or 0, found["v"] or 0


def shortest(model: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Trained keys of one context symbol (none, if the order is 0) with their counts: 258 x 257 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, more in zip(batch.column(0), batch.column(1), strict=True):
                grams, counts = unpack_grams(data.as_py()), unpacked(more.as_py(), np.int64)
                keys, sums = summed(grams[counts > 0] & symbols_mask(min(order, 1) + 1), counts[counts > 0])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums)], names=["key", "n"])

    rows = model.select("data", "more").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return summed(rows.column("key").to_numpy().astype(U64), rows.column("n").to_numpy())


class Table:
    """Values by gram, in an open hash table."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(grams)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, ~U64(0)), np.zeros(size)
        slot, todo = self.slot(grams), np.arange(len(grams))
        while len(todo):
            free = self.keys[slot] == ~U64(0)
            self.keys[slot[free]] = grams[todo[free]]
            placed = self.keys[slot] == grams[todo]
            self.values[slot[placed]] = values[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & (size - 1)

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """Values of grams, all of which are in the table."""
        slot = self.slot(grams)
        lost = np.flatnonzero(self.keys[slot] != grams)
        while len(lost):
            slot[lost] = (slot[lost] + 1) & (len(self.keys) - 1)
            lost = lost[self.keys[slot[lost]] != grams[lost]]
        return self.values[slot]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """SCORES rows: each text's log10 probability under the trie, and under add-one word frequencies."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-size // PART_BYTES)))
    salts = max(1, -(-size // (MOST_BLOCKS * block_bytes)))
    counted = materialize(count_blocks(docs, held, order, block_bytes, parts), "counts", "kind")
    asked = counted.where("kind != 'text'").select("kind", "block", "part", F.pmod("block", F.lit(salts)).cast("int").alias("salt"), "data", "more")
    grams, words = asked.where("kind = 'gram'"), asked.where("kind = 'word'")
    model = materialize(sum_parts(sum_parts(grams, ["part", "salt"]), ["part"]), "grams")
    known_words = materialize(sum_words(sum_words(words, ["part", "salt"]), ["part"]), "words")
    n, v = word_totals(known_words)
    ends = docs.where(~held).count()
    n, v = n + ends, v + (ends > 0)
    short = docs.sparkSession.sparkContext.broadcast(shortest(model, order))

    def answer(own: pa.Table, known: pa.Table) -> pa.Table:
        grams, counts = unpack_grams(known.column("data")[0].as_py()), unpacked(known.column("more")[0].as_py(), np.int64)
        costs = costs_of(grams, counts, short.value, order)
        found = [packed(costs[np.searchsorted(grams, unpack_grams(x.as_py()))]) for x in own.column("data")]
        return pa.table({"block": own.column("block"), "data": own.column("data"), "more": pa.array(found, pa.binary())})

    def answer_words(own: pa.Table, known: pa.Table) -> pa.Table:
        counts = dict(zip(unpack_words(known.column("data")[0].as_py()), unpacked(known.column("more")[0].as_py(), np.int64).tolist(), strict=True))
        found = [packed(np.array([counts[w] for w in unpack_words(x.as_py())], np.int64)) for x in own.column("data")]
        return pa.table({"block": own.column("block"), "data": own.column("data"), "more": pa.array(found, pa.binary())})

    def answers(rows: DataFrame, model: DataFrame, run: Callable, kind: str) -> DataFrame:
        spread = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = rows.groupBy("part", "salt").cogroup(spread.groupBy("part", "salt")).applyInArrow(run, "block long, data binary, more binary")
        return found.select("block", F.lit(kind).alias("kind"), "data", "more")

    rows = counted.where("kind = 'text'").select("block", F.lit("text").alias("kind"), "data", "more")
    rows = rows.unionByName(answers(grams, model, answer, "gram")).unionByName(answers(words, known_words, answer_words, "word"))

    def run(table: pa.Table) -> pa.Table:
        kind = np.array(table.column("kind").to_pylist())
        of = lambda name: table.filter(pa.array(kind == name))
        pairs = of("gram")
        lookup = Table(np.concatenate([np.zeros(0, U64), *(unpack_grams(x.as_py()) for x in pairs.column("data"))]), np.concatenate([np.zeros(0), *(unpacked(x.as_py(), np.float64) for x in pairs.column("more"))]))
        known = {}
        for x, y in zip(of("word").column("data"), of("word").column("more"), strict=True):
            known.update(zip(unpack_words(x.as_py()), unpacked(y.as_py(), np.int64).tolist(), strict=True))
        own = pa.ipc.open_stream(zstandard.decompress(of("text").column("data")[0].as_py())).read_all()
        texts = own.column("text").to_pylist()
        total = np.zeros(len(texts))
        for i, j in groups(texts, 1 << 20):
            grams, at = grams_of(texts[i:j], order)
            total[i:j] = np.add.reduceat(lookup(grams), at)
        each = math.log10(n + v + 1)
        tokens, hits, base = [], [], []
        for t in texts:
            c = np.array([known[w] for w in t.split()] + [ends], np.float64)
            tokens.append(len(c))
            hits.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 1).sum()) - len(c) * each)
        size = len(texts)
        return pa.table({"doc_id": own.column("doc_id"), "held_out": own.column("held"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(hits, pa.int64()), "train_tokens": pa.array([n] * size, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total)})

    return rows.groupBy("block").applyInArrow(run, SCORES)


class Trie:
    """A byte-context trie in memory, for adaptive coding and as the definition that the tables follow."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(Counter)

    def cost(self, context: tuple, symbol: int) -> float:
        """log10 probability of a symbol after a context (``order`` symbols)."""
        ruled: set[int] = set()
        out = 0.0
        for d in range(self.order, -1, -1):
            found = self.counts.get(context[len(context) - d :])
            if not found:
                continue
            left = {s: c for s, c in found.items() if s not in ruled}
            whole = 2 * sum(left.values())
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / whole)
            if left:
                out += math.log10(len(left) / whole)
            ruled |= set(found)
        return out - math.log10(SYMBOLS - len(ruled))

    def learn(self, context: tuple, symbol: int) -> None:
        for d in range(self.order + 1):
            self.counts[context[len(context) - d :]][symbol] += 1

    def walk(self, text: bytes | None) -> Iterator[tuple[tuple, int]]:
        symbols = [BEGIN] * self.order + [*normal(text), END]
        for i in range(self.order, len(symbols)):
            yield tuple(symbols[i - self.order : i]), symbols[i]


def adaptive_score(text: bytes | None, order: int = ORDER) -> float:
    """log10 probability of a text under a trie that starts empty and learns as it goes."""
    own, total = Trie(order), 0.0
    for context, symbol in own.walk(text):
        total += own.cost(context, symbol)
        own.learn(context, symbol)
    return total


def adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, score: each text by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([adaptive_score(t.as_py(), order) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def fold(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    """Whether a document is held out: crc32 of its id as text modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == held
