"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding is our own: an agenda of adjacent symbol pairs ordered by score, then position;
the best pair merges, its new neighbours enter, until no pair is in the vocabulary.
Symbols outside the vocabulary become byte pieces.  No merge crosses a pair of characters
that no piece has side by side, so a text is cut there into chunks, which are encoded
apart.  All of it goes by blocks of texts in arrays: chunks are named by 64-bit hashes, those
that a worker doesn't remember run their agendas together as rows of a matrix (long ones on
a heap), and ids are gathered for all chunks at once.  What is remembered has a fixed size.
Every whole text of ``coded`` is encoded and decoded by the sentencepiece library too; any
difference raises, also one by two chunks with one hash.

Cases: null counts as empty, which has the end id only.  Texts of any length are taken
whole.  Other columns are not touched by ``encode``.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Chunks that a worker remembers (a power of two), and the most ids of one of them.
REMEMBER, MOST_IDS = 1 << 19, 8
#: Characters of the longest chunk that goes into a matrix.
LONG = 64
#: Characters of a block of texts, about.
BLOCK = 100_000
_codecs: dict[str, PieceCodec] = {}


def hash_of(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit names of runs of code points that follow one another: sums of all points, each mixed with its place in the run."""
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(mix(((place << 21) + points + 1).view(np.uint64)), starts))


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Memory:
    """Ids of chunks by hash.  Each hash has one place; the chunk that came last has it."""

    def __init__(self, places: int = REMEMBER, most: int = MOST_IDS):
        self.hashes, self.counts, self.ids = np.zeros(places, np.uint64), np.zeros(places, np.uint8), np.zeros((places, most), np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether its chunk is there."""
        place = (hashes & np.uint64(len(self.hashes) - 1)).astype(np.int64)
        return place, (self.hashes[place] == hashes) & (self.counts[place] > 0)

    def put(self, hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Remember chunks, whose ids are runs of ``ids``; those of more than the most ids are passed over."""
        fit = np.flatnonzero(counts <= self.ids.shape[1])
        place, one = np.unique(self.find(hashes[fit])[0], return_index=True)
        fit = fit[one]
        cols = np.arange(self.ids.shape[1])
        self.hashes[place], self.counts[place] = hashes[fit], counts[fit]
        self.ids[place] = ids[np.minimum(starts[fit][:, None] + cols, max(0, len(ids) - 1))] if len(fit) else 0

    def __setitem__(self, chunk: str, row: tuple[int, str, str]) -> None:
        """``row``: count, ids and text of a chunk; its ids are kept."""
        points, ids = points_of(chunk), np.array(row[1].split(), np.int32)
        self.put(hash_of(points, np.array([0]), np.array([len(points)])), ids, np.array([0]), np.array([len(ids)]))


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(pieces, special, strict=True)) if not s}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.pieces = pieces
        self.byte = [0] * 256
        self.value = {}
        for i in range(n):
            if self.library.is_byte(i):
                self.byte[int(pieces[i][3:5], 16)] = i
                self.value[i] = int(pieces[i][3:5], 16)
        self.end = self.library.eos_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with an inner word mark: chunks can't be encoded apart")
        # no merge crosses a pair of characters that stand side by side in no piece; pairs by hash: others there only make longer chunks
        self.bonds = np.zeros(1 << 20, bool)
        bonds = np.array(sorted({(ord(a), ord(b)) for p in self.ids for a, b in zip(p, p[1:], strict=False)}), np.uint32).reshape(-1, 2)
        self.bonds[self.bond(bonds[:, 0], bonds[:, 1])] = True
        self.names = [str(i) for i in range(n)]
        #: Bytes of each piece's text.
        self.raw = [bytes([self.value[i]]) if i in self.value else b"" if i == self.end else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.memory = Memory()
        self.prepare_table()

    def prepare_table(self) -> None:
        """The agenda's table: which two symbols make which piece, by one sorted key."""
        n = len(self.pieces)
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_piece = keys[order], table[order, 2]
        # most pairs have a place of their own by hash; the sorted keys are for places that several pairs share
        self.place_key, self.place_piece, self.shared = np.full(1 << 19, -1, np.int64), np.full(1 << 19, -1, np.int32), np.zeros(1 << 19, bool)
        place, first, size = np.unique(self.place(table[:, 0], table[:, 1]), return_index=True, return_counts=True)
        self.place_key[place], self.place_piece[place], self.shared[place] = keys[first], table[first, 2], size > 1
        order_of = {x: k for k, x in enumerate(sorted({self.scores[p] for p in self.ids}, reverse=True))}
        self.priority = np.full(n, NONE, np.int32)
        for p, i in self.ids.items():
            self.priority[i] = order_of[self.scores[p]]
        #: Symbol of each code point: its piece, or a number from len(pieces) on.
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i

    @staticmethod
    def bond(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(12)

    @staticmethod
    def place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint32) * np.uint32(0x9E3779B1) + right.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(13)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two symbols make, or -1."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.place(left, right)
        piece = np.where(self.place_key[at] == key, self.place_piece[at], -1)
        rest = np.flatnonzero((piece < 0) & self.shared[at])
        if len(rest):
            near = np.minimum(np.searchsorted(self.pair_keys, key[rest]), len(self.pair_keys) - 1)
            piece[rest] = np.where(self.pair_keys[near] == key[rest], self.pair_piece[near], -1)
        return piece

    def agenda(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        piece = self.pair(left, right)
        return np.where(piece >= 0, self.priority[piece], NONE).astype(np.int32)

    def merge_block(self, known: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of chunks of like length, one after the other, and their counts: each row's agenda gives up its best
        pair, leftmost of equals, round by round.  ``known``: the symbols of their characters.

        A number from len(pieces) on stands for a character outside the vocabulary.
        """
        width = int(lengths.max()) + 1
        cols = np.arange(width)
        symbols = np.full((len(lengths), width), -1, np.int32)
        symbols[cols < lengths[:, None]] = known
        scores = np.full((len(lengths), width), NONE, np.int32)
        inner = cols < lengths[:, None] - 1
        r, c = np.nonzero(inner)
        scores[r, c] = self.agenda(symbols[r, c], symbols[r, c + 1])
        live = np.arange(len(lengths))
        s, a = symbols, scores
        while len(live):
            best = a.argmin(axis=1)
            go = a[np.arange(len(live)), best] < NONE
            if not go.all():
                symbols[live] = s
                live, s, a, best = live[go], s[go], a[go], best[go]
                if not len(live):
                    break
            rows = np.arange(len(live))
            made = self.pair(s[rows, best], s[rows, best + 1])
            beyond = cols[None, :-1] > best[:, None]
            s[:, :-1] = np.where(beyond, s[:, 1:], s[:, :-1])
            s[rows, best] = made
            a[:, :-1] = np.where(cols[None, :-1] >= best[:, None], a[:, 1:], a[:, :-1])
            a[:, -1] = NONE
            s[:, -1] = -1
            right = s[rows, best + 1]
            a[rows, best] = np.where(right >= 0, self.agenda(made, right), NONE)
            had = best > 0
            a[rows[had], best[had] - 1] = self.agenda(s[rows[had], best[had] - 1], made[had])
        return symbols[symbols >= 0], (symbols >= 0).sum(axis=1)

    def merge_runs(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks in blocks of like length, very long ones by a heap each: all ids, and each chunk's first and count."""
        order = np.argsort(lengths, kind="stable")
        short = order[: int(np.searchsorted(lengths[order], LONG, side="right"))]
        limit, found, counts = len(self.pieces), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(short), 4096):
            block = short[k : k + 4096]
            n = lengths[block]
            ends = np.cumsum(n)
            symbols, count = self.merge_block(self.symbol[points[np.arange(ends[-1]) + np.repeat(starts[block] - ends + n, n)]], n)
            if symbols.max() >= limit:  # characters outside the vocabulary
                parts = [[y] if y < limit else [self.byte[b] for b in chr(y - limit).encode("utf-8", "surrogatepass")] for y in symbols.tolist()]
                count = np.add.reduceat(np.array([len(x) for x in parts]), np.cumsum(count) - count)
                symbols = np.array([x for part in parts for x in part], np.int32)
            found.append(symbols)
            counts.append(count)
        for i in order[len(short) :].tolist():
            ids: list[int] = []
            for s in self.merged_by_heap(points[starts[i] : starts[i] + lengths[i]].tobytes().decode("utf-32-le", "surrogatepass")):
                one = self.ids.get(s)
                ids += [self.byte[b] for b in s.encode("utf-8", "surrogatepass")] if one is None else [one]
            found.append(np.array(ids, np.int32))
            counts.append(np.array([len(ids)]))
        all_counts = np.concatenate(counts)
        first, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        first[order], count[order] = np.cumsum(all_counts) - all_counts, all_counts
        return np.concatenate(found), first, count

    def merge_many(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, each not empty."""
        lengths = np.array([len(c) for c in chunks], np.int64)
        ids, first, count = self.merge_runs(points_of("".join(chunks)), np.cumsum(lengths) - lengths, lengths)
        return [ids[a : a + n].tolist() for a, n in zip(first.tolist(), count.tolist(), strict=True)]

    def merged_by_heap(self, chunk: str) -> list[str]:
        """For long chunks: a heap; pairs whose sides have merged meanwhile are passed over."""
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []
        for i in range(n - 1):
            score = scores.get(chunk[i : i + 2])
            if score is not None:
                agenda.append((-score, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or len(left) + len(right) != size or after[i] != j:
                continue
            symbols[i], symbols[j] = left + right, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                score = scores.get(symbols[i] + symbols[k])
                if score is not None:
                    heapq.heappush(agenda, (-score, i, k, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                score = scores.get(symbols[h] + symbols[i])
                if score is not None:
                    heapq.heappush(agenda, (-score, h, i, len(symbols[h]) + size))
        return [s for s in symbols if s is not None]

    def surface(self, ids: list[int]) -> str:
        """Text of ids, with word marks as spaces; runs of byte pieces decode as UTF-8."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, the first of each chunk, and each text's first chunk (and the end)."""
        points = points_of("".join([MARK + t.replace(" ", MARK) for t in texts if t]))
        at = np.cumsum([0, *[len(t) + 1 if t else 0 for t in texts]])
        begins = np.ones(len(points), bool)
        left, right = points[:-1], points[1:]
        begins[1:] = ~self.bonds[self.bond(left, right)] | ((right == ord(MARK)) & (left != ord(MARK)))
        begins[at[at < len(points)]] = True
        starts = np.flatnonzero(begins)
        return points, starts, np.searchsorted(starts, at)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text between which no merge can happen."""
        points, starts, _ = self.cut([text])
        marked = points.tobytes().decode("utf-32-le", "surrogatepass")
        return [marked[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(marked)], strict=True)] if text else []

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts without end ids, and each text's first (and the end)."""
        points, starts, bounds = self.cut(texts)
        if not len(points):
            return np.zeros(0, np.int32), bounds
        lengths = np.diff(starts, append=len(points))
        hashes = hash_of(points, starts, lengths)
        place, had = self.memory.find(hashes)
        lacking = np.flatnonzero(~had)
        fresh, one, own = np.unique(hashes[lacking], return_index=True, return_inverse=True)
        new = lacking[one]
        made, first, count = self.merge_runs(points, starts[new], lengths[new])
        counts, begin = self.memory.counts[place].astype(np.int64), place * self.memory.ids.shape[1]
        counts[lacking], begin[lacking] = count[own], first[own]
        after = np.cumsum(counts)
        at, old = np.arange(after[-1]) + np.repeat(begin - after + counts, counts), np.repeat(had, counts)
        out = np.empty(after[-1], np.int32)
        out[old], out[~old] = self.memory.ids.ravel()[at[old]], made[at[~old]]
        self.memory.put(fresh, made, first, count)
        return out, np.append(0, after)[bounds]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text with the end id."""
        return [*self.ids_of([text or ""])[0].tolist(), self.end]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the mark in front is dropped."""
        text = self.surface(ids)
        return text[1:] if text.startswith(" ") else text


def codec(model: str) -> PieceCodec:
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def checked(own: PieceCodec, texts: list[str]) -> list[tuple[int, str, str]]:
    """Number of ids, ids and decoded text of each text, all held against the library."""
    theirs = [[*ids, own.end] for ids in own.library.encode(texts, num_threads=1)] if texts else []
    shown = own.library.decode(theirs, num_threads=1) if texts else []
    flat, bounds = own.ids_of(texts)
    out = []
    for text, start, end, expected, surface in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), theirs, shown, strict=True):
        ids = [*flat[start:end].tolist(), own.end]
        decoded = own.decode(ids)
        if ids != expected or surface != decoded:
            raise ValueError(f"library differs on a text that begins {text[:60]!r}")
        out.append((len(ids), " ".join(map(own.names.__getitem__, ids)), decoded))
    return out


def blocks(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a column, null as empty, in blocks of about BLOCK characters or one longer text."""
    block, size = [], 0
    for text in column:
        block.append(text.as_py() or "")
        size += len(block[-1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def coded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for texts in blocks(batch.column(1)):
                for n, ids, decoded in checked(own, texts):
                    count.append(n)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """All rows and columns of ``docs`` with ``ids``, the token ids of ``text`` with the end id."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        own = codec(model)
        return pd.Series([own.encode(t) for t in texts])

    return docs.withColumn("ids", ids("text"))
