"""Repair of conversations: the cheapest edits that give role initials ``(s?(ua)+)?``.

Nodes are (row, state of the pattern); arcs are edits.  Keep (K) costs 0 where the pattern
takes the row's initial, Rerole (R) to user or assistant 3, Delete (D) 4, Insert (I) of an
empty user or assistant row 3; a truncated row that stays adds 3; blank and duplicate rows can
only be deleted.  Forward and backward minimum costs mark the optimal arcs: those whose cost is
just what lies between the two.  A walk along them takes the least letter at each step, which
gives the ASCII-least of the cheapest edit strings.  The walk's frontier is one node: the pattern is
deterministic, so that a letter leads from a node to one node only.

A conversation may be of any length.  Rows are sorted by ranges over all conversations and cut
into blocks of at most BLOCK_ROWS rows or BLOCK_BYTES bytes of text.  A block is a 4 x 4 matrix of
least costs between states; a pass over a conversation's matrices (one for each block) gives
both costs at its borders; then every block walks by itself from each state that an optimal
path can enter it in, and a last pass over those states says which one does.  Only
the digest of a conversation, one SHA-256, takes its repaired text in order in one task, block by block.

Cases: null text or role counts as one space.  Rows go by turn, null turns first, ties by role, then
the SHA-256 of the row's role and text, then the row's number.  Rows that repeat (conv_id, turn) are rows of their
own.  All rows without conv_id are one conversation.  A role whose initial isn't s, u or a can
only be reroled or deleted.  A conversation without rows gets zeros and the digest of no text.  Empty
tables give no rows; other columns than the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, binary_parts, materialize

BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults of a row, the first that holds from below up; codes of a row are 4 * fault + initial.
FAULTS = {"none": 0, "truncated": 1, "duplicate": 2, "blank": 3}
#: States: nothing yet, after s, after u, after a.  The next state by initial (s, u, a, other), -1: not taken.
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The state after the one row that may be inserted or reroled to, and that row's role.
FORCED, FORCED_ROLE = np.array([2, 2, 3, 2]), ["user", "user", "assistant", "user"]
FAR = 1 << 40
_LETTERS = "DKR"  # a step is 4 * (rows inserted before) + place in here


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least cost of inserts between states; cost of a row's arcs by code; cost from a state to the end."""
    inserts = np.full((4, 4), FAR)
    for s in range(4):
        at, cost = s, 0
        while cost < inserts[s, at]:
            inserts[s, at], at, cost = cost, FORCED[at], cost + INSERT
    arcs = np.full((16, 4, 4), FAR)
    for code in range(16):
        fault, initial = divmod(code, 4)
        for s in range(4):
            if fault < FAULTS["duplicate"]:
                late = TRUNCATED * (fault == FAULTS["truncated"])
                arcs[code, s, FORCED[s]] = REROLE + late
                if NEXT[s, initial] >= 0:
                    arcs[code, s, NEXT[s, initial]] = KEEP + late
            arcs[code, s, s] = min(arcs[code, s, s], DELETE)
    return inserts, arcs, inserts[:, [0, 3]].min(axis=1)


INSERTS, ARCS, END = _tables()
#: Inserts before a row and the row's own arc.
STEP = np.minimum(FAR, (INSERTS[None, :, :, None] + ARCS[:, None, :, :]).min(axis=2))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (ROW, conv_id, turn, role, text) after the set damage, by the CRC-32 of ``conv_id:turn``: ROW, copy, conv_id, turn, role, text."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text, role = F.crc32(key) % 20, F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hurt = rows.select(
        ROW, "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text")).where("kind != 0")
    return hurt.select(ROW, F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))).alias("copy"), "conv_id", "turn", "role", "text")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``code`` and ``digest``; an earlier equal row is found by sums, not by a window over a conversation."""
    ended = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)))
    order = F.struct(F.col("turn").isNotNull().alias("set"), "turn", ROW, "copy")
    firsts = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_n"), F.min(order).alias("_first")).where("_n > 1")
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    fault = (
        F.when(ended == "", FAULTS["blank"]).when(F.coalesce(order != F.col("_first"), F.lit(False)), FAULTS["duplicate"])
        .when(~F.substring(ended, -1, 1).isin(".", "!", "?"), FAULTS["truncated"]).otherwise(FAULTS["none"]))
    initial = F.coalesce(F.nullif(F.expr("locate(substring(role, 1, 1), 'sua')"), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    return met.select(ROW, "copy", "conv_id", "turn", "role", "text", "digest", (4 * fault + initial).cast("int").alias("code"))


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc(ROW), F.asc("copy")]


_SUMS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_BLOCK = "conv_id long, part long, seq long, codes binary, roles array<string>, texts array<string>, " + ", ".join(f"{c} long" for c in _SUMS) + ", head int, tail int, low long, high long, costs array<long>"
#: Pairs of adjacent initials that are in order: su, ua, au.
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def least_costs(codes: list[np.ndarray]) -> np.ndarray:
    """For each block of codes, the 4 x 4 least costs from the state before it to the one after."""
    sizes = np.array([len(c) for c in codes])
    out = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(codes), 4, 4)).copy()
    order = np.argsort(-sizes, kind="stable")
    ends = -np.sort(-sizes)
    for i in range(0, len(codes), 4096):
        part, n = order[i : i + 4096], ends[i : i + 4096]
        grid = np.zeros((len(part), n[0] if len(n) else 0), np.uint8)
        for row, k in enumerate(part.tolist()):
            grid[row, : sizes[k]] = codes[k]
        own = out[part]
        for t in range(grid.shape[1]):
            m = int(np.searchsorted(-n, -t, side="left"))  # blocks longer than t
            own[:m] = np.minimum(FAR, (own[:m, :, :, None] + STEP[grid[:m, t]][:, None]).min(axis=2))
        out[part] = own
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """Rows with faults, sorted over all conversations and cut into blocks with their sums and least costs."""

    def pack(table: pa.Table, starts: np.ndarray, seq: int) -> pa.RecordBatch:
        """Blocks that begin at ``starts`` (the table's end closes the last)."""
        ends = np.append(starts[1:], table.num_rows)
        code, turn = table.column("code").to_numpy().astype(np.uint8), table.column("turn").combine_chunks()
        empty = turn.is_null().to_numpy(zero_copy_only=False)
        at = np.where(empty, 0, turn.fill_null(0).to_numpy())
        fault, initial = code // 4, code % 4
        inner = np.ones(table.num_rows, bool)
        inner[starts] = False
        follows = np.append(False, ~_LEGAL[initial[:-1], initial[1:]]) & inner
        anew = ~empty & ~(inner & np.append(False, at[1:] == at[:-1]) & np.append(False, ~empty[:-1]))
        total = lambda mask: pa.array(np.add.reduceat(mask.astype(np.int64), starts))
        some = np.maximum.reduceat(~empty, starts)
        low = np.minimum.reduceat(np.where(empty, 2**63 - 1, at), starts)
        high = np.maximum.reduceat(np.where(empty, -(2**63), at), starts)
        lists = lambda c: pa.ListArray.from_arrays(pa.array(np.append(starts, table.num_rows).astype(np.int32)), table.column(c).combine_chunks())
        kept = [code[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        columns = [
            table.column("conv_id").combine_chunks().take(pa.array(starts)), table.column("part").combine_chunks().take(pa.array(starts)), pa.array(np.arange(seq, seq + len(starts))),
            pa.array([c.tobytes() for c in kept], pa.binary()), lists("role"), lists("text"), total(fault == 3), total(fault == 2), total(fault == 1), total(follows), total(anew),
            pa.array(initial[starts].astype(np.int32)), pa.array(initial[ends - 1].astype(np.int32)), pa.array(low, mask=~some), pa.array(high, mask=~some),
            pa.array(list(least_costs(kept).reshape(-1, 16)), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        seq = 0

        def cut(table: pa.Table) -> np.ndarray:
            conv = table.column("conv_id").combine_chunks()
            empty, value = conv.is_null().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
            new = np.append(True, (value[1:] != value[:-1]) | (empty[1:] != empty[:-1]))
            runs = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            sizes = np.diff(binary_parts(table.column("text").cast(pa.large_string()))[1])
            before = np.cumsum(sizes) - sizes
            rows_in, bytes_in = np.arange(len(new)) - runs[of], before - before[runs[of]]
            step = rows_in // BLOCK_ROWS + bytes_in // BLOCK_BYTES
            return np.flatnonzero(new | np.append(False, step[1:] != step[:-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            starts = cut(table)
            if len(starts) > 1:
                yield pack(table.slice(0, starts[-1]).combine_chunks(), starts[:-1], seq)
                seq += len(starts) - 1
            held = table.slice(starts[-1])
        if held is not None:
            held = held.combine_chunks()
            yield pack(held, cut(held), seq)

    ordered = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    return ordered.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "turn", "role", "text", "code").mapInArrow(run, _BLOCK)


def by_conversation(df: DataFrame) -> DataFrame:
    """Blocks of one conversation in order in one partition."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of rows that come sorted by conv_id such that none is cut, with the places where one begins."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            starts = _begins(held)
            if len(starts) > 1:
                yield held.slice(0, starts[-1]).combine_chunks(), starts[:-1]
                held = held.slice(starts[-1])
    if held is not None:
        held = held.combine_chunks()
        yield held, _begins(held)


def _begins(table: pa.Table) -> np.ndarray:
    conv = table.column("conv_id").combine_chunks()
    empty, value = conv.is_null().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
    return np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (empty[1:] != empty[:-1])))


_FOLD = "conv_id long, part long, seq long, before array<long>, after array<long>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def borders(packed: DataFrame) -> DataFrame:
    """For each block the least costs from the conversation's start (before) and to its end (after); sums of a conversation at its last block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_conversations(batches):
            n = table.num_rows
            ends = np.append(starts[1:], n)
            costs = np.array(table.column("costs").combine_chunks().values.to_numpy()).reshape(n, 4, 4)
            before, after = np.full((n, 4), FAR), np.zeros((n, 4), np.int64)
            before[starts, 0] = 0
            after[ends - 1] = END
            many = np.flatnonzero(ends - starts > 1)
            for a, b in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                for k in range(a + 1, b):
                    before[k] = np.minimum(FAR, (before[k - 1][:, None] + costs[k - 1]).min(axis=0))
                for k in range(b - 2, a - 1, -1):
                    after[k] = np.minimum(FAR, (costs[k + 1] + after[k + 1][None, :]).min(axis=1))
            final = ends - 1
            cost = ((before[final][:, :, None] + costs[final]).min(axis=1) + after[final]).min(axis=1)
            head, tail = table.column("head").to_numpy(), table.column("tail").to_numpy()
            low, high = table.column("low").combine_chunks(), table.column("high").combine_chunks()
            none = low.is_null().to_numpy(zero_copy_only=False)
            first, past = np.where(none, 0, low.fill_null(0).to_numpy()), np.where(none, 0, high.fill_null(0).to_numpy())
            inner = np.ones(n, bool)
            inner[starts] = False
            broken = inner & np.append(False, ~_LEGAL[tail[:-1], head[1:]])
            again = inner & ~none & np.append(False, (past[:-1] == first[1:]) & ~none[:-1])
            total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
            some = np.maximum.reduceat(~none, starts)
            least, most = np.minimum.reduceat(np.where(none, 2**62, first), starts), np.maximum.reduceat(np.where(none, -(2**62), past), starts)
            turns = total(table.column("turns").to_numpy()) - total(again)
            sums = [np.where(some, most - least + 1 - turns, 0), *(total(table.column(c).to_numpy()) for c in ("blank", "duplicate", "truncated")), total(table.column("illegal").to_numpy()) + total(broken), cost]
            last = np.zeros(n, bool)
            last[final] = True

            def placed(values: np.ndarray, n: int = n, last: np.ndarray = last, final: np.ndarray = final) -> pa.Array:
                wide = np.zeros(n, np.int64)
                wide[final] = values
                return pa.array(wide, mask=~last)

            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks() for c in ("conv_id", "part", "seq")), pa.array(list(before), kinds), pa.array(list(after), kinds), pa.array(last), *map(placed, sums)],
                names=[c.split()[0] for c in _FOLD.split(", ")],
            )

    light = packed.select("conv_id", "part", "seq", *_SUMS, "head", "tail", "low", "high", "costs")
    return by_conversation(light).mapInArrow(run, _FOLD)


def walk(codes: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, list[list[bytes | None]]]:
    """For blocks with the costs at their borders: exit state and steps by state of entry (-1, None: on no optimal path)."""
    sizes = np.array([len(c) for c in codes])
    exits, steps = np.full((len(codes), 4), -1), [[None] * 4 for _ in codes]
    order, i = np.argsort(sizes, kind="stable"), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * int(sizes[order[j]]) <= 1 << 18:
            j += 1
        part = order[i:j]
        i = j
        n, longest = len(part), int(sizes[part[-1]])
        grid = np.full((n, longest), -1, np.int64)
        for row, k in enumerate(part.tolist()):
            grid[row, : sizes[k]] = codes[k]
        ahead, back = np.zeros((longest + 1, n, 4), np.int64), np.zeros((longest + 1, n, 4), np.int64)
        close = lambda v: np.minimum(FAR, (v[:, :, None] + INSERTS).min(axis=1))
        ahead[0] = close(before[part])
        for t in range(longest):
            live = grid[:, t] >= 0
            ahead[t + 1] = np.where(live[:, None], close(np.minimum(FAR, (ahead[t][:, :, None] + ARCS[grid[:, t]]).min(axis=1))), ahead[t])
        back[longest] = after[part]
        for t in range(longest - 1, -1, -1):
            live = grid[:, t] >= 0
            back[t] = np.where(live[:, None], np.minimum(FAR, (STEP[grid[:, t]] + back[t + 1][:, None, :]).min(axis=2)), back[t + 1])
        best = (before[part] + back[0]).min(axis=1)
        who, state = np.nonzero(before[part] + back[0] == best[:, None])  # a walker for each state that an optimal path enters
        entry, letters = state.copy(), np.zeros((len(who), longest), np.uint8)
        for t in range(longest):
            code, moving = grid[who, t], np.flatnonzero(grid[who, t] >= 0)
            inserted = np.zeros(len(who), np.int64)
            while len(moving):
                w, s, c = who[moving], state[moving], code[moving]
                here, goal = ahead[t, w, s], best[w]
                tight = lambda cost, to, layer, w=w, here=here, goal=goal: here + cost + back[layer, w, to] == goal
                stays = (c // 4 < FAULTS["duplicate"]) * 1
                late = TRUNCATED * (c // 4 == FAULTS["truncated"])
                taken = NEXT[s, c % 4]
                d, ins = tight(DELETE, s, t + 1), tight(INSERT, FORCED[s], t)
                k = (stays == 1) & (taken >= 0) & tight(KEEP + late, taken, t + 1)
                r = (stays == 1) & tight(REROLE + late, FORCED[s], t + 1)
                again = ins & ~d  # D < I < K < R
                row = np.where(d, 0, np.where(k, 1, 2))
                if not (d | ins | k | r).all():
                    raise ValueError("no optimal arc leads on")
                goes = moving[~again]
                letters[goes, t] = 4 * inserted[goes] + row[~again]
                state[goes] = np.where(row == 0, s, np.where(row == 1, taken, FORCED[s]))[~again]
                on = moving[again]
                inserted[on] += 1
                state[on] = FORCED[s[again]]
                moving = on
        for k, w in enumerate(who.tolist()):
            at = int(part[w])
            exits[at, entry[k]], steps[at][entry[k]] = state[k], letters[k, : sizes[at]].tobytes()
    return exits, steps


def traced(packed: DataFrame, costs: DataFrame) -> DataFrame:
    """conv_id, part, seq, last, exits and steps (by state of entry) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.frombuffer(c, np.uint8) for c in batch.column("codes").to_pylist()]
            if codes:
                ends = [np.array(batch.column(c).to_pylist(), np.int64) for c in ("before", "after")]
                exits, steps = walk(codes, *ends)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("conv_id", "part", "seq", "last")), pa.array(list(exits.astype(np.int32)), pa.list_(pa.int32())), pa.array(steps, pa.list_(pa.binary()))],
                    names=["conv_id", "part", "seq", "last", "exits", "steps"],
                )

    joined = packed.select("part", "seq", "codes").join(costs.select("conv_id", "part", "seq", "last", "before", "after"), ["part", "seq"])
    return joined.mapInArrow(run, "conv_id long, part long, seq long, last boolean, exits array<int>, steps array<binary>")


def entries(walks: DataFrame) -> DataFrame:
    """part, seq, entry: the state in which the walk of its conversation enters each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_conversations(batches):
            exits = np.array(table.column("exits").to_pylist(), np.int64)
            entry = np.zeros(table.num_rows, np.int32)
            first = np.zeros(table.num_rows, bool)
            first[starts] = True
            for k in np.flatnonzero(~first).tolist():  # blocks but for a conversation's first one
                entry[k] = exits[k - 1, entry[k - 1]]
            yield pa.RecordBatch.from_arrays([table.column("part").combine_chunks(), table.column("seq").combine_chunks(), pa.array(entry)], names=["part", "seq", "entry"])

    return by_conversation(walks.select("conv_id", "part", "seq", "exits")).mapInArrow(run, "part long, seq long, entry int")


_REPAIRED = "conv_id long, part long, seq long, last boolean, audit string, turns array<struct<role:string,text:string,edit:string>>"


def rendered(packed: DataFrame, walks: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, part, seq, last, audit (letters) and turns (role, text, edit) of each block's repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, turns = [], []
            last = batch.column("last").to_pylist()
            for k, (roles, texts, steps, state) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "way", "entry")), strict=True)):
                audit, out = [], []

                def insert(state: int, audit: list = audit, out: list = out) -> int:
                    audit.append("I")
                    out.append({"role": FORCED_ROLE[state], "text": "", "edit": "I"})
                    return int(FORCED[state])

                for role, text, step in zip(roles, texts, steps, strict=True):
                    for _ in range(step >> 2):
                        state = insert(state)
                    letter = _LETTERS[step & 3]
                    audit.append(letter)
                    if letter == "K":
                        state = int(NEXT[state, "sua".find(role[:1])])
                        out.append({"role": role, "text": text, "edit": letter})
                    elif letter == "R":
                        out.append({"role": FORCED_ROLE[state], "text": text, "edit": letter})
                        state = int(FORCED[state])
                while last[k] and state not in (0, 3):
                    state = insert(state)
                audits.append("".join(audit))
                turns.append(out)
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "seq", "last")), pa.array(audits, pa.string()), pa.array(turns, kind)], names=["conv_id", "part", "seq", "last", "audit", "turns"])

    ways = walks.join(chosen, ["part", "seq"]).select("part", "seq", "conv_id", "last", "entry", F.get("steps", F.col("entry")).alias("way"))
    return packed.select("part", "seq", "roles", "texts").join(ways, ["part", "seq"]).mapInArrow(run, _REPAIRED)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks of repaired turns in order of part and seq, sums of each conversation that has rows) of ``rows`` (ROW, copy, conv_id, turn, role, text)."""
    packed = materialize(blocks(with_faults(rows)), "blocks")
    costs = materialize(borders(packed), "borders")
    walks = materialize(traced(packed, costs), "walks")
    mended = materialize(rendered(packed, walks, entries(walks)), "repaired")
    return mended, costs.where("last").drop("part", "seq", "before", "after", "last")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, part, seq, place, role, text, edit: the repaired rows; in order by (part, seq, place) within a conversation."""
    return repair(rows)[0].select("conv_id", "part", "seq", F.posexplode("turns").alias("place", "t")).select("conv_id", "part", "seq", "place", "t.*")


def digests(mended: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of each conversation: blocks go through one hash in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        audit, digest, begun = [], hashlib.sha256(), False
        for batch in batches:
            for conv, last, letters, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "last", "audit", "lines")), strict=True):
                audit.append(letters)
                if turns:
                    digest.update((b"\n" if begun else b"") + turns.encode())
                    begun = True
                if last:
                    done.append((conv, "".join(audit), digest.hexdigest()))
                    audit, digest, begun = [], hashlib.sha256(), False
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "audit", "repaired_sha256"])
                done = []

    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return by_conversation(mended.select("conv_id", "part", "seq", "last", "audit", lines.alias("lines"))).mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows`` (ROW, conv_id, turn, role, text), damaged and repaired: its faults, cost, audit and digest."""
    rows = rows.select(ROW, "conv_id", "turn", "role", "text")
    mended, sums = repair(damaged(rows))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    side = lambda df, key: df.withColumnRenamed("conv_id", key)
    every = rows.select("conv_id").distinct()
    found = side(sums, "_a").join(side(digests(mended), "_b"), F.col("_a").eqNullSafe(F.col("_b")))
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_a")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
