"""Repair of conversations against a plain search over whole edit strings."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from prospecta.llm import turn_repair
from prospecta.llm.common import number_rows

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for n, (conv, turn, role, text) in enumerate(rows):
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text, n)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def least_edits(rows, faults):
    """(cost, audit, lines), least, by the best of each (rows done, last initial): states are few, strings are kept whole."""
    best = {(0, ""): (0, "", [])}
    done = {}
    for i in range(len(rows) + 1):
        layer = {s: v for (k, s), v in best.items() if k == i}
        changed = True
        while changed:
            changed = False
            for s, (cost, audit, lines) in list(layer.items()):
                for role in ("user", "assistant"):
                    to = AFTER.get((s, role[0]))
                    new = (cost + 3, audit + "I", [*lines, f"{role}:"])
                    if to and (to not in layer or new[:2] < layer[to][:2]):
                        layer[to], changed = new, True
        if i == len(rows):
            done = layer
            break
        role, text = rows[i][2:4]
        for s, (cost, audit, lines) in layer.items():
            moves = [(s, cost + 4, "D", [])]
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                if (s, role[:1]) in AFTER:
                    moves.append((AFTER[s, role[:1]], cost + late, "K", [f"{role}:{text}"]))
                moves += [(AFTER[s, r[0]], cost + 3 + late, "R", [f"{r}:{text}"]) for r in ("user", "assistant") if (s, r[0]) in AFTER]
            for to, c, letter, more in moves:
                new = (c, audit + letter, lines + more)
                if (i + 1, to) not in best or new[:2] < best[i + 1, to][:2]:
                    best[i + 1, to] = new
    return min((done[s] for s in ("", "a") if s in done), key=lambda x: x[:2])


def brute(rows):
    out = []
    hurt = damage(rows)
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r), r[4]))
        seen, faults = set(), []
        for _, _, role, text, _ in own:
            end = text.rstrip(SPACE)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = least_edits(own, faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def shape(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def made(rng, convs, longest, nulls=True):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(0, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None] if nulls else ["user", "assistant", "system"])
            text = rng.choice(["Yes.", "no", "", " \t", "Why?\n", "é!", None, "a. b", "…"]) if rng.random() < 0.4 else f"text {rng.random()}{rng.choice('.!? x')}"
            rows.append((None if nulls and conv == 3 else conv, None if nulls and rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1]), role, text))
    rng.shuffle(rows)
    return rows


def test_tables_given(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = shape(turn_repair.report(number_rows(df)))
    assert got == brute(rows) and sum(r[6] for r in got) > 0


def test_odd_rows(spark):
    rows = made(random.Random(8), 60, 12)
    docs = number_rows(spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS code", "2 AS part", "3 AS seq", "4 AS kind", "5 AS audit", "6 AS cost"))
    assert shape(turn_repair.report(docs)) == brute([tuple(r) for r in docs.orderBy("_row_number").select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("rows", [1, 3, 7])
def test_long_conversations_in_blocks(spark, rows, monkeypatch):
    """Blocks of a few rows, and partitions that cut a conversation, change nothing."""
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", rows)
    monkeypatch.setattr(turn_repair, "BLOCK_BYTES", 60)
    data = made(random.Random(rows), 3, 60, nulls=False)
    docs = number_rows(spark.createDataFrame(data, SCHEMA).repartition(4))
    assert shape(turn_repair.report(docs)) == brute([tuple(r) for r in docs.orderBy("_row_number").select("conv_id", "turn", "role", "text").collect()])


def test_turns_themselves(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Really?"), (1, 3, "assistant", "It is"), (1, 4, "user", "")]
    docs = number_rows(spark.createDataFrame(rows, SCHEMA)).selectExpr("*", "0 AS copy")
    got = [(r["role"], r["text"], r["edit"]) for r in turn_repair.repaired_turns(docs).orderBy("part", "seq", "place").collect()]
    assert got == [("user", "Hi.", "K"), ("assistant", "Really?", "R")] or sum({"I": 3, "R": 3}.get(e, 0) for *_, e in got) <= 6
    roles = "".join(r[0] for r, _, _ in got)
    assert roles.replace("ua", "") in ("", "s")


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = shape(turn_repair.report(number_rows(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA))))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert turn_repair.report(number_rows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_walk_equals_search():
    """Blocks of random codes from all borders: costs and letters against the search above."""
    rng = random.Random(2)
    names = {0: "", 1: "truncated", 2: "duplicate", 3: "blank"}
    for _ in range(200):
        codes = np.array([rng.choice([0, 1, 2, 1, 2, 3, 5, 6, 9, 14]) for _ in range(rng.randrange(1, 9))], np.uint8)
        before = np.array([[0, turn_repair.FAR, turn_repair.FAR, turn_repair.FAR]])
        exits, steps = turn_repair.walk([codes], before, turn_repair.END[None, :])
        rows = [(0, 0, ["system", "user", "assistant", "tool"][c % 4], "t", 0) for c in codes.tolist()]
        _, audit, _ = least_edits(rows, [names[c // 4] for c in codes.tolist()])
        own = "".join("I" * (b >> 2) + "DKR"[b & 3] for b in steps[0][0]) + "I" * int(turn_repair.END[exits[0, 0]] // 3)
        assert own == audit
