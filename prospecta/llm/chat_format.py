"""Chat transcripts to canonical turns: roles by a hidden Markov model.

A transcript is a text of lines.  The states of the model are the roles, each as the
first line of a turn or a later one.  What is observed of a line is its speaker marker
(one of many spellings, or none), whether a blank line or the transcript's start stands
before it, and whether it reads as a question; where a transcript is cut isn't.  Start, transition and emission
probabilities are counted on labelled conversations, with a pseudo-count; Viterbi then
finds the likeliest states, and each turn is rendered in one canonical form: without the marker of
its first line, every other line as it is, inner blank lines too.

Transcripts of any length are decoded in blocks of lines: each block is reduced to the
best scores between any two states at its borders, those are joined along a
conversation (one small row for each block), and each block is then traced on its own.
So a conversation that holds a third of all lines is spread over many tasks.

Cases: null texts and lines of white space only are blank lines.  A transcript without
any other line has no turns.  Null roles are not learned from.  Null conversation ids
are one conversation.  Repeated rows are lines of their own.  Empty tables give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ROLES = ("system", "user", "assistant")
STATES = [(role, begin) for role in ROLES for begin in (True, False)]
N = len(STATES)
#: Rows (pieces of a transcript) in a block.
BLOCK = 256
#: Names of speakers in transcripts and the role that each one means.
SPEAKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "prompt", "question", "q", "customer", "input", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "response", "output", "gpt", "model"),
}
_ROLE = {name: i for i, names in enumerate(SPEAKERS.values()) for name in names}
_NAMES = "|".join(sorted(_ROLE, key=len, reverse=True))
_MARKER = re.compile(rf"^\s*(?:(?:#{{1,4}}\s*|\*\*|>\s*)?({_NAMES})(?:\*\*)?\s*:(?:\*\*)?|(?:<\|?|\[)/?({_NAMES})(?:\|?>|\])\s*:?|#{{2,4}}\s*({_NAMES})\s*$)\s*", re.IGNORECASE)
#: Observations: marker (3: none) x after a blank line x question x first line of the transcript.
OBSERVATIONS = 4 * 2 * 2 * 2
#: The canonical form of a turn.
CANONICAL = "<|{role}|>\n{text}\n<|end|>"


def read_line(line: str) -> tuple[int, str]:
    """Role index of a line's speaker marker (3: none) and the line without it."""
    m = _MARKER.match(line)
    if not m:
        return 3, line
    return _ROLE[next(g for g in m.groups() if g).lower()], line[m.end() :]


def observe(lines: list[str], blank_before: bool = False, first: bool = False) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Of each line that isn't blank: observation, place in ``lines``, its marker's role (3: none) and end."""
    seen, places, marks, ends = [], [], [], []
    for i, line in enumerate(lines):
        if not line.strip():
            blank_before = True
            continue
        role, rest = read_line(line)
        seen.append(((role * 2 + (blank_before or first)) * 2 + line.rstrip().endswith("?")) * 2 + first)
        places.append(i)
        marks.append(role)
        ends.append(len(line) - len(rest))
        blank_before = first = False
    return np.array(seen, np.int64), places, marks, ends


def entered(seen: np.ndarray, blank: bool, first: bool) -> np.ndarray:
    """``seen`` of lines observed without what stands before them, now with it."""
    seen = seen.copy()
    seen[:1] |= (4 if blank or first else 0) | int(first)
    return seen


def last_blank(text: Column) -> Column:
    """Whether a piece's last line is blank."""
    return F.coalesce(text, F.lit("")).rlike(r"(^|\n)\s*\z")


class Model:
    """Log probabilities of the start, of each state after each state, and of each observation."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, pseudo: float = 0.5) -> Model:
        allowed = np.array([[begin or STATES[i][0] == role for role, begin in STATES] for i in range(N)])
        begins = np.array([begin for _, begin in STATES])
        with np.errstate(divide="ignore"):
            s = np.log(np.where(begins, start + pseudo, 0) / (start + pseudo)[begins].sum())
            m = np.where(allowed, move + pseudo, 0.0)
            e = emit + pseudo / 10
            return cls(s, np.log(m / m.sum(axis=1, keepdims=True)), np.log(e / e.sum(axis=1, keepdims=True)))

    def block(self, seen: np.ndarray) -> np.ndarray:
        """Best score from the state before the block to the state of its last line."""
        best = np.where(np.eye(N, dtype=bool), 0.0, -np.inf)
        for o in seen:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + self.emit[:, o]
        return best

    def trace(self, seen: np.ndarray, enter: int, leave: int) -> list[int]:
        """States of a block's lines, given the state before it (-1: none) and that of its last line (-1: the best)."""
        back = np.zeros((len(seen), N), np.int64)
        if enter < 0:
            best = self.start + self.emit[:, seen[0]]
        else:
            best = self.move[enter] + self.emit[:, seen[0]]
        for t in range(1, len(seen)):
            step = best[:, None] + self.move
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + self.emit[:, seen[t]]
        states = [int(best.argmax()) if leave < 0 else leave]
        for t in range(len(seen) - 1, 0, -1):
            states.append(int(back[t, states[-1]]))
        return states[::-1]


def labelled_states(rows: DataFrame) -> DataFrame:
    """conv_id, part, states and observations of labelled rows (conv_id, part, text, role, first, before, blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {}
            for text, role, first, before, blank in zip(*(batch.column(c).to_pylist() for c in ("text", "role", "first", "before", "blank")), strict=True):
                if role not in ROLES:
                    continue
                seen, *_ = observe((text or "").split("\n"), bool(blank), first)
                r = 2 * ROLES.index(role)
                states = [r] + [r + 1] * (len(seen) - 1)
                for i, (o, s) in enumerate(zip(seen.tolist(), states, strict=False)):
                    if i or first or blank is not None:
                        counts["emit", s, o] = counts.get(("emit", s, o), 0) + 1
                    if i:
                        counts["move", states[i - 1], s] = counts.get(("move", states[i - 1], s), 0) + 1
                if len(seen):
                    # the row before ended in its role's first or later line; both learn the step to this turn
                    if first:
                        counts["start", r, 0] = counts.get(("start", r, 0), 0) + 1
                    elif before in ROLES:
                        b = 2 * ROLES.index(before)
                        for s in (b, b + 1):
                            counts["move", s, r] = counts.get(("move", s, r), 0) + 0.5
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([float(counts[k]) for k in keys], pa.float64())], names=["kind", "a", "b", "n"])

    return rows.select("text", "role", "first", "before", "blank").mapInArrow(run, "kind string, a int, b int, n double")


def train(rows: DataFrame) -> Model:
    """Count the model on labelled pieces (conv_id, part, text, role): a fixed number of sums comes to the driver."""
    order = Window.partitionBy("conv_id", F.floor(F.col("part") / BLOCK)).orderBy("part")
    marked = rows.withColumn("before", F.lag("role").over(order)).withColumn("blank", F.lag(last_blank(F.col("text"))).over(order)).withColumn("first", F.col("part") == 0)
    found = labelled_states(marked).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    tables = {"start": np.zeros((N, 1)), "move": np.zeros((N, N)), "emit": np.zeros((N, OBSERVATIONS))}
    for r in found:
        tables[r["kind"]][r["a"], r["b"]] += r["n"]
    return Model.from_counts(tables["start"][:, 0], tables["move"], tables["emit"])


def parse(pieces: DataFrame, model: Model) -> DataFrame:
    """conv_id, block, own, begins, part, role, text: the lines of one turn in one block of a transcript.

    ``pieces`` has conv_id, part (0, 1, ...) and text: a transcript's lines in order, cut
    between lines into pieces of any size.  Where it is cut makes no difference.  ``own``
    counts the block's beginnings (0: lines of the turn that the block before left open),
    ``begins`` is the number of all of them, ``part`` has the first line, and role is null
    where all lines are blank.  A beginning's marker is taken off if it names the role.
    """
    spark = pieces.sparkSession
    known = spark.sparkContext.broadcast(model)  # a few hundred numbers
    blocks = pieces.select("conv_id", "part", "text").withColumn("block", F.floor(F.col("part") / BLOCK).cast("long"))

    def lines_of(table: pa.Table) -> tuple[list[str], list[int]]:
        table = table.sort_by([("part", "ascending"), ("text", "ascending")])
        lines, part = [], []
        for p, text in zip(table.column("part").to_pylist(), table.column("text").to_pylist(), strict=True):
            own = (text or "").split("\n")
            lines += own
            part += [p] * len(own)
        return lines, part

    def reduce(table: pa.Table) -> pa.Table:
        # what stands before the block isn't known: scores as the transcript's first, after a blank line, and after another
        lines, _ = lines_of(table)
        seen, *_ = observe(lines)
        m, best = known.value, []
        if len(seen):
            rest = m.block(seen[1:])
            after = lambda scores: (scores[:, :, None] + rest[None]).max(axis=1).ravel().tolist()
            best = after((m.start + m.emit[:, entered(seen, True, True)[0]])[None])
            for blank in (True, False):
                best += after(m.move + m.emit[:, entered(seen, blank, False)[0]])
        return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "block": table.column("block").slice(0, 1), "best": pa.array([best], pa.list_(pa.float64())), "open": pa.array([not lines[-1].strip()])})

    def borders(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        score, back, blank, blanks = None, [], False, []
        for best, last in zip(table.column("best").to_pylist(), table.column("open").to_pylist(), strict=True):
            blanks.append(blank)
            if not best:
                back.append(None)
            elif score is None:
                score = np.array(best[:N])
                back.append(np.full(N, -1))
            else:
                step = score[:, None] + np.array(best[N:]).reshape(2, N, N)[0 if blank else 1]
                back.append(step.argmax(axis=0))
                score = step.max(axis=0)
            blank = last
        enter, leave = [-1] * len(back), [-1] * len(back)
        state = int(score.argmax()) if score is not None else -1
        for i in range(len(back) - 1, -1, -1):
            leave[i] = state
            if back[i] is not None:
                state = int(back[i][state])
            enter[i] = state
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "enter": pa.array(enter, pa.int32()), "leave": pa.array(leave, pa.int32()), "blank": pa.array(blanks, pa.bool_())})

    key = pieces.schema["conv_id"].dataType.simpleString()
    reduced = blocks.groupBy("conv_id", "block").applyInArrow(reduce, f"conv_id {key}, block long, best array<double>, open boolean")
    joints = reduced.groupBy("conv_id").applyInArrow(borders, f"conv_id {key}, block long, enter int, leave int, blank boolean")

    def trace(own: pa.Table, ends: pa.Table) -> pa.Table:
        lines, part = lines_of(own)
        seen, places, marks, cuts = observe(lines)
        enter, leave, blank = (ends.column(c)[0].as_py() for c in ("enter", "leave", "blank"))
        states = known.value.trace(entered(seen, blank, enter < 0), enter, leave) if len(seen) else []
        heads, roles = [0], [None]
        for place, mark, cut, s in zip(places, marks, cuts, states, strict=True):
            role, begin = STATES[s]
            if begin:
                heads.append(place)
                roles.append(role)
                if mark < 3 and ROLES[mark] == role:
                    lines[place] = lines[place][cut:]
            roles[-1] = role
        texts = ["\n".join(lines[a:b]) for a, b in zip(heads, [*heads[1:], len(lines)], strict=True)]
        rows = range(0 if len(heads) == 1 or heads[1] else 1, len(heads))
        key_type = own.schema.field("conv_id").type
        return pa.table({"conv_id": pa.array([own.column("conv_id")[0].as_py()] * len(rows), key_type), "block": pa.array([own.column("block")[0].as_py()] * len(rows), pa.int64()), "own": pa.array(rows, pa.int64()), "begins": pa.array([len(heads) - 1] * len(rows), pa.int64()), "part": pa.array([part[heads[i]] for i in rows], pa.int64()), "role": pa.array([roles[i] for i in rows], pa.string()), "text": pa.array([texts[i] for i in rows], pa.string())})

    return blocks.groupBy("conv_id", "block").cogroup(joints.groupBy("conv_id", "block")).applyInArrow(trace, f"conv_id {key}, block long, own long, begins long, part long, role string, text string")


def render(parsed: DataFrame) -> DataFrame:
    """conv_id, part, turn, role, canonical: one row for each turn of a conversation, from rows of ``parse``.

    ``turn`` counts the beginnings in the conversation from 1, by prefix sums over its
    blocks; ``part`` is the piece in which the turn begins.
    """
    parsed = materialize(parsed, "turns")
    order = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parsed.groupBy(F.col("conv_id").alias("_c"), F.col("block").alias("_b")).agg(F.max("begins").alias("n")).select("_c", "_b", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    turns = parsed.join(ahead, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b"))).withColumn("turn", (F.col("ahead") + F.col("own")).cast("int")).where("turn > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    whole = turns.groupBy("conv_id", "turn").agg(F.min_by("part", "block").alias("part"), F.max("role").alias("role"), text.alias("text"))
    return whole.select("conv_id", "part", "turn", "role", canonical(F.col("role"), F.col("text")).alias("canonical"))


def canonical(role: Column, text: Column) -> Column:
    return F.format_string(CANONICAL.format(role="%s", text="%s"), role, F.regexp_replace(text, r"^\s+|\s+$", ""))


#: How a turn's speaker may be written in a raw transcript, by style; %s is the turn's text.
STYLES = {
    "system": ("System: %s", "### Instruction:\n%s", "[system] %s", "<|system|>\n%s", "**System:** %s"),
    "user": ("User: %s", "### Question:\n%s", "[human] %s", "<|user|>\n%s", "**Q:** %s"),
    "assistant": ("Assistant: %s", "### Answer:\n%s", "[bot] %s", "<|assistant|>\n%s", "**A:** %s"),
}


def raw_transcripts(conversations: DataFrame, unmarked: int = 8) -> DataFrame:
    """(conv_id, part, text, role): a raw transcript, stored in pieces.

    The style goes by conv_id; one turn in ``unmarked`` has lost its marker.  Blank lines
    stand between the turns of two conversations in three; ``parse`` sees only lines, not
    that a piece here is a turn.
    """
    style = F.pmod(F.xxhash64(F.coalesce("conv_id", F.lit(-1))), F.lit(5)).cast("int") + 1
    spelling = F.lit("%s")
    for role, styles in STYLES.items():
        spelling = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, styles)), style)).otherwise(spelling)
    lost = F.pmod(F.xxhash64("conv_id", "turn", F.lit(7)), F.lit(unmarked)) == 0
    text = F.coalesce("text", F.lit(""))
    gap = F.when(F.pmod(F.xxhash64(F.coalesce("conv_id", F.lit(-1)), F.lit(11)), F.lit(3)) == 0, "").otherwise("\n")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("part"), F.concat(F.when(lost, text).otherwise(F.replace(spelling, F.lit("%s"), text)), gap).alias("text"), "role")


def format_conversations(conversations: DataFrame, folds: int = 5) -> DataFrame:
    """conv_id, part, turn, role, canonical of every conversation's raw transcript.

    The model learns from the conversations whose hash modulo ``folds`` is not 0; all are parsed.
    """
    raw = raw_transcripts(conversations)
    model = train(raw.where(F.pmod(F.xxhash64(F.coalesce("conv_id", F.lit(-1))), F.lit(folds)) != 0))
    return render(parse(raw.drop("role"), model))
