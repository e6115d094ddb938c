"""Turns are rebuilt from lines alone: whatever the pieces, with all of their text."""

import numpy as np
import pytest

from prospecta.llm import chat_format

TRANSCRIPT = """
User: what is this?
Answer: 42
[context] of it

Input: x

    code

Assistant: it says
Q: why
not

System: done
User: and now?
"""
TURNS = [
    (1, "user", "what is this?\nAnswer: 42\n[context] of it\n\nInput: x\n\n    code"),
    (2, "assistant", "it says\nQ: why\nnot"),
    (3, "system", "done\nUser: and now?"),
]


def model():
    """Turns begin with their role's marker, after a blank line; any other line goes on, 'Input' too."""
    start, move, emit = np.ones(6), np.ones((6, 6)), np.full((6, chat_format.OBSERVATIONS), 1e-6)
    see = lambda role, blank, ask, first: ((role * 2 + blank) * 2 + ask) * 2 + first
    for i, role in enumerate(chat_format.ROLES):
        for ask in (0, 1):
            for first in (0, 1):
                emit[2 * i, see(i, 1, ask, first)] = 100
            for mark in range(4):
                emit[2 * i + 1, see(mark, 0, ask, 0)] = 100
            emit[2 * i + 1, see(3, 1, ask, 0)] = 100
    emit[3, see(1, 1, 0, 0)] = 1000  # "Input: x" after a blank line goes on
    return chat_format.Model.from_counts(start, move, emit, 1e-6)


@pytest.mark.parametrize("block", [1, 2, 256])
@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_cuts_make_no_difference(spark, monkeypatch, block, size):
    monkeypatch.setattr(chat_format, "BLOCK", block)
    lines = TRANSCRIPT.split("\n")
    pieces = ["\n".join(lines[i : i + size]) for i in range(0, len(lines), size)]
    frame = spark.createDataFrame([(c, p, t) for c in (1, None) for p, t in enumerate(pieces)], "conv_id long, part long, text string")
    rows = chat_format.render(chat_format.parse(frame, model())).collect()
    for c in (1, None):
        assert sorted((r.turn, r.role, r.canonical) for r in rows if r.conv_id == c) == [(n, role, f"<|{role}|>\n{text}\n<|end|>") for n, role, text in TURNS]
