"""Brute-force versions and odd inputs for the training-data operators."""

import random
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    """Nulls, empties, white space, very long, ties and repeated texts."""
    rng = random.Random(5)
    words = ["ab", "cd", "ef", "gh", "é", "ñandú", "x,", "THE", "the"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(90)
    long = prose(30_000)
    return [
        None, "", " \t\n", "one", "One  two\tthree", "one two three", prose(60), passage + " tail of one", "head of two " + passage, passage.replace(" ", "\n"),
        "same same " * 200, "same same " * 200, long, long[:-3] + "end", prose(40) + " ▁ mark 😀  double", "a" * 3000, "a" * 3000, "b\x00c", passage, passage,
    ]


def frame(spark, texts, sources=("s0", "s1", None)):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def covered(units, width):
    """Masks of the units that a repeated window covers."""
    seen = Counter(tuple(u[i : i + width]) for u in units for i in range(len(u) - width + 1))
    masks = []
    for u in units:
        mask = bytearray(len(u))
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                mask[i : i + width] = b"\1" * width
        masks.append(mask)
    return masks
