"""Quality classifier from weak labels.

Ten heuristic labellers vote good (1), bad (0) or abstain on every document; each kind of
bad text falls to two or more of them.  How often each one calls good and bad texts bad is
estimated by expectation-maximisation over the counts of vote patterns (3**10 of them at
most, whatever the corpus); that gives each document a posterior.  So that the hidden class
is quality, no labeller is taken to accuse more than one good text in a hundred.
Posterior labels then train a hashed linear scorer over byte trigrams and binned text
statistics, which decides: a document stays if its score is at least ``threshold``.

The votes, pattern counts and scores cover all documents and whole texts.  The scorer is
fitted on a bounded sample of labelled rows: SAMPLE documents, or all if there are fewer,
those with the smallest hash of doc_id and text.  Rows beyond the bound stop at the tasks
that read them, also where many have no id or one text.

Cases: null text counts as empty.  Texts of few words get abstentions, so the prior
decides, and they stay unless their trigrams speak against it.  Repeated rows get equal
scores.  Without any document nothing is fitted and nothing returned.  ``classify`` adds
quality_score, weak_label and keep to doc_id; ``keep_good`` returns the rows of the input
that stay, all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, binary_parts, byte_units, mix, slices, word_units
from .common import distinct as distinct_values

#: Documents that the scorer is fitted on, at most.
SAMPLE = 3000
BUCKETS = 1 << 15
#: Parts of a weight when texts are scored.
FIXED = 2.0**30
GRAM = 3
THRESHOLD = 0.5
#: Rates of bad votes on good and on bad texts that the estimation begins with; the first one is its bound, too.
START = (0.01, 0.3)
LABELLERS = ("exclamation", "capitals", "symbols", "bars", "loose_marks", "endings", "variety", "repetition", "runs", "prose")


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHA = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER = _ALPHA | (np.arange(256) >= 128)
_DIGIT = _flags("0123456789")
_SOLID = ~_flags(" \t\n\r\x0b\x0c")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: words, then the ratio that each labeller judges by."""
    offsets = offsets - offsets[0]
    values, at, first, last = word_units(raw, offsets)
    words = np.diff(at)
    n = np.maximum(words, 1)

    def per_text(flags: np.ndarray, where: np.ndarray = offsets) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[where])

    solid = np.maximum(per_text(_SOLID[raw]), 1)
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[1:] == values[:-1]
    same[at] = False  # not across texts
    distinct = np.array([len(distinct_values(values[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    odd = ~(_LETTER | _DIGIT)[raw]
    marked = odd[np.maximum(last - 1, 0)] & odd[np.maximum(last - 2, 0)] & (last - first > 2)
    return np.stack([
        words,
        per_text(raw == ord("!")) / n,
        per_text(_UPPER[raw]) / np.maximum(per_text(_ALPHA[raw]), 1),
        per_text(_flags("*#$%&@~^<>=")[raw]) / n,
        per_text(raw == ord("|")) / n,
        per_text((last - first == 1) & odd[first], at) / n,
        per_text(marked, at) / n,
        distinct / n,
        per_text(same[:-1], at) / n,
        per_text(same[:-1] | same[1:], at) / n,
        per_text(_LETTER[raw]) / solid,
        per_text(_flags(".?!")[raw]) / n,
    ], axis=1)


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes of LABELLERS on each text: 1 good, 0 bad, -1 abstains.

    Each one judges by one ratio (the last one by two): bad beyond one bound, good within another,
    no vote in between, on texts under five words, or for good under ten words.
    """
    words, bang, caps, symbols, bars, loose, endings, variety, again, runs, letters, stops = stats.T
    rules = [
        (bang > 0.3, bang < 0.1),
        (caps > 0.4, caps < 0.3),
        (symbols > 0.25, symbols < 0.05),
        (bars > 0.1, bars < 0.02),
        (loose > 0.1, loose < 0.05),
        (endings > 0.2, endings < 0.1),
        (variety < 0.45, variety > 0.5),
        (again > 0.2, again < 0.1),
        (runs > 0.35, runs < 0.2),
        (letters < 0.6, (letters > 0.8) & (stops < 0.5)),
    ]
    return np.stack([np.where((words >= 5) & bad, 0, np.where((words >= 10) & good, 1, -1)) for bad, good in rules], axis=1)


def pack(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def unpack(patterns: np.ndarray, size: int = len(LABELLERS)) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(size) % 3 - 1


def error_rates(patterns: np.ndarray, counts: np.ndarray, start: tuple[float, float] = (0.1, 0.9), most_false: float = 1.0, rounds: int = 200, weight: float = 10.0) -> tuple[float, np.ndarray, np.ndarray]:
    """By expectation-maximisation: prior of good, each labeller's rates of bad votes, and each pattern's posterior of good.

    Rates are by labeller, on bad texts (row 0) and on good ones (row 1), where it votes.
    ``start`` has the rates on good and on bad texts that the search begins with, and that
    ``weight`` votes of belief hold; no labeller accuses more than ``most_false`` of the good texts.
    """
    v = unpack(patterns)
    bad, good = (v == 0).astype(float), (v == 1).astype(float)
    belief = np.array(start)[::-1, None]
    prior, rates = 0.8, np.repeat(belief, v.shape[1], axis=1)
    post = np.full(len(v), -1.0)
    for _ in range(rounds):
        new = posterior(bad, good, prior, rates)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        prior = float(np.clip((counts @ new + 8) / (counts.sum() + 10), 0.02, 0.98))
        share = np.stack([counts * (1 - new), counts * new])
        rates = (share @ bad + weight * belief) / (share @ (bad + good) + weight)
        rates[1] = np.minimum(rates[1], most_false)
    return prior, rates, post


def posterior(bad: np.ndarray, good: np.ndarray, prior: float, rates: np.ndarray) -> np.ndarray:
    """Of vote patterns (flags of bad and good votes by labeller): the probability of good."""
    odds = bad @ np.log(rates).T + good @ np.log1p(-rates).T + np.log([1 - prior, prior])
    return 1 / (1 + np.exp(np.clip(odds[:, 0] - odds[:, 1], -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, **options) -> tuple[float, np.ndarray, np.ndarray]:
    """As error_rates, with each labeller's accuracy where it votes in place of its two rates."""
    prior, rates, post = error_rates(patterns, counts, **options)
    return prior, prior * (1 - rates[1]) + (1 - prior) * rates[0], post


def _bins(stats: np.ndarray) -> np.ndarray:
    """Buckets of the binned statistics: one for each text and statistic."""
    edges = np.array([0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9])
    level = np.searchsorted(edges, stats[:, 1:])
    level = np.where(stats[:, :1] < 5, 15, level)  # too few words to tell
    key = (np.arange(1, stats.shape[1]) * 16 + level).astype(U64) + U64(1 << 40)
    return (mix(key.copy()) >> U64(49)).astype(np.int64)


def buckets(raw: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets, how many each text has, and the statistics' buckets."""
    values, at, _, _ = byte_units(raw, offsets)
    grams = (Rolling(values).grams(GRAM) >> U64(49)).astype(np.int64)
    size = np.maximum(np.diff(at) - GRAM + 1, 0)
    index = np.repeat(at[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return grams[index], size, _bins(stats)


def fit(raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rounds: int = 80, rate: float = 0.5) -> np.ndarray:
    """Weights by bucket, the bias last: logistic regression on soft labels, by adaptive gradient steps."""
    weights = np.zeros(BUCKETS + 1)
    if not len(labels):
        return weights
    texts, cols, vals = [], [], []
    for i, j in slices(offsets):
        own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        grams, size, bins = buckets(*own, statistics(*own))
        which = np.repeat(np.arange(i, j), size)
        key, count = np.unique(which * BUCKETS + grams, return_counts=True)
        texts += [key // BUCKETS, np.repeat(np.arange(i, j), bins.shape[1])]
        cols += [key % BUCKETS, bins.ravel()]
        vals += [count / size[key // BUCKETS - i], np.ones(bins.size)]
    text, col, val = np.concatenate(texts), np.concatenate(cols), np.concatenate(vals)
    square = np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(text, weights=weights[col] * val, minlength=len(labels)) + weights[BUCKETS]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        slope = np.append(np.bincount(col, weights=error[text] * val, minlength=BUCKETS), error.sum()) + 1e-6 * weights
        square += slope**2
        weights -= rate * slope / np.sqrt(square)
    return weights


def scores(raw: np.ndarray, offsets: np.ndarray, stats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    grams, size, bins = buckets(raw, offsets, stats)
    # weights as whole numbers: a text's sum doesn't depend on what stands before it
    whole = np.round(weights * FIXED).astype(np.int64)
    sums = np.diff(np.concatenate([[0], np.cumsum(whole[grams])])[np.concatenate([[0], np.cumsum(size)])])
    z = sums / np.maximum(size, 1) / FIXED + weights[bins].sum(axis=1) + weights[BUCKETS]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def each_slice(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw, offsets = binary_parts(column)
    for i, j in slices(offsets):
        yield raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


class Model:
    """A fitted classifier: prior of good, the labellers' accuracies, posterior by pattern, the scorer's weights."""

    def __init__(self, prior: float, accuracy: np.ndarray, posterior: dict[int, float], weights: np.ndarray):
        self.prior, self.accuracy, self.posterior, self.weights = prior, accuracy, posterior, weights

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score and posterior weak label of each text."""
        found, weak = [np.zeros(0)], [np.zeros(0)]
        for raw, offsets in each_slice(column):
            stats = statistics(raw, offsets)
            found.append(scores(raw, offsets, stats, self.weights))
            weak.append(np.array([self.posterior.get(int(p), self.prior) for p in pack(votes(stats))]))
        return np.concatenate(found), np.concatenate(weak)


def sampled(source: DataFrame, total: int, sample: int = SAMPLE) -> DataFrame:
    """``sample`` rows of ``source(doc_id, text)`` with the smallest hash, in order: a top-k of each task, then of those."""
    place = F.pmod("_hash", F.lit(1 << 30))
    share = 1.0 if total <= sample else min(1.0, (1.2 * sample + 100) / total)
    rows = source.withColumn("_hash", F.xxhash64("doc_id", "text")).where(place <= int(share * (1 << 30)))
    return rows.orderBy(place, "_hash", "doc_id").limit(sample).select("doc_id", "text", place.alias("place"), F.col("_hash").alias("hash"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Estimate the labellers on all of ``docs(doc_id, text)`` and fit the scorer on the sample."""
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pack(votes(statistics(*own))) for own in each_slice(batch.column(0))]
            values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["pattern", "n"])

    rows = source.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3**10 at most
    codes = np.array([r["pattern"] for r in rows], np.int64)
    prior, accuracy, post = estimate(codes, np.array([r["n"] for r in rows], np.float64), start=START, most_false=START[0])
    known = dict(zip(codes.tolist(), post.tolist(), strict=True))
    total = sum(r["n"] for r in rows)
    chosen = sampled(source, total, sample)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("hash", "ascending"), ("doc_id", "ascending")])
        raw, offsets = binary_parts(table.column("text"))
        labels = np.concatenate([np.zeros(0), *(np.array([known.get(int(p), prior) for p in pack(votes(statistics(*own)))]) for own in each_slice(table.column("text").combine_chunks()))])
        return pa.table({"weights": pa.array([fit(raw, offsets, labels).tobytes()], pa.binary())})

    fitted = chosen.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "weights binary").collect()
    weights = np.frombuffer(fitted[0]["weights"]) if fitted else np.zeros(BUCKETS + 1)
    return Model(prior, accuracy, known, weights)


def classify(docs: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """doc_id, quality_score, weak_label, keep for each document."""
    known = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # weights and patterns: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, weak = known.value.judge(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(weak), pa.array(score >= threshold)], names=["doc_id", "quality_score", "weak_label", "keep"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, quality_score double, weak_label double, keep boolean")


def keep_good(docs: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    known = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = known.value.judge(batch.column(at).cast(pa.binary()))
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
