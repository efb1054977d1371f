"""Text quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its features are shares measured on the line itself (symbols, bars, capitals,
exclamations, digits, repeated words, ...) and on the lines before and after it. Two hidden labels, a weight per
feature and four transitions make the chain; forward-backward gives each line's probability of good, and the
length-weighted mean over the lines is the document's raw quality, which a two-number logistic step turns into a
probability.

Training labels are whole documents, so all lines of one carry its label. The chain is fitted on a bounded sample:
at most ``TRAIN_DOCS`` labelled documents of either label (least hashes of doc_id, held-out remainders left out),
whole texts, weighted back to the labels' true shares; a document's lines weigh as much together as any other's. Scoring uses every line of every text.
Labels, language, source and doc_id are never inputs of a score.

Defined cases: null, empty and blank texts have no lines and get the share of label 1 among the training labels;
without usable labels of both kinds that share (or 0.5 where there is none) is every score; repeated rows score
alike; an empty table gives an empty result; other columns are ignored by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.tables import stage
from tidewatch.llm.words import Words, text_blocks

TRAIN_DOCS = 2000
STEPS = 150
RATE = 0.1
DECAY = 1e-4
HOLD = (4, 2)
CUT = 0.7


def _table(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[np.frombuffer(chars, dtype=np.uint8)] = True
    return flags


SYMBOL, BAR, SHOUT, DIGIT = _table(b"#*$%&<>@^~=_{}[]\\"), _table(b"|"), _table(b"!"), _table(b"0123456789")
UPPER, LOWER_CASE = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
STOP = _table(b".?!:;\"')")
OWN = 15
FEATURES = 1 + OWN * 3 + 2


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, characters, features) of every line with a word, in order."""
    words = Words(data, bounds)
    begins = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
    line_of = np.searchsorted(begins, words.starts, side="right") - 1
    used, line = np.unique(line_of, return_inverse=True)
    n = len(used)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, FEATURES))
    row = np.zeros(n, dtype=np.int64)
    row[line] = words.row

    def upto(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags)])

    def in_words(flags: np.ndarray) -> np.ndarray:
        sums = upto(flags)
        return sums[words.ends] - sums[words.starts]

    def share(per_word: np.ndarray, over: np.ndarray) -> np.ndarray:
        return np.bincount(line, weights=per_word, minlength=n) / np.maximum(over, 1)

    count = np.bincount(line, minlength=n)
    chars = in_words((data & 0xC0) != 0x80)
    size = np.bincount(line, weights=chars, minlength=n)
    upper, lower = in_words(UPPER[data]), in_words(LOWER_CASE[data])
    letters = np.bincount(line, weights=upper + lower, minlength=n)
    order = np.lexsort((words.hashes, line))
    again = np.zeros(len(words), dtype=bool)
    again[order[1:]] = (words.hashes[order][1:] == words.hashes[order][:-1]) & (line[order][1:] == line[order][:-1])
    follows = np.zeros(len(words), dtype=bool)
    follows[1:] = (words.hashes[1:] == words.hashes[:-1]) & (line[1:] == line[:-1])
    last = np.zeros(n, dtype=np.int64)
    last[line] = np.arange(len(words))
    first = np.searchsorted(line, np.arange(n))
    own = np.stack([
        share(in_words(SYMBOL[data]) > 0, count), share(in_words(BAR[data]) > 0, count), share(in_words(SHOUT[data]) > 0, count),
        share(upper, letters), share((upper > 0) & (lower == 0), count), share(in_words(DIGIT[data]), size),
        share(again, count), share(follows, count), share(again, count) * np.log1p(count) / 5, np.log1p(count) / 5, size / np.maximum(count, 1) / 10,
        STOP[data[words.ends[last] - 1]], UPPER[data[words.starts[first]]] | (data[words.starts[first]] >= 0xC3), count == 1,
        share(in_words(SYMBOL[data]), size)], axis=1)
    own = np.clip(own, 0, 3)
    apart = row[1:] != row[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~apart] = own[:-1][~apart]
    after[:-1][~apart] = own[1:][~apart]
    edge_first, edge_last = np.ones((n, 1)), np.ones((n, 1))
    edge_first[1:, 0], edge_last[:-1, 0] = apart, apart
    return row, size, np.concatenate([np.ones((n, 1)), own, before, after, edge_first, edge_last], axis=1)


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, lines) of every run of equal rows, the longest first."""
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.append(heads, len(row)))
    order = np.argsort(-lengths, kind="stable")
    return heads[order], lengths[order]


def marginals(emit: np.ndarray, move: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of many chains at once: P(label) per line, expected moves per chain, log partition per chain.

    ``emit`` is lines x 2 and ``move`` 2 x 2, both logarithms; chains come longest first, so those still running are a prefix.
    """
    lines, steps = len(emit), int(lengths[0]) if len(lengths) else 0
    alpha, beta = np.zeros((lines, 2)), np.zeros((lines, 2))
    running = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]
    alpha[heads] = emit[heads]
    for t in range(1, steps):
        at = heads[: running[t]] + t
        alpha[at] = np.logaddexp(alpha[at - 1][:, :1] + move[0], alpha[at - 1][:, 1:] + move[1]) + emit[at]
    for t in range(steps - 1, 0, -1):
        at = heads[: running[t]] + t
        ahead = beta[at] + emit[at]
        beta[at - 1] = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
    ends = heads + lengths - 1
    total = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    of_line = np.zeros(lines)
    starts = np.zeros(lines, dtype=np.int64)
    order = np.argsort(heads)
    of_line[:] = np.repeat(total[order], lengths[order])
    starts[:] = np.repeat(heads[order], lengths[order])
    label = np.exp(alpha + beta - of_line[:, None])
    inner = np.flatnonzero(np.arange(lines) != starts)
    moves = np.exp(alpha[inner - 1][:, :, None] + move + (emit[inner] + beta[inner])[:, None, :] - of_line[inner][:, None, None])
    return label, moves, total


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # score of good over bad, per feature
    move: np.ndarray
    slope: float
    shift: float
    base: float

    def raw(self, features: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        emit = np.stack([np.zeros(len(features)), features @ self.weights], axis=1)
        return marginals(emit, self.move, heads, lengths)[0][:, 1]


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log1p(-p)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def weighted_mean(good: np.ndarray, size: np.ndarray, heads: np.ndarray) -> np.ndarray:
    order = np.argsort(heads)
    out = np.empty(len(heads))
    out[order] = np.add.reduceat(good * size, heads[order]) / np.add.reduceat(size, heads[order])
    return out


def fit(row: np.ndarray, size: np.ndarray, features: np.ndarray, labels: np.ndarray, share: float) -> Model:
    """Gradient ascent (Adam) on the conditional likelihood; ``labels`` by row, ``share`` the true share of label 1."""
    heads, lengths = chains(row)
    truth = labels[row[heads]]
    sampled = max(1e-9, truth.mean())
    weight = np.where(truth == 1, share / sampled, (1 - share) / max(1e-9, 1 - sampled))
    order = np.argsort(heads)
    # A line's weight falls with the length of its chain: documents count alike, however long.
    line_weight = np.repeat((weight / lengths)[order], lengths[order])
    line_truth = labels[row]
    starts = np.repeat(heads[order], lengths[order])
    inner = np.flatnonzero(np.arange(len(row)) != starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_truth[inner], line_truth[inner]), line_weight[inner])
    theta = np.zeros(FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        move = theta[FEATURES:].reshape(2, 2)
        emit = np.stack([np.zeros(len(features)), features @ theta[:FEATURES]], axis=1)
        label, moves, _ = marginals(emit, move, heads, lengths)
        slope = features.T @ (line_weight * (line_truth - label[:, 1]))
        change = seen - (moves * line_weight[inner][:, None, None]).sum(axis=0)
        gradient = np.concatenate([slope, change.reshape(-1)]) / len(heads) - DECAY * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        theta += RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    model = Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2), 1.0, 0.0, share)
    x = logit(weighted_mean(model.raw(features, heads, lengths), size, heads))
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Newton steps of a two-number logistic regression
        p = sigmoid(slope * x + shift)
        curve = weight * p * (1 - p)
        gap = weight * (truth - p)
        hessian = np.array([[np.sum(curve * x * x), np.sum(curve * x)], [np.sum(curve * x), np.sum(curve)]]) + 1e-3 * np.eye(2)
        slope, shift = np.array([slope, shift]) + np.linalg.solve(hessian, [np.sum(gap * x) - 1e-3 * slope, np.sum(gap)])
    return Model(model.weights, model.move, float(slope), float(shift), share)


def held_out(doc_id: Column) -> Column:
    every, rest = HOLD
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == rest, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    flat = Model(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, float(logit(np.array(share))), share)
    if len(counts) < 2:
        return flat
    # The sample is chosen among the labels alone: a table of at most 2 * TRAIN_DOCS ids then meets the texts, which stay where they are.
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for q in (0, 1)]
    sample = stage(chosen[0].unionByName(chosen[1]), "labelled-sample")
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(sample, "doc_id").select("doc_id", "text", "quality")
    schema = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.FloatType())), T.StructField("features", T.ArrayType(T.FloatType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_blocks(batch):
                row, size, features = line_features(data, bounds)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([size[o].astype(np.float32) for o in own], pa.list_(pa.float32())),
                                                  pa.array([features[o].astype(np.float32).reshape(-1) for o in own], pa.list_(pa.float32()))], names=[f.name for f in schema])

    rows = texts.mapInArrow(measure, schema).toArrow()  # at most 2 * TRAIN_DOCS rows
    lengths = rows["sizes"].combine_chunks().value_lengths().to_numpy() if rows.num_rows else np.zeros(0, dtype=np.int64)
    truth = rows["quality"].to_numpy() if rows.num_rows else np.zeros(0, dtype=np.int64)
    if len({*truth[lengths > 0].tolist()}) < 2:
        return flat
    size = rows["sizes"].combine_chunks().flatten().to_numpy().astype(float)
    features = rows["features"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, FEATURES)
    return fit(np.repeat(np.arange(len(lengths)), lengths), size, features, truth, share)


def scores(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns as __0, __1 and so on, and __score: the probability of label 1, from the whole text alone."""
    rows = docs.select(*[docs[c].alias(f"__{i}") for i, c in enumerate(keep)], docs["text"].cast("string").alias("__text"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("__score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_blocks(batch, "__text"):
                row, size, features = line_features(data, bounds)
                score = np.full(part.num_rows, model.base)
                if len(row):
                    heads, lengths = chains(row)
                    score[row[heads]] = sigmoid(model.slope * logit(weighted_mean(model.raw(features, heads, lengths), size, heads)) + model.shift)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = scores(docs, train(docs, labels)).select(F.col("__0").alias("doc_id"), F.col("__score").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the cut, with their columns, whatever these are called."""
    scored = scores(docs, train(docs, labels), docs.columns)
    return scored.where(F.col("__score") >= CUT).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
