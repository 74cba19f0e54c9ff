"""Quality classifier: a support vector machine over naive Bayes features.

A text is the set of its n-grams: three bytes in a row and two words in a row, each hashed to one of
FEATURES numbers, and marks for two, three, four and five equal words in a row.  Counts of every n-gram over all labelled
rows of either class give its log-count ratio.  The indicators scaled by these ratios, to unit length,
are the inputs of a linear hinge-loss model, fitted by dual coordinate descent on a bounded sample;
rows of the sample that it has not seen turn its margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import blocks_of, mix, stored, word_hashes, words_of

FEATURES = 1 << 18
# Labelled rows of each class that the hinge-loss model is fitted on, those of least hash of their id;
# the log-count ratios count all labelled rows.
SAMPLE_PER_CLASS = 2000
# Of these, every so many-th is kept for the probabilities.
CALIBRATION = 4
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 30
TOLERANCE = 0.01
# Text that is looked at at once.
STEP_BYTES = 2 << 20
# Fixed value: the odd number nearest to 2^32 over the golden ratio, for multiplicative hashing.
_SPREAD = np.uint32(2654435769)
_HALF = FEATURES // 2  # byte n-grams below, word n-grams from here on
_EQUAL_WORDS = 5  # longest row of equal words that has a mark of its own; marks come last
_MARKS = FEATURES - (_EQUAL_WORDS - 1)
_GRAM_SHIFT = np.uint32(32 - (_HALF.bit_length() - 1))


def text_features(raw: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct features of each text, ascending; a text of under three bytes and two words has
    none."""
    octets = raw.astype(np.uint32)
    grams = octets[:-2] << np.uint32(16) | octets[1:-1] << np.uint32(8) | octets[2:]
    grams = (grams * _SPREAD) >> _GRAM_SHIFT
    begins, ends, first = words_of(raw, starts)
    words = word_hashes(raw, begins, ends)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:]) % np.uint64(_MARKS - _HALF)
    pairs = pairs.astype(np.int64) + _HALF
    equal = words[:-1] == words[1:]
    there = np.zeros(FEATURES, bool)
    for i in range(len(starts) - 1):
        there[grams[starts[i] : max(starts[i + 1] - 2, starts[i])]] = True
        inside = slice(first[i], max(first[i + 1] - 1, first[i]))
        there[pairs[inside]] = True
        row = equal[inside]
        for mark in range(_MARKS, FEATURES):
            there[mark] = row.any()
            row = row[:-1] & equal[inside][len(equal[inside]) - len(row) + 1 :]
        found = np.flatnonzero(there)
        there[found] = False
        yield found


def fold(doc_id: Column, folds: int) -> Column:
    """Checksum of an id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def feature_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many `rows` (text, label) of label 1 and of label 0 hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), np.int64)
        for batch, raw, starts in blocks_of(batches, 0, STEP_BYTES):
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for label, found in zip(labels, text_features(raw, starts), strict=True):
                counts[label, found] += 1
        kept = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(kept), 1 << 14):
            part = kept[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])],
                ["feature", "good", "bad"],
            )

    found = (
        rows.select("text", "label").mapInArrow(run, "feature long, good long, bad long")
        .groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .toArrow()  # at most FEATURES rows
    )
    counts = np.zeros((2, FEATURES), np.int64)
    at = found["feature"].to_numpy()
    counts[1, at], counts[0, at] = found["good"].to_numpy(), found["bad"].to_numpy()
    return counts[1], counts[0]


def log_count_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Logarithm of a feature's share in label 1 over that in label 0; what is added to the counts is
    shared out like the counts of the classes, so a feature never seen speaks for neither."""
    every = (good.sum() + bad.sum()) / 2
    p, q = good + SMOOTHING * good.sum() / every, bad + SMOOTHING * bad.sum() / every
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _inputs(features: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[features]
    size = np.sqrt((values * values).sum())
    return values / size if size else values


def fit_hinge(
    rows: list[bytes], labels: np.ndarray, ratios: np.ndarray, cost: float = COST,
    epochs: int = EPOCHS, tolerance: float = TOLERANCE,
) -> np.ndarray:
    """Weights, that of a constant input last, of least length and hinge loss over `rows` (bit sets of
    features).  Each step solves the dual for one row's multiplier and moves the weights with it; it
    ends when no multiplier can move by more than `tolerance`."""
    weights = np.zeros(FEATURES + 1)
    signs = np.where(labels > 0, 1.0, -1.0)
    multipliers = np.zeros(len(rows))
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in draw.permutation(len(rows)):
            features = unpacked(rows[i])
            values = _inputs(features, ratios)
            margin = signs[i] * (weights[features] @ values + weights[-1])
            curve = values @ values + 1.0
            moved = min(max(multipliers[i] - (margin - 1.0) / curve, 0.0), cost)
            step = moved - multipliers[i]
            if step:
                weights[features] += step * signs[i] * values
                weights[-1] += step * signs[i]
                multipliers[i] = moved
                largest = max(largest, abs(step))
        if largest < tolerance:
            break
    return weights


def unpacked(row: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8)))


def fit_probability(
    margins: np.ndarray, labels: np.ndarray, importance: np.ndarray, rounds: int = 50
) -> tuple[float, float]:
    """Slope and offset of the logistic curve of label 1 over margins, by damped Newton steps; the
    targets are drawn in from 0 and 1 by the number of rows, so they stay finite on rows told apart
    without error."""
    ones, zeros = (labels > 0).sum(), (labels <= 0).sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    inputs = np.stack([margins, np.ones(len(margins))])
    at = np.zeros(2)

    def loss(at):
        z = at @ inputs
        return float((importance * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-(at @ inputs)))
        slope = inputs @ (importance * (chance - target))
        curve = (inputs * (importance * chance * (1 - chance))) @ inputs.T + 1e-9 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


@dataclass
class Model:
    """Log-count ratios, weights (the constant's last) and the curve from margins to probabilities."""

    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features] @ _inputs(features, self.ratios) + self.weights[-1])

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * margin + self.offset))))


def _fit_sample(sample: DataFrame, ratios: np.ndarray, good: int, bad: int) -> Model:
    """Fit on `sample` (text, label, place): one task gets it, as bit sets of fixed size."""
    shared = sample.sparkSession.sparkContext.broadcast(ratios)  # FEATURES numbers

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, starts in blocks_of(batches, 0, STEP_BYTES):
            sets = []
            for found in text_features(raw, starts):
                there = np.zeros(FEATURES, bool)
                there[found] = True
                sets.append(np.packbits(there).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.binary()), batch.column(1), batch.column(2)],
                ["features", "label", "place"],
            )

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        rows, labels = table["features"].to_pylist(), table["label"].to_numpy()
        place = table["place"].to_numpy()
        shown = np.flatnonzero(place % CALIBRATION != 0)
        rest = np.flatnonzero(place % CALIBRATION == 0)
        weights = fit_hinge([rows[i] for i in shown], labels[shown], shared.value)
        model = Model(shared.value, weights, 1.0, 0.0)
        margins = np.array([model.margin(unpacked(rows[i])) for i in rest])
        # the classes weigh as in the labelled rows, not as in the sample
        importance = np.where(labels[rest] > 0, good / max((labels[rest] > 0).sum(), 1),
                              bad / max((labels[rest] <= 0).sum(), 1))
        importance *= len(rest) / importance.sum()
        slope, offset = fit_probability(margins, labels[rest], importance)
        return pa.table({"weights": [weights.tobytes()], "slope": [slope], "offset": [offset]})

    packed = sample.select("text", "label", "place").mapInArrow(
        pack, "features binary, label int, place int"
    )
    found = packed.groupBy().applyInArrow(
        fit, "weights binary, slope double, offset double"
    ).first()
    return Model(ratios, np.frombuffer(found.weights), found.slope, found.offset)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", sample_per_class: int = SAMPLE_PER_CLASS,
) -> Model:
    """A model of `label` from the rows of `docs` for which `train` holds (null does not).

    Labels other than 0 and 1, and rows without id, teach nothing; an id with several labels counts
    as 1 if at least half of them are.  With fewer than CALIBRATION x 2 rows of a class in the sample
    the model gives every text the smoothed share of label 1.
    """
    told = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    )
    rows = docs.where(train).select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # narrow: the ids that teach, to count and to sample
    ids = stored(rows.select("doc_id").distinct().join(told, "doc_id"), "training-ids")
    sizes = {r.label: r["count"] for r in ids.groupBy("label").count().collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if min(good, bad, sample_per_class) < 2 * CALIBRATION:
        share = (good + 1) / (good + bad + 2)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES + 1), 0.0,
                     float(np.log(share / (1 - share))))
    ratios = log_count_ratios(*feature_counts(rows.join(ids, "doc_id")))
    order = F.xxhash64("doc_id")
    drawn = None
    for value in (0, 1):
        part = ids.where(F.col("label") == value).orderBy(order, "doc_id").limit(sample_per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = stored(drawn.withColumn("place", F.pmod(order, F.lit(1 << 20)).cast("int")), "sample-ids")
    # rows that repeat an id are one row of the sample, with the text that sorts first
    sample = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label", "place").agg(
        F.min("text").alias("text")
    )
    return _fit_sample(sample, ratios, good, bad)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score`, the probability of label 1 of every whole text, in place of any such
    column; a null text is empty and gets the model's constant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    docs = docs.drop("score")
    names = [*docs.columns, "score"]
    place = names.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, raw, starts in blocks_of(batches, place, STEP_BYTES):
            found = [known.probability(known.margin(f)) for f in text_features(raw, starts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names)

    return docs.mapInArrow(run, schema)
