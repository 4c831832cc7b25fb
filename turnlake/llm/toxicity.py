"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade <= j) = sigmoid(threshold_j - w . x): one weight vector w for all
ordered thresholds.  x marks which words, and which word beginnings, a text
has.  Grades: 0 not toxic, 1 toxic, 2 severely toxic.  The labels only say
toxic or not; a toxic text of the training sample is severe when it has more
occurrences of words typical of toxic texts than the median toxic text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.arrowtext import binary_slices, blocks
from turnlake.llm.common import only, prepare

#: The model is fitted on at most so many labelled texts of each class, taken
#: by the order of a hash of their ids, and has at most so many features.
SAMPLE_TOXIC, SAMPLE_CLEAN, FEATURES = 2_500, 5_000, 4_096

#: Bytes of a word beginning, and the fewest sample texts that a feature is in.
BEGINNING, LEAST_TEXTS = 5, 5

#: A text is rejected from this probability of grade 1 or 2 on.
REJECT = 0.5


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document, word code) of all words and the distinct words: runs of ASCII
    letters and non-ASCII bytes, A-Z lower-cased."""
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32))
    inside = ((data >= 97) & (data <= 122)) | (data >= 128)
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    lead = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[lead] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    after[lead[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    coded = binary_slices(data, starts, ends).dictionary_encode()
    return np.searchsorted(offsets, starts, side="right") - 1, coded.indices.to_numpy(), coded.dictionary.to_pylist()


def features_of(word: bytes) -> tuple[int, int]:
    """Hashes of a word and of its beginning (0: it has none of its own)."""
    beginning = xxhash.xxh3_64_intdigest(word[:BEGINNING], 2) >> 1 if len(word) > BEGINNING else 0
    return xxhash.xxh3_64_intdigest(word, 1) >> 1, beginning


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, logits: np.ndarray) -> np.ndarray:
        """Probability of each grade, a row a text."""
        upto = _sigmoid(self.thresholds[None, :] - logits[:, None])
        return np.diff(np.concatenate([np.zeros((len(logits), 1)), upto, np.ones((len(logits), 1))], 1), axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, levels: int, steps: int = 300, rate: float = 0.3, l2: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by Adam on the whole
    sample; thresholds are a first value plus positive gaps, so they stay in
    order.  ``rows``/``columns`` list the features that are present."""
    n = len(grades)
    share = np.array([(np.sum(grades <= j) + 0.5) / (n + 1) for j in range(levels - 1)])
    theta = np.log(share / (1 - share))
    free = np.concatenate([np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    moment, square = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        weights, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        theta = free[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        logit = np.bincount(rows, weights=weights[columns], minlength=n)
        high = np.where(grades < levels - 1, _sigmoid(theta[np.minimum(grades, levels - 2)] - logit), 1.0)
        low = np.where(grades > 0, _sigmoid(theta[np.maximum(grades - 1, 0)] - logit), 0.0)
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
        d_logit = (slope_high - slope_low) / n  # of the negative log likelihood
        d_theta = np.array([np.sum(slope_low[grades == j + 1]) - np.sum(slope_high[grades == j]) for j in range(levels - 1)]) / n
        d_gaps = np.cumsum(d_theta[::-1])[::-1][1:] * gaps
        gradient = np.concatenate([np.bincount(columns, weights=d_logit[rows], minlength=n_features) + l2 * weights, [d_theta.sum()], d_gaps])
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        free -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return free[:n_features], free[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(free[n_features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of the labelled texts (SAMPLE_TOXIC, SAMPLE_CLEAN).

    Labels that are null, or of ids without a text, take no part; with one
    class only, the model says what share of the sample is toxic.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    sample = known.filter("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks(batches):
            doc, code, words = words_of(data, offsets)
            own = np.array([features_of(w) for w in words], np.int64).reshape(-1, 2)
            flags = block.column(2).to_numpy()
            edge = np.searchsorted(doc, np.arange(len(offsets)))
            out = [np.unique(own[code[a:b]], return_counts=True) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch({"toxic": pa.array(flags, pa.int32()), "features": pa.array([f for f, _ in out], pa.list_(pa.int64())), "counts": pa.array([c.astype(np.int32) for _, c in out], pa.list_(pa.int32()))})

    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids: broadcasting them is bounded.
    chosen = only(docs, id_col, text_col).filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    found = chosen.mapInArrow(extract, "toxic int, features array<long>, counts array<int>").toArrow().combine_chunks()
    return _fit_sample(found)


def _fit_sample(found: pa.Table) -> Model:
    toxic = found.column("toxic").to_numpy().astype(np.int64)
    if not len(toxic):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.array([0.0, 40.0]) + 40)
    lists = found.column("features").combine_chunks()
    counts = found.column("counts").combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    names, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    with_it = [np.bincount(column[toxic[row] == t], minlength=len(names)) for t in (0, 1)]
    n = [max(int(np.sum(toxic == t)), 1) for t in (0, 1)]
    odds = np.log((with_it[1] + 0.5) / (n[1] + 1)) - np.log((with_it[0] + 0.5) / (n[0] + 1))
    enough = (with_it[0] + with_it[1] >= LEAST_TEXTS) & (names != 0)
    strength = np.where(enough, np.abs(odds) * np.sqrt(with_it[0] + with_it[1]), -1.0)
    pick = np.sort(np.argsort(-strength, kind="stable")[: min(FEATURES, int(enough.sum()))])
    typical = enough & (odds > 2.0)
    occurrences = np.bincount(row, weights=counts * typical[column], minlength=len(toxic))
    median = np.median(occurrences[toxic == 1]) if (toxic == 1).any() else 0.0
    grades = np.where(toxic == 1, 1 + (occurrences > median), 0).astype(np.int64)
    at = np.full(len(names), -1)
    at[pick] = np.arange(len(pick))
    used = at[column] >= 0
    weights, thresholds = fit_ordinal(row[used], at[column][used], grades, len(pick), 3)
    return Model(names[pick], weights, thresholds)


def _graded(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each grade of every document of a block."""
    doc, code, words = words_of(data, offsets)
    own = np.array([features_of(w) for w in words], np.int64).reshape(-1, 2)
    place = np.full(own.shape, -1)
    n = max(len(model.features), 1)
    if len(model.features):
        near = np.minimum(np.searchsorted(model.features, own), n - 1)
        place = np.where(model.features[near] == own, near, -1)
    key = [doc[hit] * n + place[code[hit], side] for side in (0, 1) for hit in [place[code, side] >= 0]]
    text, feature = np.divmod(np.unique(np.concatenate(key)), n)
    return model.grades(np.bincount(text, weights=model.weights[feature] if len(feature) else None, minlength=len(offsets) - 1))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, toxic) of every row.

    Null and empty texts have no features: the thresholds alone grade them.
    Repeated rows give repeated results.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks(batches):
            p = _graded(model, data, offsets)
            chance = 1 - p[:, 0]
            yield pa.record_batch({"doc_id": block.column(0), "expected_severity": pa.array(p @ np.arange(p.shape[1])), "p_toxic": pa.array(chance), "grade": pa.array(p.argmax(1).astype(np.int32)), "toxic": pa.array(chance >= REJECT)})

    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns and in any number, whose text isn't toxic;
    null and empty texts are graded by the thresholds alone."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks(batches, text_col):
            yield block.filter(pa.array(_graded(model, data, offsets)[:, 0] > 1 - REJECT))

    return docs.mapInArrow(run, docs.schema)
