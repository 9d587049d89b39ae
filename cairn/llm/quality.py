"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text (shares of character classes, lengths, repetition of words, word pairs and
lines) are scaled to unit variance. cos(W x + b) with Gaussian W approximates a Gaussian kernel
on them, so that ridge regression on these features is kernel ridge regression. Its normal
equations are sums over rows: each partition adds up its own for each of a few folds, and Spark
adds up the partitions row by row of the matrix. Raw scores are made probabilities by isotonic
regression over a histogram with a fixed number of bins; a row counts there with the score of the
model that is fitted without its fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import kernel as K
from cairn.llm.common import id_crc, scratch, small_batches, stored

STATISTICS = (
    "bytes", "upper", "digits", "spaces", "lines", "wide", "bars", "bangs", "signs", "stops", "other",
    "word_length", "word_spread", "long_words", "distinct_words", "echoed_words", "distinct_pairs", "distinct_lines", "line_words", "capital_words",
)
#: Random features, kernel width (in standard deviations, for each statistic), ridge in rows, bins of raw scores, folds.
FEATURES, WIDTH, RIDGE, BINS, FOLDS = 256, 8.0, 0.03, 512, 4
_LOW, _HIGH = -0.75, 1.75

_CLASS = np.full(256, 8, np.uint8)
for _i, _chars in enumerate((range(65, 91), range(48, 58), (32, 9, 13), (10,), range(128, 256), (124,), (33, 63), b"#$%&*@^~=+<>_\\{}[]", (44, 46, 59, 58))):
    _CLASS[list(_chars)] = (0, 1, 2, 3, 4, 5, 6, 7, 9)[_i]
_CLASS[97:123] = 10


def _distinct_share(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts: its keys, and the share of distinct ones among them (1 without keys)."""
    count = np.bincount(of, minlength=n)
    # The text in the upper bits, 44 bits of the key below them.
    both = np.sort((of.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    distinct = np.bincount((both[new] >> np.uint64(44)).astype(np.int64), minlength=n)
    return count, np.where(count > 0, distinct / np.maximum(count, 1), 1.0)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros and shares of 1 for what is distinct."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    safe = np.maximum(size, 1)
    kind = _CLASS[data]
    of_byte = np.repeat(np.arange(n), size)
    shares = np.bincount(of_byte * 11 + kind, minlength=11 * n).reshape(n, 11) / safe[:, None]
    starts, ends, first = K.runs(~np.isin(kind, (2, 3)), offsets)
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(of, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / np.maximum(words, 1) - mean**2, 0))
    long = np.bincount(of, length > 14, n) / np.maximum(words, 1)
    capital = np.bincount(of, kind[starts] == 0, n) / np.maximum(words, 1) if len(starts) else np.zeros(n)
    h = K.span_hashes(data, starts, ends)
    _, distinct = _distinct_share(h, of, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    echoed = np.bincount(of, same, n) / np.maximum(words, 1)
    inside = of[1:] == of[:-1]
    pairs = (h[:-1] * K.u64(0x9E3779B97F4A7C15) + h[1:])[inside]
    _, distinct_pairs = _distinct_share(pairs, of[1:][inside], n)
    ls, le, lf = K.runs(kind != 3, offsets)
    of_line = np.repeat(np.arange(n), np.diff(lf))
    lines, distinct_lines = _distinct_share(K.span_hashes(data, ls, le), of_line, n)
    line_words = np.log1p(words / np.maximum(lines, 1))
    return np.column_stack(
        [np.log1p(size), shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3], shares[:, 4], shares[:, 5], shares[:, 6], shares[:, 7], shares[:, 9], shares[:, 8],
         np.minimum(mean, 50), np.minimum(spread, 50), long, distinct, echoed, distinct_pairs, distinct_lines, line_words, capital]
    ).astype(np.float32)


def _measure(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(data, offsets) for _, _, data, offsets in K.text_pieces(batch.column(column))]
        x = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)), np.float32)
        kept = [c for i, c in enumerate(batch.columns) if i != column]
        names = [c for i, c in enumerate(batch.schema.names) if i != column]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x[:, i]) for i in range(x.shape[1]))], [*names, *STATISTICS])


def measure(rows: DataFrame, *keep, text: str = "text") -> DataFrame:
    """The columns `keep` of each row with its STATISTICS as floats; a null text counts as empty."""
    rows = rows.select(*keep, F.col(text).alias("_text"))
    at = len(rows.columns) - 1
    schema = rows.drop("_text").schema
    for name in STATISTICS:
        schema = schema.add(name, "float")
    return rows.mapInArrow(lambda it: _measure(it, at), schema)


@dataclass
class QualityModel:
    """beta: weights of the features; without: a column of weights for each fold, fitted without it."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    without: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.ones((len(x), FEATURES + 1))
        z[:, :FEATURES] = np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b)
        return z

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def raw_without(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return (self.features(x) @ self.without)[np.arange(len(x)), fold]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS]).astype(np.float64)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _normal_equations(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    """Rows of Z^T [Z y] of the rows of a partition, for each fold."""
    total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    seen = False
    for batch in batches:
        z, fold = model.features(_matrix(batch)), _column(batch, "fold")
        zy = np.column_stack([z, _column(batch, "y")])
        for k in range(FOLDS):
            total[k] += z[fold == k].T @ zy[fold == k]
        seen = seen or len(batch) > 0
    if seen:
        at = np.arange(FOLDS * (FEATURES + 1), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([r.tobytes() for r in total.reshape(len(at), -1)], pa.binary())], ["i", "sums"])


def _add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One row of the matrix for each partition: a few KB for each."""
    total = np.sum([np.frombuffer(x, np.float64) for x in frame["sums"]], axis=0)
    return frame.iloc[:1].assign(sums=[total.tobytes()])


def _histogram(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BINS, 2))
    for batch in batches:
        raw = model.raw_without(_matrix(batch), _column(batch, "fold"))
        at = np.clip((raw - _LOW) / (_HIGH - _LOW) * BINS, 0, BINS - 1).astype(np.int64)
        total += np.column_stack([np.bincount(at, minlength=BINS), np.bincount(at, _column(batch, "y"), BINS)])
    full = np.flatnonzero(total[:, 0])
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full, 0]), pa.array(total[full, 1])], ["bin", "n", "y"])


def ridge(sums: np.ndarray) -> np.ndarray:
    """Weights from Z^T [Z y]; the constant is hardly held down."""
    penalty = np.full(len(sums), RIDGE)
    penalty[FEATURES] = 1e-6
    return np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1])


def isotonic(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing means of bins with n rows and sums y (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for a, b in zip(n, y, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], c, strict=True)]
    return np.concatenate([np.full(int(k), b / a) for a, b, k in blocks]) if blocks else np.zeros(0)


def fit(training: DataFrame) -> QualityModel:
    """A model from rows of STATISTICS with y of 0 or 1 and fold (0 to FOLDS - 1). Without any row all scores are 1/2."""
    spark = training.sparkSession
    with small_batches(spark):
        sums = training.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in STATISTICS for f in (F.avg, F.stddev_pop)]).collect()[0]
        d, n = len(STATISTICS), sums["n"]
        rng = np.random.default_rng(11)
        model = QualityModel(
            np.array([sums[f"avg_{c}"] or 0.0 for c in STATISTICS]),
            np.maximum([sums[f"stddev_pop_{c}"] or 0.0 for c in STATISTICS], 1e-3),
            rng.normal(0, 1 / WIDTH, (d, FEATURES)),
            rng.uniform(0, 2 * np.pi, FEATURES),
            np.zeros(FEATURES + 1),
            np.zeros((FEATURES + 1, FOLDS)),
            np.array([0.0]),
            np.array([0.5]),
        )
        if not n:
            return model
        parts = training.mapInArrow(lambda it: _normal_equations(it, model), "i int, sums binary")
        total = np.zeros((FOLDS * (FEATURES + 1), FEATURES + 2))
        for r in parts.groupBy("i").applyInPandas(_add, "i int, sums binary").collect():
            total[r["i"]] = np.frombuffer(r["sums"], np.float64)
        total = total.reshape(FOLDS, FEATURES + 1, FEATURES + 2)
        whole = total.sum(0)
        model.beta = ridge(whole)
        model.without = np.column_stack([ridge(whole - part) for part in total])
        fitted = spark.sparkContext.broadcast(model)
        bins = training.mapInArrow(lambda it: _histogram(it, fitted.value), "bin int, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).toPandas().sort_values("bin")
    values = isotonic(bins["n"].to_numpy(), bins["y"].to_numpy())
    # Between the middles of blocks of equal value, scores go in a straight line, so that order is kept.
    centres = _LOW + (bins["bin"].to_numpy() + 0.5) * (_HIGH - _LOW) / BINS
    weight = bins["n"].to_numpy()
    edges = np.flatnonzero(np.r_[True, np.diff(values) > 0])
    model.knots = np.add.reduceat(centres * weight, edges) / np.add.reduceat(weight, edges)
    model.values = values[edges]
    return model


def _score(batches: Iterator[pa.RecordBatch], model: QualityModel, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(_matrix(batch)))], [*keep, "score"])


def op2(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, held_out, score, predicted.

    A null doc_id is not held out and has no label; a row of labels without quality teaches nothing.
    A document with several rows of labels, or a label with several rows, counts each time. Null
    texts are scored as empty ones, by their statistics; texts are read whole; without any label all
    scores are 1/2. Columns beyond doc_id, text and quality are not read.
    """
    spark = documents.sparkSession
    held = F.coalesce(F.pmod(id_crc(), F.lit(4)) == 2, F.lit(False))
    keep = ["doc_id", "held_out"]
    with scratch(spark):
        measured = stored(measure(documents, F.col("doc_id"), held.alias("held_out")), "statistics")
        y = labels.filter(F.col("quality").isNotNull() & (F.pmod(id_crc(), F.lit(4)) != 2)).select("doc_id", F.col("quality").cast("double").alias("y"))
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
        training = stored(measured.filter("NOT held_out").join(y, "doc_id").select(*STATISTICS, "y", fold), "training")
        model = spark.sparkContext.broadcast(fit(training))
        out = measured.mapInArrow(lambda it: _score(it, model.value, keep), measured.select(*keep).schema.add("score", "double"))
        return stored(out.withColumn("predicted", (F.col("score") >= 0.7).cast("int")), "scores", keep=True)
