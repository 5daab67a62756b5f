"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Every text gives a row of statistics (lengths, shares of kinds of characters, repetition, spread of
the characters), each transformed so that it is roughly bell-shaped: logarithms of sizes, logits of
smoothed shares.  Each class has a mean and a covariance.  The covariance is shrunk towards the
pooled one by POOL and towards a diagonal by DIAGONAL, which keeps it well conditioned however few
rows a class has.  The score is the logistic of the difference of the two Gaussian log densities,
-0.5 * (squared Mahalanobis distance + log determinant), plus the log ratio of the class shares.
Distances come from the Cholesky factor of each covariance, worked out once when the model is made
and reused for every block.

The squared distance of a heavy-tailed statistic grows without bound, so that one odd statistic would
outweigh all others; statistics are held to REACH pooled standard deviations around the pooled mean
before both distances, in learning and in scoring alike.

Learning covers all labelled rows that aren't held out: tasks send their counts, sums and products per
class, Spark adds them up, and the driver receives 2 * (1 + D + D * (D + 1) / 2) numbers at any size.
A first round of those sums gives the pooled mean and deviation, a second one the held statistics.

Edge cases: null and empty texts have the statistics of a text without words and get a score from them.
Labels that are null, or other than 0 and 1 (booleans count as 0 and 1), aren't learned from, nor are
rows with a null id (not held out).  A document with several labels counts as low quality if one says
so.  With labels of one class only, every score is 1.0 or 0.0 after that class; without labels it is
0.5.  Repeated rows are learned as often as they occur and get equal scores.  Very long texts are
handled whole, one at a time.  Empty tables give an empty result.  Only ``doc_id`` and ``text`` of the
documents and ``doc_id`` and ``quality`` of the labels are read; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.llm import words as W
from clickmetrics.llm.common import ship, text_blocks, written

HELD_MOD, HELD_REST = 4, 2
THRESHOLD = 0.7
POOL = 0.5        # weight of the pooled covariance in each class's
DIAGONAL = 0.3    # weight of the diagonal in the mix
REACH = 4.0       # pooled standard deviations beyond which a statistic is held
BLOCK = 1 << 20

_KINDS = 8  # kinds of bytes whose shares are statistics
_KIND = np.full(256, 7, np.uint8)        # 7: other ASCII
_KIND[0x80:] = 0                         # 0: part of a non-ASCII character
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("A"):ord("Z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[[ord(c) for c in "#*$%&|<>"]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[[0x20, *range(0x09, 0x0E)]] = 6
_EXCLAIM = ord("!")
STATISTICS = ("log_words", "log_word_bytes", "log_word_spread", "log_longest", "lower", "upper", "digit", "symbol",
              "mark", "other", "exclaim", "words_no_letter", "words_marked", "repeated_words", "repeated_runs",
              "line_words", "spread")


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log odds of a share, smoothed so that 0 and 1 stay finite and small wholes stay near even."""
    return np.log((part + 0.5) / (whole - part + 0.5))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=upto[1:])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text (``STATISTICS`` names the columns)."""
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    kind = _KIND[data]
    counts = np.bincount(owner * _KINDS + kind, minlength=texts * _KINDS).reshape(texts, _KINDS).astype(float)
    exclaim = np.bincount(owner[data == _EXCLAIM], minlength=texts).astype(float)
    starts, ends, word_off = W.word_spans(data, offsets)
    lens = (ends - starts).astype(float)
    n = np.diff(word_off).astype(float)
    safe = np.maximum(n, 1)
    mean = _sums(lens, word_off) / safe
    spread = np.sqrt(np.maximum(_sums(lens * lens, word_off) / safe - mean * mean, 0))
    longest = np.zeros(texts)
    word_owner = np.repeat(np.arange(texts), np.diff(word_off))
    np.maximum.at(longest, word_owner, lens)
    letter = (kind <= 2).astype(np.int64)
    letters_upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=letters_upto[1:])
    no_letter = _sums((letters_upto[ends] == letters_upto[starts]).astype(float), word_off)
    marked = _sums(np.isin(kind[ends - 1], (4, 5)).astype(float), word_off) if len(ends) else np.zeros(texts)
    hashes = W.span_hashes(data, starts, ends)
    again = _sums(W.repeated(word_owner, hashes).astype(float), word_off)
    runs = W.window_hashes(hashes, 4)
    inside = np.flatnonzero(word_owner[:len(runs)] == word_owner[len(hashes) - len(runs):])
    runs_again = np.zeros(texts)
    np.add.at(runs_again, word_owner[inside], W.repeated(word_owner[inside], runs[inside]))
    n_runs = np.maximum(n - 3, 0)
    lines = np.bincount(owner[data == 0x0A], minlength=texts) + 1.0
    # Entropy in bits of the bytes' low six bits: narrow for junk that repeats few characters.
    cells = np.bincount(owner * 64 + (data & 63), minlength=texts * 64).reshape(texts, 64).astype(float)
    total = np.maximum(cells.sum(axis=1), 1)
    p = cells / total[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    body = counts.sum(axis=1) - counts[:, 6]
    return np.column_stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), np.log1p(longest),
        *[_logit(counts[:, k], body) for k in (1, 2, 3, 4, 5, 7)], _logit(exclaim, body),
        _logit(no_letter, n), _logit(marked, n), _logit(again, n), _logit(runs_again, n_runs), np.log1p(n / lines), entropy])


class Model:
    """Class means and Cholesky factors; ``center`` and ``reach`` hold the statistics first."""

    def __init__(self, center, reach, means, covariances, log_odds: float):
        self.center, self.reach, self.means, self.log_odds = center, reach, means, log_odds
        self.factors = [np.linalg.cholesky(c) for c in covariances]
        self.inverse = [np.linalg.inv(f) for f in self.factors]
        self.log_det = [2 * np.log(np.diag(f)).sum() for f in self.factors]

    def held(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, self.center - self.reach, self.center + self.reach)

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = self.held(x)
        density = []
        for mean, inverse, log_det in zip(self.means, self.inverse, self.log_det, strict=True):
            z = (x - mean) @ inverse.T
            density.append(-0.5 * ((z * z).sum(axis=1) + log_det))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


class Constant:
    """The model without labels of both classes."""

    def __init__(self, value: float):
        self.value = value

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_MOD == HELD_REST, F.lit(False))


def _statistics_task(batches):
    for block in text_blocks(batches, most=BLOCK):
        data, offsets = W.text_bytes(block.column("text"))
        x = statistics(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), lists], ["doc_id", "held_out", "x"])


def document_statistics(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, x`` per row: one pass over the texts."""
    ship(spark)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_statistics_task, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments_task(center, reach):
    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            if center is not None:
                x = np.clip(x, center - reach, center + reach)
            y = batch.column("quality").to_numpy(zero_copy_only=False)
            for k in np.unique(y).tolist():
                part = x[y == k]
                have = total.setdefault(int(k), [0, 0.0, 0.0])
                have[0] += len(part)
                have[1] = have[1] + part.sum(axis=0)
                have[2] = have[2] + part.T @ part
        for k, (n, s, p) in total.items():
            values = np.concatenate([[n], s, p[np.triu_indices(len(s))]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k)), pa.array(np.arange(len(values))),
                                              pa.array(values)], ["quality", "slot", "value"])
    return run


def _moments(labelled: DataFrame, center=None, reach=None) -> dict[int, tuple]:
    """Per class: rows, mean and mean product of the statistics, summed up by Spark."""
    rows = labelled.select("quality", "x").mapInArrow(_moments_task(center, reach), "quality long, slot long, value double")
    got: dict[int, dict] = {}
    for r in rows.groupBy("quality", "slot").agg(F.sum("value").alias("value")).collect():  # a fixed number of rows
        got.setdefault(r["quality"], {})[r["slot"]] = r["value"]
    out, d = {}, len(STATISTICS)
    for k, slots in got.items():
        v = np.array([slots[i] for i in range(len(slots))])
        products = np.zeros((d, d))
        products[np.triu_indices(d)] = v[1 + d:]
        products = products + np.triu(products, 1).T
        out[k] = (v[0], v[1:1 + d] / v[0], products / v[0])
    return out


def fit(first: dict[int, tuple], second: dict[int, tuple] | None, center, reach) -> Model | Constant:
    """The model from the class moments of the held statistics."""
    if not first:
        return Constant(0.5)
    if len(first) == 1:
        return Constant(float(next(iter(first))))
    cov = {k: p - np.outer(m, m) for k, (_, m, p) in second.items()}
    n = {k: v[0] for k, v in second.items()}
    pooled = sum(n[k] * cov[k] for k in (0, 1)) / (n[0] + n[1])
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    shrunk = []
    for k in (0, 1):
        mixed = (1 - POOL) * cov[k] + POOL * pooled
        shrunk.append((1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.maximum(np.diag(mixed), 1e-6)) + 1e-3 * floor)
    return Model(center, reach, [second[0][1], second[1][1]], shrunk, float(np.log(n[1] / n[0])))


def _span(first: dict[int, tuple]):
    """Pooled mean of the class moments and REACH pooled standard deviations."""
    n = sum(v[0] for v in first.values())
    mean = sum(v[0] * v[1] for v in first.values()) / n
    square = sum(v[0] * np.diag(v[2]) for v in first.values()) / n
    return mean, REACH * np.sqrt(np.maximum(square - mean * mean, 1e-6))


def learn(rows: DataFrame, labels: DataFrame) -> Model | Constant:
    """A model from written ``document_statistics`` and ``labels``."""
    quality = F.col("quality").cast("int")
    known = (labels.select("doc_id", quality.alias("quality")).filter("quality in (0, 1) and doc_id is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    labelled = rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()).join(known, "doc_id").select("quality", "x")
    first = _moments(labelled)
    if len(first) < 2:
        return fit(first, None, None, None)
    center, reach = _span(first)
    return fit(first, _moments(labelled, center, reach), center, reach)


def _score_task(model):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = model.scores(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    rows = written(spark, document_statistics(spark, docs), "statistics")
    model = learn(rows, labels)
    return rows.mapInArrow(_score_task(model), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op12(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(spark, docs, labels)
