"""Toxicity: a character n-gram linear classifier with naive Bayes feature scaling.

Features are the presence of byte 4- and 5-grams of the whole text (A-Z folded), hashed into
FEATURES slots.  r = log of (share of a feature in toxic documents / share in the others), both
smoothed by one.  A logistic regression is trained on the present features, each scaled by its r
(features with |r| < LEAST_RATIO or in fewer than LEAST_DOCS sample documents are left out; of the
others the MOST_SLOTS that part the classes most are used).  The weights w * r fold into one table,
so a score is the logistic of the sum of the table over the distinct features of a text.

Learning uses a bounded sample of labelled rows: a draw, by a hash of the id, whose expected size is
SAMPLE, half of each class where there are enough; the intercept is corrected for the class shares
among all learnable rows.  What the driver gets is bounded by these parameters, not by the texts: first
one count per slot and class, then one bitmap of MOST_SLOTS bits per sampled document.

Edge cases: null and empty texts score the intercept alone.  Labels that are null, or other than 0
and 1, aren't learned from, nor are rows with a null id (not held out).  A document with several
labels is learned as toxic if one says so.  With no label of one class, every score is the share
of toxic labels (0.0 with no labels at all).  Repeated rows get equal scores (and count
as often as they occur in the sample).  Empty tables give an empty result.  Only ``doc_id`` and
``text`` are read when scoring, and ``doc_id`` and ``toxic`` of the labels; further columns of any
name are left alone.  A very long text is read whole; a task holds its bytes and eight bytes a byte
for each n-gram length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.llm import words as W
from clickmetrics.llm.common import ship, text_blocks, unit_interval, written

FEATURE_BITS = 17
GRAMS = (4, 5)
SAMPLE = 4000
LEAST_RATIO = 1.0
LEAST_DOCS = 8
MOST_SLOTS = 4096
RIDGE = 3e-3
ROUNDS = 200
THRESHOLD = 0.3
HELD_MOD, HELD_REST = 4, 2


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_MOD == HELD_REST, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray):
    """The distinct feature slots of each text, one array per text."""
    x = W.FOLD[data].astype(np.uint64)
    slots = []
    for g in GRAMS:
        if len(x) < g:
            slots.append(np.zeros(0, np.int64))
            continue
        code = x[:len(x) - g + 1].copy()
        for k in range(1, g):
            code = code * np.uint64(257) + x[k:len(x) - g + 1 + k]
        slots.append((W.mix(code * np.uint64(8) + np.uint64(g)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    place = np.zeros(1 << FEATURE_BITS, np.int64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        f = np.concatenate([s[a:max(a, b - g + 1)] for s, g in zip(slots, GRAMS, strict=True)])
        at = np.arange(len(f))
        place[f] = at  # the last occurrence of each slot stays
        yield f[place[f] == at]


class Model:
    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, data, offsets) -> np.ndarray:
        sums = np.array([self.table[f].sum(dtype=np.float64) for f in features(data, offsets)])
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))


def choose(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int):
    """The log ratio of every slot and the slots to use, ascending, from the documents of each class that have it."""
    p1, p0 = (c1 + 1) / (n1 + 2), (c0 + 1) / (n0 + 2)
    r = np.log(p1) - np.log(p0)
    use = np.flatnonzero((np.abs(r) >= LEAST_RATIO) & (c1 + c0 >= LEAST_DOCS))
    parts = np.abs(r) * np.abs(p1 - p0)
    best = use[np.argsort(-parts[use], kind="stable")[:MOST_SLOTS]]
    return r, np.sort(best)


def fit(has: np.ndarray, toxic: np.ndarray, r: np.ndarray, chosen: np.ndarray, share: float) -> Model:
    """A model from which of the ``chosen`` slots each sample document has (documents x slots) and its 0/1
    label; ``share`` is the true share of toxic rows."""
    n1 = max(1, int(toxic.sum()))
    n0 = max(1, len(toxic) - n1)
    size = len(chosen)
    x = has.astype(np.float32)  # at most about SAMPLE x MOST_SLOTS numbers, whatever the texts
    x *= r[chosen].astype(np.float32)
    # w is per slot; features are r, so the folded table is w * r.
    w, bias, m, v, mb, vb = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    y = toxic.astype(float)
    for step in range(1, ROUNDS + 1):
        z = x @ w.astype(np.float32) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        g = err.astype(np.float32) @ x + RIDGE * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        up, down = 1 - 0.9 ** step, 1 - 0.99 ** step
        w -= 0.02 * (m / up) / (np.sqrt(v / down) + 1e-8)
        bias -= 0.02 * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(n1 / n0)
    table = np.zeros(1 << FEATURE_BITS, np.float32)
    table[chosen] = w * r[chosen]
    return Model(table, float(bias + shift))


def _count_task(batches):
    """Documents per slot and class among the rows of a task."""
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    for block in text_blocks(batches):
        toxic = block.column("toxic").to_numpy(zero_copy_only=False)
        for y, f in zip(toxic, features(*W.text_bytes(block.column("text"))), strict=True):
            counts[int(y), f] += 1
    for y in (0, 1):
        slot = np.flatnonzero(counts[y])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), y, np.int32)), pa.array(slot.astype(np.int32)),
                                          pa.array(counts[y][slot])], ["toxic", "slot", "n"])


def _bits_task(chosen: np.ndarray):
    def run(batches):
        for block in text_blocks(batches):
            packed = []
            for f in features(*W.text_bytes(block.column("text"))):
                has = np.zeros(1 << FEATURE_BITS, bool)
                has[f] = True
                packed.append(np.packbits(has[chosen]).tobytes())
            toxic = block.column("toxic").cast(pa.int32())
            yield pa.RecordBatch.from_arrays([toxic, block.column("draw"), pa.array(packed, pa.binary())],
                                             ["toxic", "draw", "bits"])
    return run


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ship(spark)
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # Only ids meet the labels here; texts are read for the drawn ids alone.
    present = written(spark, docs.select("doc_id").join(known, "doc_id"), "labelled")
    counts = {r["toxic"]: r["count"] for r in present.groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return Model(np.zeros(1 << FEATURE_BITS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    take1 = min(n1, max(sample // 2, sample - n0))
    take0 = min(n0, sample - take1)
    draw = unit_interval(F.lit(21), "doc_id")
    rate = F.when(F.col("toxic") == 1, take1 / n1).otherwise(take0 / n0)
    drawn = present.distinct().withColumn("draw", draw).filter(F.col("draw") < rate)  # about `sample` ids: broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("toxic", "draw", "text")
    picked = written(spark, picked, "toxicity-sample")
    seen = picked.mapInArrow(_count_task, "toxic int, slot int, n long").groupBy("toxic", "slot").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int64)
    for row in seen.collect():  # at most one row per slot and class
        counts[row["toxic"], row["slot"]] = row["n"]
    sizes = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    r, chosen = choose(counts[1], counts[0], sizes.get(1, 0), sizes.get(0, 0))
    got = picked.mapInArrow(_bits_task(chosen), "toxic int, draw double, bits binary").collect()
    got.sort(key=lambda g: (g["draw"], bytes(g["bits"])))  # one order whatever task ended first
    bits = np.frombuffer(b"".join(bytes(g["bits"]) for g in got), np.uint8).reshape(len(got), -(-len(chosen) // 8))
    has = np.unpackbits(bits, axis=1, count=len(chosen)).astype(bool)
    return fit(has, np.array([g["toxic"] for g in got]), r, chosen, share)


def _score_task(model: Model):
    def run(batches):
        for block in text_blocks(batches):
            data, offsets = W.text_bytes(block.column("text"))
            score = model.scores(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(score),
                 pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    ship(spark)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_score_task(model), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op8(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(spark, docs, learn(spark, docs, labels))
