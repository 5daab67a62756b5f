"""Language ID: a bidirectional gated recurrent network over bytes.

Texts are cut into segments of STEPS bytes (A-Z folded to a-z).  Two gated recurrent units (one
update gate each; x / (1 + |x|) as the squashing function, which costs a fraction of tanh) read a
segment, one forwards and one backwards; at every byte their joint state gives the probabilities
of the languages.  A document's probabilities are the means over all bytes of its whole text; the
prediction is the largest (ties: the smaller language name) and the score is its probability.

Training is in numpy by backpropagation through time on the driver, over a bounded sample:
SAMPLE segments in all, shared evenly between the learned languages and drawn by a hash of id and
text.  At most SAMPLE languages are learned, the most frequent ones (then one segment each).  The cross entropy of every position is minimised with Adam.  The weights (a few thousand
numbers) go to the tasks, which run many segments at once as matrix products.

Edge cases: a null text or one without any letter gets ``und`` and score 0.  Rows with a null
language aren't learned from, nor are rows with a null id (which count as not held out).  With no
learnable row at all every text is ``und``.  Repeated rows get equal predictions.  An empty table
gives an empty result.  Only ``doc_id`` and ``text`` are read when predicting, and ``lang`` when
learning; further columns of any name are left alone.  A very long text is read whole, in blocks of
segments: a task holds its bytes, eight bytes a byte of codes, and one block of states.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.llm import words as W
from clickmetrics.llm.common import ship, text_blocks, unit_interval

STEPS = 48
UNITS = 8
SAMPLE = 6000
EPOCHS = 8
BATCH = 256
RATE = 0.02
PAD = 256
LETTER = r"\p{L}"
HELD_MOD, HELD_REST = 3, 1


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_MOD == HELD_REST, F.lit(False))


def _soft(x):
    """x / (1 + |x|) in place: a cheap smooth squashing to (-1, 1)."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


class Gru:
    """One direction: a recurrent unit with an update gate.

    ``table`` (2H x 257) is the input part of gate and candidate for every byte, ``rec`` (2H x H)
    the recurrent part.  z = (1 + soft(.)) / 2, c = soft(.), h' = h + z (c - h)."""

    def __init__(self, table, rec):
        self.table, self.rec = table, rec

    @staticmethod
    def fresh(rng, units):
        return Gru(rng.normal(0, 0.3, (2 * units, 257)).astype(np.float32),
                   rng.normal(0, 1 / np.sqrt(units), (2 * units, units)).astype(np.float32))

    def run(self, codes, keep=None):
        """States after each step (T x H x N) for byte codes (T x N)."""
        units = self.rec.shape[1]
        h = np.zeros((units, codes.shape[1]), np.float32)
        out = np.empty((len(codes), units, codes.shape[1]), np.float32)
        x = np.empty((2 * units, codes.shape[1]), np.float32)
        for t, code in enumerate(codes):
            self.table.take(code, axis=1, out=x, mode="clip")
            x += self.rec @ h
            s = _soft(x)
            if keep is not None:
                keep.append((h, s.copy()))
            z = s[:units] + 1
            z *= 0.5
            z *= s[units:] - h
            z += h
            out[t] = h = z
        return out

    def back(self, codes, keep, d_out):
        """Gradients of table and rec from the gradients of the states, through time."""
        units = self.rec.shape[1]
        d_table, d_rec = np.zeros_like(self.table), np.zeros_like(self.rec)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(codes) - 1, -1, -1):
            h, s = keep[t]
            z, c = (s[:units] + 1) / 2, s[units:]
            d = d_out[t] + d_h
            slope = (1 - np.abs(s)) ** 2
            gates = np.concatenate([d * (c - h) / 2, d * z]) * slope
            d_h = d * (1 - z) + self.rec.T @ gates
            d_rec += gates @ h.T
            for g in range(len(gates)):
                d_table[g] += np.bincount(codes[t], weights=gates[g], minlength=257)
        return d_table, d_rec


class Net:
    def __init__(self, langs, fwd, bwd, out, bias):
        self.langs, self.fwd, self.bwd, self.out, self.bias = langs, fwd, bwd, out, bias

    def positions(self, codes):
        """Probabilities of the languages at every position: T x L x N."""
        f = self.fwd.run(codes)
        b = self.bwd.run(codes[::-1])[::-1]
        units = f.shape[1]
        logits = self.out[:, :units] @ f
        logits += self.out[:, units:] @ b
        logits += self.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pooled(self, data: np.ndarray, offsets: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """Mean probabilities of every text (texts x L), over all of its bytes."""
        lens = np.diff(offsets)
        n_seg = -(-lens // STEPS)
        doc = np.repeat(np.arange(len(lens)), n_seg)
        first = np.cumsum(n_seg) - n_seg
        start = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * STEPS
        stop = offsets[1:][doc]
        sums = np.zeros((len(lens), len(self.langs)))
        codes_of = np.append(W.FOLD[data].astype(np.int64), PAD)
        for a in range(0, len(doc), at_once):
            s, e = start[a:a + at_once], stop[a:a + at_once]
            at = s[None, :] + np.arange(STEPS)[:, None]
            real = at < e[None, :]
            probs = self.positions(codes_of[np.where(real, at, len(data))])
            probs *= real[:, None, :]
            of_seg = probs.sum(axis=0, dtype=np.float64)
            for k in range(len(self.langs)):
                sums[:, k] += np.bincount(doc[a:a + at_once], weights=of_seg[k], minlength=len(lens))
        return sums / np.maximum(lens, 1)[:, None]


def train(segments: list[bytes], labels: list[str], seed: int = 1, epochs: int = EPOCHS, units: int = UNITS) -> Net:
    """A network fitted to byte segments and the languages of their documents."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    codes = np.full((STEPS, len(segments)), PAD, np.int64)
    for i, s in enumerate(segments):
        s = W.FOLD[np.frombuffer(s[:STEPS], np.uint8)]
        codes[:len(s), i] = s
    y = np.array([langs.index(x) for x in labels])
    net = Net(langs, Gru.fresh(rng, units), Gru.fresh(rng, units),
              rng.normal(0, 0.3, (len(langs), 2 * units)).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [net.fwd.table, net.fwd.rec, net.bwd.table, net.bwd.rec, net.out, net.bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        for a in range(0, len(order), BATCH):
            pick = order[a:a + BATCH]
            x, real = codes[:, pick], codes[:, pick] != PAD
            keep_f, keep_b = [], []
            f = net.fwd.run(x, keep_f)
            b = net.bwd.run(x[::-1], keep_b)[::-1]
            both = np.concatenate([f, b], axis=1)
            logits = net.out @ both + net.bias[:, None]
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[:, y[pick], np.arange(len(pick))] -= 1
            p *= (real / max(1, real.sum()))[:, None, :]
            d_out = np.einsum("tln,tun->lu", p, both, optimize=True)
            d_bias = p.sum(axis=(0, 2))
            d_both = net.out.T @ p
            d_ft, d_fr = net.fwd.back(x, keep_f, d_both[:, :units])
            d_bt, d_br = net.bwd.back(x[::-1], keep_b, d_both[::-1, units:])
            step += 1
            for i, g in enumerate([d_ft, d_fr, d_bt, d_br, d_out, d_bias]):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.99 * m2[i] + 0.01 * g * g
                params[i] -= (RATE * (m1[i] / (1 - 0.9 ** step)) / (np.sqrt(m2[i] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return net


def learn(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Net | None:
    """Fit a network on at most ``sample`` segments of the rows that aren't held out."""
    rows = docs.select("doc_id", "lang", "text").filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                       & F.col("text").rlike(LETTER))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # Each language's rows pass with the probability that leaves about 1.2 times its share.
    rates = spark.createDataFrame([(k, min(1.0, 1.2 * each / n)) for k, n in counts.items()], "l string, rate double")
    draw = unit_interval(F.lit(11), "doc_id", "text")
    place = F.floor(unit_interval(F.lit(12), "doc_id", "text") * F.greatest(F.octet_length("text") - STEPS + 1, F.lit(1))) + 1
    segment = F.substring(F.col("text").cast("binary"), place.cast("int"), F.lit(STEPS))
    got = (rows.join(F.broadcast(rates), F.col("lang") == F.col("l")).withColumn("draw", draw)
           .filter(F.col("draw") < F.col("rate")).select("lang", "draw", segment.alias("s")).collect())
    got.sort(key=lambda r: (r["lang"], r["draw"], bytes(r["s"])))
    segments, labels, seen = [], [], {}
    for r in got:
        if seen.get(r["lang"], 0) < each and len(r["s"]):
            seen[r["lang"]] = seen.get(r["lang"], 0) + 1
            segments.append(bytes(r["s"]))
            labels.append(r["lang"])
    return train(segments, labels) if segments else None


def _predict_task(net: Net | None):
    def run(batches):
        for block in text_blocks(batches):
            n = block.num_rows
            lang, score = ["und"] * n, np.zeros(n)
            if net is not None and n:
                data, offsets = W.text_bytes(block.column("text"))
                probs = net.pooled(data, offsets)
                best = probs.argmax(axis=1)
                known = block.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                lang = [net.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(probs.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(lang, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(spark: SparkSession, docs: DataFrame, net: Net | None) -> DataFrame:
    ship(spark)
    rows = docs.select("doc_id", held_out().alias("held_out"),
                       F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered"), "text")
    return rows.mapInArrow(_predict_task(net), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return predict(spark, docs, learn(spark, docs))
