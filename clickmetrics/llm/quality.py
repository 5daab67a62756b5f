"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Per document, a few measures are taken from the whole text (:data:`MEASURES`).  Their
distribution is sketched per (language, source) as a log-linear histogram: a value falls into the
bucket of its leading bits (16 per power of two, so quantiles have a relative error under 1/16),
and a sketch is a set of (bucket, count) rows.  Sketches merge by adding counts, so partial
sketches are made in each task and the sketches of a language and of the whole table are sums of
the smaller ones.  A (language, source) with fewer than MIN_DOCS sketched documents uses its
language's sketch, and that falls back on the whole table's.

A threshold is the group's median plus (or minus) REACH times the distance from the median to the
upper (lower) quartile, at least SLACK away.  A document is rejected if the fixed base rule fails
(fewer than 20 words, or over 30% of words in repeated 8-word windows) or if any measure passes its
group's threshold.  The thresholds are joined to the documents' measures.

Only documents that pass the base rule are sketched.

Edge cases: null or empty text has no words and fails the base rule.  Null language and null source
are groups of their own.  Repeated rows count as often as they occur and get equal verdicts.  An
empty table gives an empty result.  Extra columns pass through :func:`quality_filter` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickmetrics.llm import words as W
from clickmetrics.llm.common import fresh, ship, text_blocks, written

MIN_WORDS = 20
MOST_REPEATED = 30  # percent
MIN_DOCS = 100
REACH = 6
# measure -> (direction, least distance of the threshold from the median)
MEASURES = {
    "symbols": (1, 100),    # symbols per 1000 words
    "dup_lines": (1, 400),  # duplicate lines per 1000 lines
    "upper": (1, 300),      # upper-case ASCII letters per 1000 characters of words
    "long_words": (1, 400),  # characters of words per 100 words
    "short_words": (-1, 250),
}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def text_stats(col) -> list[np.ndarray]:
    """The columns of STATS for an Arrow text column."""
    data, offsets = W.text_bytes(col)
    n = len(offsets) - 1
    starts, ends, word_off = W.word_spans(data, offsets)
    n_words = np.diff(word_off)
    char = (data & 0xC0) != 0x80
    word_chars = W.per_text(char & ~W.IS_SPACE[data], offsets)
    symbols = W.per_text(_SYMBOL[data], offsets)
    upper = W.per_text((data >= 65) & (data <= 90), offsets)
    # lines
    nl = data == 10
    n_lines = W.per_text(nl, offsets) + 1
    line_off = np.concatenate(([0], np.cumsum(n_lines)))
    total = int(line_off[-1])
    l_start, l_end = np.zeros(total, np.int64), np.zeros(total, np.int64)
    cut = np.flatnonzero(nl)
    cut_doc = np.searchsorted(offsets, cut, side="right") - 1
    at = np.arange(len(cut)) + cut_doc  # each text adds one line more than it has line ends
    l_end[at], l_start[at + 1] = cut, cut + 1
    l_start[line_off[:-1]], l_end[line_off[1:] - 1] = offsets[:-1], offsets[1:]
    has_word = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_doc = np.repeat(np.arange(n), n_lines)[has_word]
    key = W.mix(W.span_hashes(data, l_start[has_word], l_end[has_word]) + l_doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    dup = np.bincount(l_doc[again], minlength=n).astype(np.int64)
    # words in 8-word windows that occur twice or more
    repeat = np.zeros(n, np.int64)
    hw = W.window_hashes(W.span_hashes(data, starts, ends), 8)
    if len(hw):
        owner = np.repeat(np.arange(n), n_words)
        whole = np.flatnonzero(owner[:len(hw)] == owner[7:])
        hit = whole[W.repeated(owner[whole], hw[whole])]
        steps = np.zeros(len(starts) + 1, np.int64)
        steps[hit] += 1
        steps[hit + 8] -= 1
        repeat = W.per_text(np.cumsum(steps[:-1]) > 0, word_off)
    return [n_words, word_chars, symbols, dup, repeat, n_lines, upper]


def _stats_task(names):
    def run(batches):
        for block in text_blocks(batches, most=W.BLOCK):
            stats = text_stats(block.column("text"))
            cols = [block.column(c) for c in names] + [pa.array(s.astype(np.int64)) for s in stats]
            yield pa.RecordBatch.from_arrays(cols, names + [c.split()[0] for c in STATS.split(", ")])
    return run


def document_stats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, text_hash`` and STATS of every row (one pass over the texts)."""
    ship(spark)
    keyed = docs.select("doc_id", "lang", "source",
                        F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("text_hash"), "text")
    names = ["doc_id", "lang", "source", "text_hash"]
    kinds = dict(keyed.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", " + STATS
    return keyed.mapInArrow(_stats_task(names), schema)


def measures() -> dict[str, Column]:
    def per(top: str, bottom: str, scale: int) -> Column:
        return F.expr(f"if({bottom} > 0, {scale} * {top} div {bottom}, 0L)")

    return {"symbols": per("n_symbols", "n_words", 1000), "dup_lines": per("n_dup_lines", "n_lines", 1000),
            "upper": per("n_upper", "word_chars", 1000),
            "long_words": per("word_chars", "n_words", 100), "short_words": per("word_chars", "n_words", 100)}


def bucket(v: Column) -> Column:
    """The log-linear bucket of a value >= 0: the value itself below 16, else its exponent and the
    next four bits."""
    e = F.length(F.bin(v)) - 1
    return F.when(v < 16, v).otherwise(e * 16 + F.call_function("shiftright", v, e - 4) % 16).cast("int")


def bucket_start(b: Column) -> Column:
    """The smallest value of a bucket."""
    e = F.floor(b / 16).cast("int")
    return F.when(b < 16, b.cast("long")).otherwise(F.call_function("shiftleft", (F.lit(16) + b % 16).cast("long"), e - 4))


def sketches(passed: DataFrame) -> DataFrame:
    """Sketch rows ``lang, source, measure, b, n`` (n documents in bucket b)."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in measures().items()]))
    return (passed.select("lang", "source", named.alias("m")).groupBy(
        "lang", "source", F.col("m.measure").alias("measure"), bucket(F.col("m.v")).alias("b"))
        .agg(F.count("*").alias("n")))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``docs, q1, q2, q3`` per group and measure: start of the bucket that holds the quantile."""
    w = Window.partitionBy(*keys, "measure")
    run = sketch.withColumn("upto", F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "docs", F.sum("n").over(w))
    q = [F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, bucket_start(F.col("b")))).alias(f"q{k}") for k in (1, 2, 3)]
    return run.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), *q)


def thresholds(spark: SparkSession, sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with a limit for each measure."""
    fine = quartiles(sketch, "lang", "source").withColumnsRenamed({"lang": "l", "source": "s"})
    lang = quartiles(merge(sketch, "lang"), "lang").select(
        F.col("lang").alias("ll"), F.col("measure").alias("lm"), *[F.col(c).alias("l_" + c) for c in ("docs", "q1", "q2", "q3")])
    every = quartiles(merge(sketch)).select(F.col("measure").alias("am"), *[F.col(c).alias("a_" + c) for c in ("q1", "q2", "q3")])
    j = fine.join(lang, F.col("l").eqNullSafe(F.col("ll")) & (F.col("measure") == F.col("lm"))).join(
        every, F.col("measure") == F.col("am"))

    def q(k):
        return (F.when(F.col("docs") >= MIN_DOCS, F.col(f"q{k}")).when(F.col("l_docs") >= MIN_DOCS, F.col(f"l_q{k}"))
                .otherwise(F.col(f"a_q{k}")))

    limits = []
    for name, (way, slack) in MEASURES.items():
        far = REACH * (q(3) - q(2)) if way > 0 else REACH * (q(2) - q(1))
        limit = q(2) + F.greatest(far, F.lit(slack)) if way > 0 else q(2) - F.greatest(far, F.lit(slack))
        limits.append(F.max(F.when(F.col("measure") == name, limit)).alias("t_" + name))
    return j.groupBy("l", "s").agg(*limits)


def verdicts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row of ``docs``."""
    stats = written(spark, document_stats(spark, docs), "quality-stats")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    sketch = written(spark, sketches(stats.filter("not base_failed")), "quality-sketches")
    limits = written(spark, thresholds(spark, sketch), "quality-limits")
    j = stats.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    fine = F.lit(True)
    value = measures()
    for name, (way, _) in MEASURES.items():
        limit = F.col("t_" + name)
        fine = fine & F.coalesce(value[name] <= limit if way > 0 else value[name] >= limit, F.lit(True))
    return j.withColumn("kept", ~F.col("base_failed") & fine).drop("l", "s", *["t_" + n for n in MEASURES])


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return verdicts(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                        "n_repeat_words", "base_failed", "kept")


def quality_filter(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    keep = verdicts(spark, docs).filter("kept").select("doc_id", "lang", "source", "text_hash").distinct()
    ids = {c: fresh(docs, f"quality_{c}") for c in keep.columns}
    keep = keep.withColumnsRenamed(ids)
    h = F.xxhash64(F.coalesce(docs["text"], F.lit("")), docs["text"].isNull())
    same = (docs["doc_id"].eqNullSafe(keep[ids["doc_id"]]) & docs["lang"].eqNullSafe(keep[ids["lang"]])
            & docs["source"].eqNullSafe(keep[ids["source"]]) & (h == keep[ids["text_hash"]]))
    return docs.join(keep, same, "left_semi")
