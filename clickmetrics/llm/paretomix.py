"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) get the weights 5, 2, 1, repeating, of a budget of
150% of all words; a target stops at twice its source's words and what exceeds it is reshared by
weight among the others.

Sampling: with rate r = target / words of the source, every document is taken floor(r) whole
copies for certain.  The rest of the target is a fixed-size sample (its size counted in words)
of unequal probability: document i has the inclusion probability p_i = f * g_i / mean(g), where f
is the fraction of the source still wanted and g_i = size ** TILT favours longer documents
mildly.  Documents are ranked by u/(1-u) / (p/(1-p)) (Pareto order sampling: random odds over
inclusion odds; u is drawn from a hash of the id) and taken in that order while the running
words stay nearest to what is wanted.  A document with p_i >= 1 ranks first.

Scale: only (id, source, size) rows move.  The cut in the ranking of a source is found without
sorting the source: words are summed per source and rank bucket (DIGITS bits at a time, partial
sums before each shuffle), running sums run over those buckets, and only the documents of the
one bucket that holds the cut are looked at by the next digit; the last few are sorted.

Edge cases: null or empty text has size 0 and takes 0 words.  A null source is a source.  Repeated
rows draw the same u; where the cut falls between them the order is that of (id, size) and any of
them may be the one taken.  All sizes 0: every target is 0.  Empty table: empty result.  Extra
columns pass through :func:`mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickmetrics.llm.common import WORD, fresh, unit_interval, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
TILT = 0.25
SEED = 7
DIGITS = 12
LEVELS = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """One row per source: ``source, source_size, mean_tilt, target``.

    The rank of a source comes from a range sort (no single-task sort): partitions are numbered in
    order, and only one count per partition reaches the driver."""
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        # null where a source has no words
        F.try_divide(F.sum(F.col("size") * F.pow(F.col("size").cast("double"), F.lit(TILT))), F.sum("size")).alias("mean_tilt"))
    per = per.withColumn("none", F.col("source").isNull())
    per = per.repartitionByRange("none", "source").sortWithinPartitions("none", "source").withColumn(
        "at", F.monotonically_increasing_id())
    per = written(spark, per, "sources")
    part = F.shiftrightunsigned("at", 33).cast("int")
    counts = sorted((r["p"], r["n"]) for r in per.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    if not offsets:
        return per.select("source", "source_size", "mean_tilt", F.lit(0.0).alias("target"))
    first = spark.createDataFrame(offsets, "p int, before long")
    mask = (1 << 33) - 1
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(mask))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("p", part).join(first, "p").withColumn("rank", rank).withColumn("weight", weight)
    per = written(spark, per.select("source", "source_size", "mean_tilt", "weight"), "source-weights")
    # Water filling: sources at their cap keep it, the others share the rest by weight, until stable.
    cap = F.col("source_size") * float(most)
    total = (per.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * share
    level = 0.0
    while True:
        full = F.col("weight") * level > cap
        row = per.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("capped"),
                      F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if row["open"] <= 0:
            break
        new = (total - row["capped"]) / row["open"]
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), cap)
    return per.select("source", "source_size", "mean_tilt", target.alias("target"))


def copies(spark: SparkSession, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, row_no, source_size, target, copies`` for every row of ``docs``."""
    base = written(spark, docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                      F.col("row_no") if "row_no" in docs.columns else F.lit(0).alias("row_no")),
                   "sizes")
    targets = written(spark, source_targets(spark, base), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    j = base.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    j = j.withColumn("whole", F.floor(rate).cast("int")).withColumn("part", rate - F.floor(rate))
    # What is wanted of a source is a number of the source, the same on all its rows.
    j = j.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    p = F.try_divide(F.col("part") * F.pow(F.col("size").cast("double"), F.lit(TILT)), F.col("mean_tilt"))
    p = F.least(F.coalesce(p, F.lit(0.0)), F.lit(1.0))
    u = unit_interval(F.lit(seed), F.col("doc_id"))
    odds = (u / (1 - u)) * (1 - p) / p
    rank = F.when(p > 0, odds / (1 + odds)).otherwise(F.lit(1.0))  # in [0, 1], same order as the odds ratio
    j = j.withColumn("rank", rank)
    key = F.floor(F.least(F.col("rank"), F.lit(1 - 2.0 ** -40)) * float(1 << (DIGITS * LEVELS))).cast("long")
    j = written(spark, j.withColumn("bucket", key), "ranked")
    # edge: per source, the bucket prefix that holds the cut and the words ranked before it
    edge = j.groupBy("source").agg(F.first("wanted").alias("left")).select(
        F.col("source"), F.lit(0).cast("long").alias("prefix"), F.col("left"))
    for level in range(LEVELS):
        shift = DIGITS * (LEVELS - level - 1)
        inside = j.alias("d").join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source"))
                                   & (F.shiftright("d.bucket", shift + DIGITS) == F.col("e.prefix")))
        sums = inside.groupBy(F.col("d.source").alias("source"), F.col("e.left").alias("left"),
                              F.shiftright("d.bucket", shift).alias("b")).agg(F.sum("size").alias("words"))
        over = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.sum("words").over(over))
        # the first bucket whose running words reach what is left; beyond all words: after the last bucket
        edge = run.groupBy("source").agg(
            F.min(F.when(F.col("upto") >= F.col("left"), F.struct("b", (F.col("upto") - F.col("words")).alias("before")))
                  ).alias("hit"), F.max("b").alias("last"), F.max("upto").alias("all"), F.first("left").alias("left")
        ).select("source", F.coalesce(F.col("hit.b"), F.col("last") + 1).alias("prefix"),
                 (F.col("left") - F.coalesce(F.col("hit.before"), F.col("all"))).alias("left"))
        edge = written(spark, edge, f"edge{level}")
    e = edge.select(F.col("source").alias("es"), F.col("prefix").alias("cut"), F.col("left").alias("cut_left"))
    j = j.join(e, F.col("source").eqNullSafe(F.col("es")), "left").drop("es")
    near = j.filter(F.col("bucket") == F.col("cut"))
    order = Window.partitionBy("source").orderBy("rank", F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "row_no")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = near.withColumn("taken", (run - F.col("size") / 2.0 <= F.col("cut_left")).cast("int"))
    far = j.filter(F.col("bucket") != F.col("cut")).withColumn("taken", (F.col("bucket") < F.col("cut")).cast("int"))
    both = far.unionByName(near)
    # A document that is whole copies already at the limit takes no more.
    extra = F.when(F.col("wanted") > 0, F.col("taken")).otherwise(F.lit(0))
    return both.select("doc_id", "source", "size", "row_no", "source_size", "target",
                       F.least(F.col("whole") + extra, F.lit(MOST_COPIES)).alias("copies"))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return copies(spark, docs.select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_documents(spark: SparkSession, docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (rows taken 0 times go)."""
    row = fresh(docs, "mix_row")
    # Rows are numbered and written, so that every row, also one of several equal ones, gets its own copies back.
    digest = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    number = F.struct(digest.alias("digest"), F.monotonically_increasing_id().alias("at"))
    left = written(spark, docs.withColumn(row, number), "mix-rows")
    marked = copies(spark, left.select("doc_id", "source", "text", F.col(row).alias("row_no")), seed)
    m_row, n = (fresh(docs, f"mix_{x}") for x in ("at", "copies"))
    marked = marked.filter("copies > 0").select(F.col("row_no.at").alias(m_row), F.col("copies").alias(n))
    joined = left.join(marked, left[row]["at"] == marked[m_row])
    copy = fresh(docs, "mix_copy")
    return (joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select(*docs.columns))
