"""Line dedup: compressed per-document keep bitmaps from a range-partitioned stream of line hashes.

1. Every line with a long enough key gives one narrow row (document, position, key hash).
2. Those rows are range-partitioned and sorted by (hash, document, position).  The range key
   includes the document, so the rows of one very frequent line spread over many partitions.
   The sorted stream is walked once and only the first occurrence of a line in each document
   is kept.
3. First occurrences are counted per hash (partial counts before the shuffle).
4. Rows of frequent hashes are OR-ed into 64-bit words per document: a sparse bitmap of dropped
   positions (a word that is absent means 64 kept lines).  The bitmaps are the result; texts are
   cut only where somebody asks for them.

Only DataFrame functions are used.

Edge cases: a null or empty text is one empty line (never dropped for ``min_chars >= 1``).  Rows
with a null ``doc_id`` count as one document.  Repeated rows (same id and text) share one bitmap
and count once; rows with the same id and different texts are one document for counting and keep
their own bitmaps.  An empty table gives an empty result.  Extra columns pass through
:func:`drop_lines` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickmetrics.llm.common import SPACES, ascii_lower, fresh, written

MIN_DOCS = 10
MIN_CHARS = 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def stripped(line: Column) -> Column:
    """White space stripped at both ends.

    ``btrim`` fills arrays as long as the line, so only lines with white space at an end go through it."""
    edge = F.substring(line, 1, 1).isin(*SPACES) | F.substring(line, -1, 1).isin(*SPACES)
    return F.when(edge, F.btrim(line, F.lit(SPACES))).otherwise(line)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased.

    ``translate`` makes an object of every character, so only lines with characters beyond ASCII
    go through it; of the others ``lower`` changes A-Z alone."""
    bare = stripped(line)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS,
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document (id and text hash) that loses lines.

    Columns: ``doc_id, text_hash, n_dropped, dropped`` where ``dropped`` maps the number of a
    64-line word to its bits (bit i of word w: line 64 w + i is dropped).
    """
    lines = (docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"),
                         F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
             # The key is as long as the stripped line; asked of the key, each key would be made twice.
             .filter(F.char_length(stripped(F.col("line"))) >= min_chars)
             .select("doc_id", "text_hash", "pos", F.unhex(F.md5(line_key(F.col("line")))).alias("h")))
    lines = written(spark, lines, "lines")
    stream = lines.repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id", "text_hash", "pos")
    in_doc = Window.partitionBy("h", "doc_id").orderBy("text_hash", "pos")
    firsts = stream.withColumn("nth", F.row_number().over(in_doc)).filter("nth = 1")
    frequent = firsts.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h")
    # Written, so that the join below is between two plain shuffles, whose skew Spark can split.  These are few
    # rows of many shuffle partitions: one file for each core, not for each partition.
    frequent = written(spark, frequent.repartition(spark.sparkContext.defaultParallelism), "frequent-lines")
    words = (lines.join(frequent, "h", "left_semi")
             .groupBy("doc_id", "text_hash", F.expr("cast(pos div 64 as int)").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits")))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def drop_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
               n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with the dropped lines cut from ``text`` (a null text stays null); the named count
    columns are added where asked for."""
    h, drops, number = (fresh(docs, f"line_dedup_{x}") for x in ("hash", "dropped", "n"))
    own = fresh(docs, "line_dedup_id")
    marks = keep_bitmaps(spark, docs, min_docs, min_chars).select(
        F.col("doc_id").alias(own), F.col("text_hash").alias(h), F.col("n_dropped").alias(number),
        F.col("dropped").alias(drops))
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks[own]) & (text_hash(docs["text"]) == marks[h]), "left")
    lines = lines_of(F.col("text"))
    # The bitmap as a dense array of words, so that each line is one array access.
    dense = F.transform(F.sequence(F.lit(0), F.expr("cast((size(split(text, '\\n')) - 1) div 64 as int)")),
                        lambda w: F.coalesce(F.try_element_at(F.col(drops), w), F.lit(0).cast("long")))
    # Bound by an outer lambda: as a column, Spark would inline the array and make it anew for every line.
    kept = F.transform(F.array(dense), lambda words: F.array_join(F.filter(
        lines, lambda _, i: F.get(words, F.floor(i / 64).cast("int")).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) == 0), "\n"))[0]
    out = {c: F.col(c) for c in docs.columns}
    out["text"] = F.when(F.col(drops).isNull(), F.col("text")).otherwise(kept)
    cols = [v.alias(c) for c, v in out.items()]
    if n_lines:
        cols.append(F.size(lines).cast("long").alias(n_lines))
    if n_dropped:
        cols.append(F.coalesce(F.col(number), F.lit(0).cast("long")).alias(n_dropped))
    return joined.select(*cols)


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digest per document: line counts and the hash of the kept text."""
    cut = drop_lines(spark, docs.select("doc_id", "text"), n_lines="n_lines", n_dropped="n_dropped")
    return cut.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
),
m AS (
  SELECT k.*, f.key IS NOT NULL AS hit FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
