"""Substring dedup by recompression.

Parsing.  A text's words are symbols (64-bit hashes).  A level first names runs of equal symbols
(symbol, length), then splits all symbols into a left and a right class by a hash bit of the level
and names every adjacent (left, right) pair.  Names are hashes of what they stand for, so equal
substrings get equal names everywhere without a shared table.  Whether a symbol stands in a parse
depends only on a few words around it; that span is tracked, so the symbols that a window alone
determines are known, and equal windows have the same ones.

Finding.  The anchor of a window of WINDOW words is the longest symbol that it determines (ties: the
smallest name), at level LEVELS, or at a lower level if there is none.  Equal windows have equal
anchors, so a window can only repeat if its anchor occurs in another document.  Spark counts the
documents of every anchor, and only windows with a shared anchor (or with none at all, as inside
long runs) are verified.

Verifying.  Those windows are grouped by a 128-bit hash of their words; the smallest document id of
a group is its first place, and later ones lose the window's words.

Documents with equal word sequences are one class: all but the smallest id lose everything (from
WINDOW words on), and only one text per class is parsed.

Edge cases: null and empty texts have no words and lose none; so do texts under WINDOW words.  Rows
with a null id neither lose words nor count as a first place.  Rows with equal ids don't remove
each other's words, and each keeps its own text's result.  Empty table: empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.llm import words as W
from clickmetrics.llm.common import ship, text_blocks, written

WINDOW = 50
LEVELS = 5
FALLBACK = 2
_FAR = np.int64(1) << np.int64(40)
_NONE = np.uint64((1 << 64) - 1)


def parse(words: np.ndarray, off: np.ndarray):
    """The parses of many texts at once: for every level ``(name, length, left, right)``.

    ``left``/``right`` bound the words that determine the symbol (beyond a text's edge: far away)."""
    name = words
    n = len(words)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start, stop = np.arange(n), np.arange(1, n + 1)
    left, right = start.copy(), stop.copy()
    for level in range(LEVELS):
        # runs
        edge = np.ones(len(name) + 1, bool)
        edge[1:-1] = owner[1:] != owner[:-1]
        cut = edge.copy()
        cut[1:-1] |= name[1:] != name[:-1]
        first = np.flatnonzero(cut[:-1])
        last = np.append(first[1:], len(name)) - 1
        size = last - first + 1
        l_new = np.where(edge[first], -_FAR, left[np.maximum(first - 1, 0)])
        r_new = np.where(edge[last + 1], _FAR, right[np.minimum(last + 1, len(name) - 1)])
        run = W.mix(name[first] * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
        name = np.where(size > 1, run, name[first])
        start, stop, owner, left, right = start[first], stop[last], owner[first], l_new, r_new
        # pairs
        k = len(name)
        is_left = (W.mix(name + np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))) & np.uint64(1)) == 0
        edge = np.ones(k + 1, bool)
        edge[1:-1] = owner[1:] != owner[:-1]
        opens = np.zeros(k, bool)
        opens[:-1] = is_left[:-1] & ~is_left[1:] & ~edge[1:-1]
        closes = np.zeros(k, bool)
        closes[1:] = opens[:-1]
        head = np.flatnonzero(~closes)
        tail = head + opens[head]
        pair = W.mix(name[head] * np.uint64(0xD6E8FEB86659FD93) + W.mix(name[tail] + np.uint64(level)))
        # An unpaired symbol is single because of its neighbour on the side where a partner could be.
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, k - 1)
        alone = ~opens[head]
        l_new = np.where(alone & ~is_left[head], np.where(edge[head], -_FAR, left[before]), left[head])
        r_new = np.where(alone & is_left[head], np.where(edge[tail + 1], _FAR, right[after]), right[tail])
        name = np.where(opens[head], pair, name[head])
        start, stop, owner = start[head], stop[tail], owner[head]
        left, right = np.minimum(l_new, left[head]), np.maximum(r_new, right[tail])
        yield name, stop - start, left, right


def _least(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key of every range [a, b); _NONE for empty ranges (sparse table)."""
    out = np.full(len(a), _NONE)
    some = np.flatnonzero(b > a)
    if not len(some):
        return out
    lo, hi = a[some], b[some]
    depth = np.int64(0) + np.floor(np.log2(hi - lo)).astype(np.int64)
    best, table = np.full(len(some), _NONE), keys
    for d in range(int(depth.max()) + 1):
        here = depth == d
        x, y = lo[here], hi[here] - (1 << d)
        best[here] = np.minimum(table[x], table[y])
        step = 1 << d
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
    out[some] = best
    return out


def anchors(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every whole window of the texts, and its anchor (_NONE if it has none)."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n - WINDOW + 1] == owner[WINDOW - 1:])
    out = np.full(len(at), _NONE)
    for level, (name, length, left, right) in enumerate(parse(words, off), 1):
        if level not in (LEVELS, FALLBACK):
            continue
        # longest first, then by name; the top bits hold the length
        key = ((np.uint64(63) - np.minimum(length, 62).astype(np.uint64)) << np.uint64(58)) | (W.mix(name) >> np.uint64(6))
        # Bounds grow along a text but for edges: order symbols by their place in the whole block.
        lo = np.maximum.accumulate(np.where(left < 0, 0, left))
        hi = np.minimum.accumulate(np.where(right >= _FAR, n + WINDOW, right)[::-1])[::-1]
        key = np.where((left < 0) | (right >= _FAR), _NONE, key)
        a, b = np.searchsorted(lo, at), np.searchsorted(hi, at + WINDOW, side="right")
        found = _least(key, a, np.maximum(b, a))
        out = np.where(found != _NONE, found, out) if level == LEVELS else found
    return at, out


def _scan_task(batches):
    """First pass: digests, the hash of the whole text's words, and the anchors of every text."""
    for block in text_blocks(batches, most=W.BLOCK):
        data, offsets = W.text_bytes(block.column("text"))
        starts, ends, off = W.word_spans(data, offsets)
        words = W.span_hashes(data, starts, ends)
        d1, d2 = W.text_digests(words, off)
        at, found = anchors(words, off)
        cut = np.searchsorted(at, off)
        names, bare, sha = [], [], []
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            own = np.unique(found[a:b])
            bare.append(bool(len(own) and own[-1] == _NONE))
            names.append(own[own != _NONE].astype(np.int64))
            sha.append(hashlib.sha256(b" ".join(raw[offsets[i]:offsets[i + 1]].split())).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(np.diff(off)), pa.array(d1.astype(np.int64)), pa.array(d2.astype(np.int64)),
             pa.array(sha, pa.string()), pa.array(bare, pa.bool_()), pa.array(names, pa.list_(pa.int64()))],
            ["doc_id", "n_words", "d1", "d2", "whole_sha256", "bare", "anchors"])


def _windows_task(batches):
    """Second pass: the windows whose anchor is shared, or that have none."""
    for block in text_blocks(batches, most=W.BLOCK):
        data, offsets = W.text_bytes(block.column("text"))
        starts, ends, off = W.word_spans(data, offsets)
        words = W.span_hashes(data, starts, ends)
        d1, d2 = W.text_digests(words, off)
        at, found = anchors(words, off)
        cut = np.searchsorted(at, off)
        h1, h2 = W.window_hashes(words, WINDOW), W.window_hashes(words, WINDOW, second=True)
        shared = block.column("shared").to_pylist()
        keep, doc = [], []
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if block.column("d1")[i].as_py() != int(d1[i].astype(np.int64)) or block.column("d2")[i].as_py() != int(d2[i].astype(np.int64)):
                continue  # another text of a repeated id
            own = found[a:b]
            few = np.array(shared[i] or [], np.int64).astype(np.uint64)
            hit = np.flatnonzero((own == _NONE) | np.isin(own, few)) + a
            keep.append(at[hit])
            doc.append(np.full(len(hit), i))
        pos = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        rid = block.column("rid").to_numpy()[doc]
        yield pa.RecordBatch.from_arrays(
            [pa.array(h1[pos].astype(np.int64)), pa.array((h2[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
             pa.array(rid), pa.array(d1[doc].astype(np.int64)), pa.array((pos - off[doc]).astype(np.int32))],
            ["h1", "h2", "rid", "d1", "start"])


def _cut_task(batches):
    """Texts without the words of their removed windows."""
    for block in text_blocks(batches, most=W.BLOCK):
        removed, sha = [], []
        for text, starts in zip(block.column("text").to_pylist(), block.column("starts").to_pylist(), strict=True):
            words = text.encode().split()
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, starts, 1)
            np.add.at(steps, np.array(starts) + WINDOW, -1)
            gone = np.cumsum(steps[:-1]) > 0
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
        yield pa.RecordBatch.from_arrays([block.column("rid"), block.column("d1"), block.column("d2"),
                                          pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                                         ["rid", "d1", "d2", "n_removed", "kept_sha256"])


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs`` (``doc_id`` long, ``text``)."""
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = written(spark, rows.mapInArrow(_scan_task, "doc_id long, n_words long, d1 long, d2 long, whole_sha256 string, "
                                          "bare boolean, anchors array<long>"), "scan")
    long = scan.filter((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    classes = written(spark, long.groupBy("n_words", "d1", "d2").agg(
        F.min("doc_id").alias("rid"), F.first("bare").alias("bare"), F.first("anchors").alias("anchors")), "classes")
    found = classes.select("rid", "d1", "d2", F.explode("anchors").alias("anchor"))
    shared = found.groupBy("anchor").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo < hi").select("anchor")
    # Written, so that the join is between two plain shuffles, whose skew Spark can split.
    shared = written(spark, shared, "shared-anchors")
    lists = found.join(shared, "anchor", "left_semi").groupBy("rid", "d1", "d2").agg(F.collect_list("anchor").alias("shared"))
    bare = classes.filter("bare").select("rid", "d1", "d2", F.lit(None).cast("array<long>").alias("shared"))
    wanted = lists.union(bare).groupBy("rid", "d1", "d2").agg(F.first("shared", ignorenulls=True).alias("shared"))
    wanted = written(spark, wanted, "wanted")
    # The texts of candidate documents only (a repeated id brings all its texts; the tasks tell them apart).
    texts = written(spark, rows.join(wanted, rows["doc_id"] == wanted["rid"]).select("rid", "d1", "d2", "shared", "text"), "candidates")
    windows = written(spark, texts.mapInArrow(_windows_task, "h1 long, h2 int, rid long, d1 long, start int"), "windows")
    firsts = (windows.groupBy("h1", "h2").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo < hi")
              .select("h1", "h2", "lo"))
    firsts = written(spark, firsts, "firsts")
    later = windows.join(firsts, ["h1", "h2"]).filter(F.col("rid") > F.col("lo"))
    starts = later.groupBy("rid", "d1").agg(F.collect_set("start").alias("starts")).select(
        F.col("rid").alias("r_"), F.col("d1").alias("x_"), "starts")
    cut = texts.join(starts, (F.col("rid") == F.col("r_")) & (F.col("d1") == F.col("x_"))).select("rid", "d1", "d2", "starts", "text")
    cut = written(spark, cut.mapInArrow(_cut_task, "rid long, d1 long, d2 long, n_removed long, kept_sha256 string"), "cut")
    done = cut.select(F.col("rid").alias("r_"), F.col("d1").alias("x1"), F.col("d2").alias("x2"), "n_removed", "kept_sha256")
    per = classes.select("n_words", "d1", "d2", "rid").join(
        done, (F.col("rid") == F.col("r_")) & (F.col("d1") == F.col("x1")) & (F.col("d2") == F.col("x2")), "left").select(
        F.col("n_words").alias("n_"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "rid", "n_removed", "kept_sha256")
    out = scan.select("doc_id", "n_words", "d1", "d2", "whole_sha256").join(
        per, (F.col("n_words") == F.col("n_")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("rid"), F.lit(False))  # a later copy of a whole text
    mine = F.coalesce(F.col("doc_id") == F.col("rid"), F.lit(False)) & F.col("n_removed").isNotNull()
    return out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(mine, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).when(mine, F.col("kept_sha256")).otherwise(F.col("whole_sha256")).alias("kept_sha256"))


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup(spark, docs)
