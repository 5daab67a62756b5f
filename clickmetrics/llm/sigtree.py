"""N-gram Jaccard join with signature trees.

A document's set holds the 64-bit hashes of its distinct SHINGLE-word shingles.  Two documents link
when 100 * intersection >= PERCENT * union.  Classes of equal sets are found first (one 128-bit
digest per set), so copies cost one row each and only class representatives are joined.

Bringing linked sets together.  Sets of at most SMALL shingles give their exact prefix (the
smallest |x| - ceil(0.75 |x|) + 1 hashes: two linked sets share one of them).  Sets of more than
SMALL_FROM shingles give BANDS keys; a key is the smallest hash of the shingles in each of two
bins.  Linked sets of Jaccard J agree in a band with probability J^2 or more, so a link at 0.75 is
missed by all 48 bands with probability 0.4375^48 < 1e-17.  The two ranges overlap so far that any two
linked sets share one of the schemes.

Joining.  Keys are taken in ROUNDS.  In each round the sets of one key form a group; groups whose
sets are one component already are dropped.  A group is joined in one task by signature trees: sets
are ordered by size and put into leaves of LEAF; every node holds the OR of its sets' token bitmaps
and its size range; pairs of nodes are walked together and dropped when the size ranges are too far
apart, when all their sets are connected already, or when the largest possible overlap (common
bits plus the shingles that bit collisions may hide) can't reach the threshold.  What is left is
verified on the exact sets.  A group gives the links that connect it (at most one less than its
sets), so a group of thousands of near copies never becomes pairs.  Groups of more than
GROUP sets are cut into blocks and joined block by block, so a task holds two blocks at most.

Components grow between rounds by min-label propagation with pointer jumping over written tables.

Edge cases: null and empty texts have an empty set, which links with nothing (component = own id, or
that of the id's other texts).
A text of 1 to 4 words has one shingle, its whole word sequence.  Rows with a null id link with
nothing and have a null component.  A repeated id is one node that has the links of
all its texts; a component's id is its smallest id.  Empty table: empty result.  Extra columns pass through :func:`one_per_group`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickmetrics.llm import words as W
from clickmetrics.llm.common import fresh, ship, text_blocks, written

SHINGLE = 5
PERCENT = 75
SMALL, SMALL_FROM = 56, 40  # 56 * 0.75 = 42 > 40: linked sets share a scheme
BANDS = 48
PER_BAND = 2
ROUNDS = (2, 8, BANDS)
GROUP = 2000
LEAF = 32
_EMPTY = np.uint64((1 << 64) - 1)


# ---- sets and keys ----------------------------------------------------------------------------

def shingle_sets(col):
    """The sorted distinct shingle hashes of every text of an Arrow column."""
    data, offsets = W.text_bytes(col)
    starts, ends, off = W.word_spans(data, offsets)
    words = W.span_hashes(data, starts, ends, W.LOWER_VALUE)
    grams = W.window_hashes(words, SHINGLE)
    whole = None
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a:b - SHINGLE + 1])
        elif b > a:
            if whole is None:
                whole = W.text_digests(words, off)[0]
            yield whole[np.searchsorted(off, a, side="right") - 1][None]
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def keys_of(s: np.ndarray) -> list[list[int]]:
    """Join keys of a set, by round (signed 64-bit numbers)."""
    rounds: list[np.ndarray] = [np.zeros(0, np.uint64) for _ in ROUNDS]
    n = len(s)
    if 0 < n <= SMALL:
        rounds[0] = W.mix(s[:prefix_length(n)] ^ np.uint64(0x1234567))
    if n > SMALL_FROM:
        bins = np.full(BANDS * PER_BAND, _EMPTY)
        at = ((s >> np.uint64(8)) % np.uint64(BANDS * PER_BAND)).astype(np.int64)
        bins[at[::-1]] = s[::-1]  # the smallest hash of a bin is written last
        two = bins.reshape(BANDS, PER_BAND)
        sig = W.mix(two[:, 0] * np.uint64(0x9E3779B97F4A7C15) + W.mix(two[:, 1] + np.arange(BANDS, dtype=np.uint64)))
        full = ~(two == _EMPTY).all(axis=1)
        lo = 0
        for i, hi in enumerate(ROUNDS):
            rounds[i] = np.concatenate([rounds[i], sig[lo:hi][full[lo:hi]]])
            lo = hi
    return [np.unique(r).astype(np.int64).tolist() for r in rounds]


def _sketch_task(batches):
    for block in text_blocks(batches, most=W.BLOCK):
        sizes, d1, d2 = [], [], []
        keys = [[] for _ in ROUNDS]
        for s in shingle_sets(block.column("text")):
            sizes.append(len(s))
            d1.append(int(W.mix(s).sum(dtype=np.uint64).astype(np.int64)))
            d2.append(int(W.mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
            for i, k in enumerate(keys_of(s)):
                keys[i].append(k)
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
             *[pa.array(k, pa.list_(pa.int64())) for k in keys]],
            ["doc_id", "n_shingles", "d1", "d2", *[f"keys{i}" for i in range(len(ROUNDS))]])


def _sets_task(batches):
    for block in text_blocks(batches, most=W.BLOCK):
        sets = [s.tobytes() for s in shingle_sets(block.column("text"))]
        yield pa.RecordBatch.from_arrays([block.column("rid"), pa.array(sets, pa.binary())], ["rid", "shingles"])


# ---- the join inside a group ------------------------------------------------------------------

class Links:
    """Components of the sets of a group (labels, relabelled on each union)."""

    def __init__(self, labels: np.ndarray):
        self.of = np.unique(labels, return_inverse=True)[1].reshape(-1)

    def join(self, a: int, b: int) -> None:
        self.of[self.of == self.of[b]] = self.of[a]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted distinct sets link."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


class SignatureTree:
    """Sets in order of size under nodes of OR-ed bitmaps, size ranges and collision slack."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray, bits: int):
        rows = rows[np.argsort([len(sets[r]) for r in rows], kind="stable")]
        self.rows = rows
        self.sizes = np.array([len(sets[r]) for r in rows])
        maps = np.zeros((len(rows), bits // 64), np.uint64)
        for i, r in enumerate(rows.tolist()):
            at = (sets[r] >> np.uint64(20)) & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.maps = maps
        self.slack = self.sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)  # shingles hidden by collisions
        self.root = self._node(0, len(rows))

    def _node(self, a: int, b: int):
        if b - a <= LEAF:
            kids = ()
            bitmap = np.bitwise_or.reduce(self.maps[a:b], axis=0)
        else:
            mid = (a + b) // 2
            kids = (self._node(a, mid), self._node(mid, b))
            bitmap = kids[0][3] | kids[1][3]
        return (a, b, kids, bitmap, int(self.sizes[a]), int(self.sizes[b - 1]), int(self.slack[a:b].max()))


def least_overlap(n):
    """The smallest intersection of two linked sets of ``n`` shingles together."""
    return -(-PERCENT * n // (100 + PERCENT))


def join_trees(left: SignatureTree, right: SignatureTree, sets: list[np.ndarray], links: Links, out: list) -> None:
    """Dual traversal: connects all linked sets of the two trees, adding the links used to ``out``."""
    same = left is right
    stack = [(left.root, right.root)]
    while stack:
        x, y = stack.pop()
        (a, b, kx, mx, lox, hix, sx), (c, d, ky, my, loy, hiy, sy) = x, y
        if 100 * hix < PERCENT * loy or 100 * hiy < PERCENT * lox:
            continue
        if int(np.bitwise_count(mx & my).sum()) + min(sx, sy) < least_overlap(lox + loy):
            continue
        lx, ly = links.of[left.rows[a:b]], links.of[right.rows[c:d]]
        if lx[0] == ly[0] and (lx == lx[0]).all() and (ly == ly[0]).all():
            continue
        if kx and (not ky or b - a >= d - c):
            if same and x is y:
                stack += [(kx[0], kx[1]), (kx[1], kx[1]), (kx[0], kx[0])]
            else:
                stack += [(k, y) for k in kx]
        elif ky:
            stack += [(x, k) for k in ky]
        else:
            n, m = left.sizes[a:b], right.sizes[c:d]
            both = np.bitwise_count(left.maps[a:b, None, :] & right.maps[None, c:d, :]).sum(axis=2, dtype=np.int64)
            both += np.minimum(left.slack[a:b, None], right.slack[None, c:d])
            total = n[:, None] + m[None, :]
            may = (both >= least_overlap(total)) & (lx[:, None] != ly[None, :])
            may &= 100 * np.minimum(n[:, None], m[None, :]) >= PERCENT * np.maximum(n[:, None], m[None, :])
            if same and a == c:
                may = np.triu(may, 1)
            for i, j in zip(*(v.tolist() for v in np.nonzero(may)), strict=True):
                p, q = int(left.rows[a + i]), int(right.rows[c + j])
                if links.of[p] != links.of[q] and linked(sets[p], sets[q]):
                    links.join(p, q)
                    out.append((p, q))


def join_group(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the linked sets of a group.  ``side`` 0/1 marks two blocks of a larger group,
    of which only pairs across are joined."""
    links, out = Links(comp), []
    if len(sets) <= 4 and side is None:
        for i in range(len(sets)):
            for j in range(i):
                if links.of[i] != links.of[j] and linked(sets[i], sets[j]):
                    links.join(i, j)
                    out.append((i, j))
        return out
    largest = max(len(s) for s in sets)
    bits = 1 << max(8, int(largest * 4 - 1).bit_length())
    rows = np.arange(len(sets))
    if side is None:
        tree = SignatureTree(sets, rows, bits)
        join_trees(tree, tree, sets, links, out)
    elif 0 < side.sum() < len(side):
        join_trees(SignatureTree(sets, rows[side == 0], bits), SignatureTree(sets, rows[side == 1], bits), sets, links, out)
    return out


def _group_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """One cell of groups (several groups share a Spark key, told apart by ``key``)."""
    a, b = [], []
    order = np.lexsort((pdf["rid"].to_numpy(), pdf["cell_j"].to_numpy(), pdf["cell_i"].to_numpy(), pdf["key"].to_numpy()))
    pdf = pdf.iloc[order]
    rid, comp, blk = pdf["rid"].to_numpy(), pdf["comp"].to_numpy(), pdf["blk"].to_numpy()
    cells = pdf[["key", "cell_i", "cell_j"]].to_numpy()
    raw = pdf["shingles"].to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)])) if len(pdf) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
        sets = [np.frombuffer(r, np.uint64) for r in raw[lo:hi]]
        i, j = cells[lo, 1], cells[lo, 2]
        side = None if i == j else (blk[lo:hi] == j).astype(int)
        for p, q in join_group(sets, comp[lo:hi], side):
            a.append(rid[lo + p])
            b.append(rid[lo + q])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


# ---- components -------------------------------------------------------------------------------

def grow(spark: SparkSession, comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, comp`` (only nodes whose component isn't themselves) after adding ``edges`` (a, b).

    Edges between components are contracted by label propagation with pointer jumping; only
    components that an edge touches move."""
    label = comp.select(F.col("node"), F.col("comp"))

    def lift(df, col):
        l = label.select(F.col("node").alias("n_"), F.col("comp").alias("c_"))
        return df.join(l, F.col(col) == F.col("n_"), "left").withColumn(col, F.coalesce("c_", col)).drop("n_", "c_")

    e = lift(lift(edges, "a"), "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(spark, e, "edges")
    moved = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # every node points to its smallest neighbour, if that is smaller; then to where that points, and so on
        point = written(spark, both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a"), "points")
        while True:
            nxt = point.select(F.col("a").alias("x"), F.col("b").alias("y"))
            jumped = point.join(nxt, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("to"), F.col("y").isNotNull().alias("more"))
            jumped = written(spark, jumped, "jumps")
            point = jumped.select("a", F.col("to").alias("b"))
            if jumped.filter("more").isEmpty():
                break
        if moved is None:
            moved = point
        else:
            nxt = point.select(F.col("a").alias("x"), F.col("b").alias("y"))
            lifted = moved.join(nxt, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"))
            moved = written(spark, lifted.union(point), "moved")
        m = point.select(F.col("a").alias("x"), F.col("b").alias("y"))

        def follow(df, col, m=m):
            return df.join(m, F.col(col) == F.col("x"), "left").withColumn(col, F.coalesce("y", col)).drop("x", "y")

        e = follow(follow(e, "a"), "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        e = written(spark, e, "edges")
    if moved is None:
        return label
    m = moved.select(F.col("a").alias("x"), F.col("b").alias("y"))
    old = label.join(m, F.col("comp") == F.col("x"), "left").select("node", F.coalesce("y", "comp").alias("comp"))
    new = moved.join(label, moved["a"] == label["node"], "left_anti").select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return written(spark, old.union(new), "components")


def tie_repeated(spark: SparkSession, sketch: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The components that repeated ids make of the classes of their texts, before any link, and the ids
    that have different sets (``repeated``; None if there are none)."""
    none = spark.createDataFrame([], "node long, comp long")
    what = ["n_shingles", "d1", "d2"]
    differ = F.lit(False)
    for c in what:
        differ = differ | (F.col(f"lo_{c}") != F.col(f"hi_{c}"))
    ends = [f(c).alias(f"{name}_{c}") for c in what for name, f in (("lo", F.min), ("hi", F.max))]
    ids = sketch.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("repeated")).agg(*ends)
    ids = written(spark, ids.filter(differ).select("repeated"), "repeated-ids")
    if ids.isEmpty():
        return none, None
    mine = sketch.join(ids, F.col("doc_id") == F.col("repeated"), "left_semi").filter("n_shingles > 0")
    mine = written(spark, mine.select("doc_id", *what).distinct(), "repeated-sets")
    edges = mine.join(reps.select("rid", *what), what).select(F.col("doc_id").alias("a"), F.col("rid").alias("b"))
    return grow(spark, none, written(spark, edges, "repeated-links")), ids


def link_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, component_id`` for every row of ``docs`` (``doc_id`` long, ``text``)."""
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, d1 long, d2 long, " + ", ".join(f"keys{i} array<long>" for i in range(len(ROUNDS)))
    sketch = written(spark, rows.mapInArrow(_sketch_task, schema), "sketches")
    full = sketch.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # One representative per distinct set: the row of the smallest id.
    reps = written(spark, full.groupBy("n_shingles", "d1", "d2").agg(
        F.min("doc_id").alias("rid"), *[F.first(f"keys{i}").alias(f"keys{i}") for i in range(len(ROUNDS))]), "classes")
    # A repeated id may stand for several sets: the id is the node, its sets are joined one by one.
    comp, tied = tie_repeated(spark, sketch, reps)
    members = written(spark, reps.select("rid", "d1", F.explode(F.concat(*[F.transform(f"keys{i}", lambda k, i=i: F.struct(
        F.lit(i).alias("round"), k.alias("key"))) for i in range(len(ROUNDS))])).alias("k")).select("rid", "d1", "k.round", "k.key"), "members")
    shared = members.groupBy("round", "key").agg(F.count("*").alias("n")).filter("n > 1").select("round", "key")
    # Written, so that the join below is between two plain shuffles, whose skew Spark can split.
    shared = written(spark, shared, "shared-keys")
    members = written(spark, members.join(shared, ["round", "key"], "left_semi"), "shared-members")
    wanted = members.select("rid").distinct()
    have = rows.join(wanted, rows["doc_id"] == wanted["rid"]).select("rid", "text")
    # Whole sets, only for sets that share a key.
    sets = written(spark, have.mapInArrow(_sets_task, "rid long, shingles binary").distinct(), "sets")
    for i in range(len(ROUNDS)):
        mine = members.filter(F.col("round") == i).select("rid", "key").distinct()
        c = comp.select(F.col("node").alias("n_"), F.col("comp").alias("c_"))
        mine = mine.join(c, F.col("rid") == F.col("n_"), "left").select("rid", "key", F.coalesce("c_", "rid").alias("comp"))
        mine = written(spark, mine, f"round{i}")
        open_keys = (mine.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                     .filter("lo < hi").select("key", "n", F.ceil(F.col("n") / F.lit(float(GROUP))).cast("int").alias("blocks")))
        open_keys = written(spark, open_keys, f"open{i}")
        todo = mine.join(open_keys.drop("n"), "key").withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        # A large group is joined block by block: a set meets every block of its group.
        todo = todo.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "rid", "key", "comp", "blk", F.least("blk", "other").alias("cell_i"), F.greatest("blk", "other").alias("cell_j"))
        todo = todo.join(sets, "rid")
        # Small groups share a task group; the cells of large ones spread.
        moved = open_keys.agg(F.sum(F.col("n") * F.col("blocks")).alias("n")).first()["n"] or 0
        n_cells = F.lit(max(64, moved // GROUP))
        todo = todo.withColumn("slot", F.pmod(F.xxhash64("key", "cell_i", "cell_j"), n_cells))
        edges = todo.groupBy("slot").applyInPandas(_group_task, "a long, b long")
        comp = grow(spark, comp, written(spark, edges, f"links{i}"))
    ids = reps.select(F.col("n_shingles").alias("n_"), F.col("d1").alias("x1"), F.col("d2").alias("x2"), "rid")
    ids = ids.join(comp, F.col("rid") == F.col("node"), "left").select(
        "n_", "x1", "x2", F.coalesce("comp", "rid").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "d1", "d2").join(
        ids, (F.col("n_shingles") == F.col("n_")) & (F.col("d1") == F.col("x1")) & (F.col("d2") == F.col("x2")), "left")
    if tied is not None:
        # An empty text has no class: it takes the component of its id.
        nodes = tied.join(comp, F.col("repeated") == F.col("node")).select("repeated", F.col("comp").alias("of_id"))
        out = out.join(written(spark, nodes, "repeated-components"),
                       (F.col("doc_id") == F.col("repeated")) & (F.col("n_shingles") == 0), "left")
        out = out.withColumn("component", F.coalesce("component", "of_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "d1", "d2", own.alias("component_id"))


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return link_components(spark, docs).select("doc_id", "n_shingles", "component_id")


def one_per_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row per component: the one of the smallest id.  Rows that link with nothing
    stay, and so do rows with a null id."""
    keep = link_components(spark, docs).filter(F.col("doc_id") == F.col("component_id"))
    own = fresh(docs, "near_id")
    keep = keep.select(F.col("doc_id").alias(own)).distinct()
    left = docs.join(keep, docs["doc_id"].cast("long") == keep[own], "left_semi")
    # Repeated rows of one id are copies of each other: the first in order of text stays.
    nth = fresh(docs, "near_nth")
    w = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = left.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) == 1).drop(nth)
    # Rows with a null id aren't numbered, or they would all be one group of the window.
    return first.union(docs.filter(F.col("doc_id").isNull()))
