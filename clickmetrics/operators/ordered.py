"""Next value and dense rank inside a key without a window over the key.

Rows are range-partitioned by (key, order, tie) and sorted, so a key or a pile of equal rows that
holds a third of the data spreads over as many partitions as its share, and neighbours in order are
neighbours in a partition.  One pass over each sorted partition (Arrow batches, numpy) gives every row

* its dense rank among the partition's rows of its key, and
* the next strictly larger order value of its key,

and one *edge* row per partition: the first and last key, with their first two, last and number of
distinct order values.  Only two things of a partition depend on others: the ranks of its first key
need the number of that key's values before, and its last group of equal rows needs the value after.  Both
come from the edge rows of all partitions, at most one per partition (a few thousand), through
windows over those rows alone; they go back to the rows by a broadcast of three rows per partition, found by
key and value (not by a partition number, which a plan around this one may shift).

The rows move in one exchange.  Edge rows and rows are two branches over that exchange; its explicit
number of partitions keeps adaptive coalescing from dealing them out differently, and
``spark.sql.exchange.reuse`` must be on, so that both branches read the same partitions.

NULL order values come first and count as one value in ranks (as in the reference's dialect); they have no next
value and are nobody's next value.  Rows whose key is NULL form one key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clickmetrics.session import ship

RANK, NEXT = "_rank", "_next"


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the row before it (NULLs are equal to each other); the first row is left out."""
    out = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            same = same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
        out |= ~same
    return out


class _Pass:
    """Ranks and next values of one sorted partition, a table at a time; each table starts a new group."""

    def __init__(self, keys: list[str], order: str, names: list[str]):
        self.keys, self.order, self.names = keys, order, names
        self.key, self.rank = None, 0      # key and rank of the last group given out
        self.first = None                  # order value of the partition's first row
        self.head_open = True              # still in the partition's first key
        self.ends: dict[str, list | None] = {"head": None, "tail": None}  # key, first, second, last, distinct

    def _see(self, key: tuple, values: list, fresh: bool, head: bool) -> None:
        """Note the next distinct order values of a key (``fresh``: its first ones)."""
        for end in ("head", "tail") if head else ("tail",):
            if fresh:
                self.ends[end] = [key, values[0], values[1] if len(values) > 1 else None, values[-1], len(values)]
            else:
                e = self.ends[end]
                if e[4] == 1:
                    e[2] = values[0]
                e[3], e[4] = values[-1], e[4] + len(values)

    def rows(self, table: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        """All groups of ``table`` but the last (all of them with ``last``) with their new columns."""
        key_cols, order = [table.column(k) for k in self.keys], table.column(self.order)
        n = table.num_rows
        new_key = np.ones(n, bool)
        new_key[1:] = _changes(key_cols)
        first = tuple(c[0].as_py() for c in key_cols)
        new_key[0] = self.key is None or self.key != first
        new_group = new_key.copy()
        new_group[1:] |= _changes([order])
        new_group[0] = True
        at = np.flatnonzero(new_group)     # first row of every group
        keyed = new_key[at]
        number = np.arange(len(at))
        begun = np.maximum.accumulate(np.where(keyed, number, -1))
        rank = np.where(begun >= 0, number - begun + 1, self.rank + number + 1)
        following = np.append(at[1:], -1)
        none = np.append(keyed[1:], True) | order.is_null().to_numpy(zero_copy_only=False)[at]
        following = pa.array(following, mask=none)
        done = len(at) if last else len(at) - 1
        stop = n if last else int(at[-1])

        # What the edge row needs: the distinct values of each key that begins or goes on here.
        turns = np.flatnonzero(keyed[:done])
        head = self.head_open and not len(turns[turns > 0]) and not (self.key is not None and len(turns))
        spans = [(0, turns[0])] if len(turns) and turns[0] > 0 else [] if len(turns) else [(0, done)]
        spans = [s for s in spans if s[1] > s[0]]
        heads = np.zeros(done, bool)
        if spans:                          # the key of before goes on
            self._see(self.key, order.take(pa.array(at[:spans[0][1]])).to_pylist(), False, self.head_open)
            heads[:spans[0][1]] = self.head_open
        for k in range(len(turns)):
            a, b = int(turns[k]), int(turns[k + 1]) if k + 1 < len(turns) else done
            is_head = self.head_open and self.ends["head"] is None
            if is_head or k == len(turns) - 1:
                key = tuple(c[int(at[a])].as_py() for c in key_cols)
                self._see(key, order.take(pa.array(at[a:b])).to_pylist(), True, is_head)
            if is_head:
                heads[a:b] = True
            else:
                self.head_open = False
        if done:
            self.key, self.rank = tuple(c[int(at[done - 1])].as_py() for c in key_cols), int(rank[done - 1])
        lens = np.diff(np.append(at[:done], stop))
        group = np.repeat(np.arange(done), lens)
        tail = np.zeros(stop, bool)
        if last:
            tail[at[-1]:] = order[n - 1].is_valid
        cols = [table.column(c).slice(0, stop) for c in self.names]
        if self.first is None:
            self.first = order.slice(0, 1)
        return cols + [pa.array(rank[:done][group]), order.take(following.slice(0, done)).take(pa.array(group)),
                       pa.array(heads[group]), self.first.take(pa.array(np.zeros(stop, np.int64))), pa.array(tail)]


def _scan(keys: list[str], order: str, names: list[str], schema: pa.Schema):
    def run(batches):
        state = _Pass(keys, order, names)
        held: list[pa.RecordBatch] = []    # the last group so far: it ends when a later row is seen

        def out(cols):
            return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), schema.field("_edge").type)], schema=schema)

        def joined():
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1), batch.slice(batch.num_rows - 1)])
                if not _changes([seam.column(c).combine_chunks() for c in (*keys, order)]).any():
                    held.append(batch)     # all of it belongs to the group that is held
                    continue
            held.append(batch)
            table = joined()
            cols = state.rows(table, last=False)
            if len(cols[0]):
                yield out(cols)
            held = [table.slice(len(cols[0]))]
        if held:
            yield out(state.rows(joined(), last=True))
            edge = {}
            for end, (key, first, second, final, distinct) in state.ends.items():
                edge |= {f"{end}_key": dict(zip(keys, key, strict=True)), f"{end}_first": first, f"{end}_second": second,
                         f"{end}_last": final, f"{end}_distinct": distinct}
            yield pa.RecordBatch.from_pylist([{"_edge": edge}], schema)
    return run


# The rows with what their partition owes the others.  ``{scanned}`` stands for rows and edge rows of the pass,
# ``{{..}}`` parts are filled with column names.  One statement, so that the plan is analysed once.
#
# Edge rows, at most one per partition, are put in order in one task: their values are in the order of the
# partitions.  ``own``: distinct values of the last key, without the one that the next partition counts again;
# ``upto``: their sum along the partitions that the key fills.  ``offer``: first key and first two values of a
# partition that holds more than the group before it.  Partitions that begin or end with one and the
# same group give the same number before and value after, so the grouping by ``end_id`` loses nothing.
_STATEMENT = """
WITH edges AS (SELECT _edge.* FROM {scanned} WHERE _edge IS NOT NULL),
near AS (
  SELECT *, head_key <=> tail_key AS whole,
         lag(true, 1, false) OVER w AND head_key <=> lag(tail_key) OVER w AS goes_on,
         head_distinct = 1 AND head_first <=> lag(tail_last) OVER w AS one_group,
         tail_distinct - int(lead(true, 1, false) OVER w AND lead(head_key) OVER w <=> tail_key
                             AND lead(head_first) OVER w <=> tail_last) AS own
  FROM edges WINDOW w AS (ORDER BY head_key, head_first, tail_key, tail_last)
),
counted AS (
  SELECT *, sum(own) OVER w AS summed, IF(goes_on AND whole AND one_group, NULL, struct(head_key, head_first, head_second)) AS offer
  FROM near WINDOW w AS (ORDER BY head_key, head_first, tail_key, tail_last ROWS UNBOUNDED PRECEDING)
),
run AS (
  SELECT *, summed - last(IF(goes_on AND whole, NULL, summed - own), true) OVER w AS upto
  FROM counted WINDOW w AS (ORDER BY head_key, head_first, tail_key, tail_last ROWS UNBOUNDED PRECEDING)
),
owed AS (
  SELECT head_key, head_first, tail_key, tail_last,
         IF(goes_on, lag(upto) OVER (ORDER BY head_key, head_first, tail_key, tail_last), 0) AS before,
         first(offer, true) OVER (ORDER BY head_key, head_first, tail_key, tail_last
                                  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS offer
  FROM run
),
ends AS (
  SELECT before, IF(offer.head_key <=> tail_key, IF(offer.head_first <=> tail_last, offer.head_second, offer.head_first), NULL) AS after,
         explode(array(struct(1 AS end, head_key AS key, head_first AS first, IF(true, NULL, tail_last) AS last),
                       struct(2 AS end, tail_key AS key, IF(true, NULL, head_first) AS first, tail_last AS last),
                       struct(3 AS end, tail_key AS key, head_first AS first, tail_last AS last))) AS end_id
  FROM owed
),
carry AS (SELECT end_id, max(before) AS before, max(after) AS after FROM ends GROUP BY end_id),
hits AS (
  SELECT *, IF(_head OR _tail, struct(int(_head) + 2 * int(_tail) AS end, struct({{keys}}) AS key, IF(_head, _first, NULL) AS first,
                                      IF(_tail, {{order}}, NULL) AS last), NULL) AS _id
  FROM {scanned} WHERE _edge IS NULL
)
SELECT /*+ BROADCAST(carry) */ {{names}}, _rank + IF(_head, carry.before, 0) AS _rank, IF(_tail, carry.after, _next) AS _next
FROM hits LEFT JOIN carry ON hits._id = carry.end_id
"""


def _quoted(names: Sequence[str], table: str = "") -> str:
    return ", ".join(table + "`" + n.replace("`", "``").replace("{", "{{").replace("}", "}}") + "`" for n in names)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = (),
                 partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, by default all) with ``_rank`` (``DENSE_RANK() OVER (PARTITION BY keys ORDER BY order)``, NULLs first) and ``_next``
    (the smallest strictly larger ``order`` of the same keys).

    ``tie`` names columns that tell rows of equal key and order apart, so that many of them spread over
    partitions; rows that are equal in these too stay together.  ``partitions``: by default
    ``spark.sql.shuffle.partitions``."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.exchange.reuse") != "true":
        raise ValueError("ordered_scan needs spark.sql.exchange.reuse")
    keys, names = list(keys), list(keep or df.columns)
    kept = df.select(*names).schema
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[order].dataType
    key_type = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys])
    ends = []
    for end in ("head", "tail"):
        ends += [T.StructField(f"{end}_key", key_type), *[T.StructField(f"{end}_{c}", kind) for c in ("first", "second", "last")],
                 T.StructField(f"{end}_distinct", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [
        T.StructField(RANK, T.LongType()), T.StructField(NEXT, kind), T.StructField("_head", T.BooleanType()),
        T.StructField("_first", kind), T.StructField("_tail", T.BooleanType()), T.StructField("_edge", T.StructType(ends))])

    ship(spark)
    sorted_rows = df.repartitionByRange(n, *keys, order, *tie).select(*names).sortWithinPartitions(*keys, order)
    scanned = sorted_rows.mapInArrow(_scan(keys, order, names, to_arrow_schema(schema)), schema)
    statement = _STATEMENT.replace("{{keys}}", _quoted(keys)).replace("{{order}}", _quoted([order])).replace("{{names}}", _quoted(names, "hits."))
    return spark.sql(statement, scanned=scanned)
