"""Semi joins whose keys reach the scan of the large side as a bit vector (FL-6, JN-8).

``big`` semi-joined with the keys of a campaign normally moves all its rows (or all its partial
aggregates) to their key and drops most of them there.  :func:`bit_filter` drops them before the
first exchange: the keys are hashed to bits, 64 to a word, by one map-side-combined ``bit_or``; the
words are broadcast, and a row of ``big`` stays if its key's bit is set.  Rows without a partner may
stay (two keys can share a bit), none with one goes, so an exact semi join has to follow.

The broadcast is bounded by :data:`WORDS` rows of two longs whatever the number of keys.  Of ``n``
keys and ``64 * WORDS`` bits a foreign row stays with probability ``1 - exp(-n / bits)``: 6% at a
million keys, 45% at ten million; with many more the filter passes everything and costs one probe a
row.  ``words`` is a parameter for clusters whose executors can hold more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmetrics.operators.joins import skew_join

# 2**18 words: 16.8 million bits, about 12 MB as a broadcast relation.
WORDS = 1 << 18
# Types whose equal values have equal hashes on both sides of a join.
HASHED = ("tinyint", "smallint", "int", "bigint", "string", "date", "timestamp", "timestamp_ntz")


def _place(key: str, words: int) -> tuple[Column, Column]:
    """The word of a key and the bit in it."""
    h = F.xxhash64(F.col(key))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    return F.pmod(F.shiftright(h, 6), F.lit(words)), bit


def _fresh(name: str, *frames: DataFrame) -> str:
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name


def key_bits(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """``(_word, _mask)``: the bits that the non-null keys set, at most ``words`` rows."""
    word, bit = _place(key, words)
    return keys.where(F.col(key).isNotNull()).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_mask"))


def bit_filter(big: DataFrame, keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """``big`` without most rows whose ``key`` isn't in ``keys`` (and without null keys).

    Keys of two types, or of a type whose equal values may hash apart, are left to the join that
    follows: ``big`` comes back as it is."""
    kind = dict(big.dtypes)[key]
    if kind not in HASHED or dict(keys.dtypes)[key] != kind:
        return big
    w, m = _fresh("_word", big), _fresh("_mask", big)
    bits = key_bits(keys, key, words).select(F.col("_word").alias(w), F.col("_mask").alias(m))
    word, bit = _place(key, words)
    near = big.withColumn(w, word).join(F.broadcast(bits), w, "inner")
    return near.where(F.col(m).bitwiseAND(bit) != 0).select(*big.columns)


def rows_of_keys(big: DataFrame, keys: DataFrame, key: str, spread_by: tuple[str, ...] | None = None,
                 words: int = WORDS) -> DataFrame:
    """``big`` semi-joined with ``keys`` on ``key`` at row grain: bit filter below the exchange, then an
    exact join that splits hot keys.  Null keys and repeated rows of ``keys`` behave as in a semi join."""
    one = keys.select(key).where(F.col(key).isNotNull()).distinct()
    near = bit_filter(big, keys.select(key), key, words)
    return skew_join(near, one, [key], "inner", spread_by=spread_by).select(*big.columns)
