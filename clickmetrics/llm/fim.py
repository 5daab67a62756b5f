"""Fill-in-middle transformation with SWAR word operations over UTF-8 bytes.

A unit is ``[A-Za-z]+|[^A-Za-z]``: a run of ASCII letters, or one other code point.  The texts of a
block are laid out in one buffer, each padded with zero bytes to whole 64-bit words (at least one
zero byte, so that a text's last byte never looks at the next text).  On these words, eight bytes at
a time, arithmetic marks the last byte of every unit: a byte ends a unit unless the next byte
continues its code point, or both are letters.  ``bitwise_count`` gives the units per word and a running
sum the units up to each word.  A cut after k units is found by a binary search of that sum for its
word, then by clearing the word's lowest marks until the wanted one is left (select inside a word).

Cuts and forms are drawn from SHA-256 of ``<seed>:<doc_id>``, so reruns and retried tasks agree.
There is no shuffle and nothing is shared between rows.  Memory per task is about ten times a block of
1 MiB of text, or of one longer text.

Forms: ``plain`` is the text; ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm`` is ``<S>``
suffix ``<P>`` prefix ``<M>`` middle.  A text that contains a marker stays plain, so an output can
always be taken apart again.

Edge cases: a null text counts as empty (plain, n = 0, empty output).  A null id draws from
``<seed>:``; rows with equal ids and texts get equal rows.  Empty tables give an empty result.  Very long
texts are handled whole.  Extra columns, whatever their names, are ignored; only ``doc_id`` (an
integer or text) and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from clickmetrics.llm import words as W
from clickmetrics.llm.common import ship, text_blocks

MARKS = (b"<P>", b"<S>", b"<M>")
SEED = 1
PLAIN_FROM = 90   # of 100 draws, those from here on stay plain
SPM_BELOW = 20    # of 100 draws, those below take the suffix-first form
BLOCK = 1 << 20

_U = np.uint64
_HIGH = _U(0x8080808080808080)
_LOW7 = _U(0x7F7F7F7F7F7F7F7F)
_CASE = _U(0x2020202020202020)
_FROM_A = _U(0x1F1F1F1F1F1F1F1F)   # 0x80 - ord("a"): carries into bit 7 from "a" on
_PAST_Z = _U(0x0505050505050505)   # 0x80 - ord("z") - 1: carries into bit 7 past "z"
_ONE = _U(1)


def padded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as little-endian 64-bit words, and per text the range of its words."""
    lens = np.diff(offsets)
    word_off = np.zeros(len(offsets), np.int64)
    np.cumsum(lens // 8 + 1, out=word_off[1:])
    flat = np.zeros(int(word_off[-1]) * 8, np.uint8)
    for at, start, end in zip((word_off * 8).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=False):
        flat[at:at + end - start] = data[start:end]
    return flat.view("<u8"), word_off


def _with_next(marks: np.ndarray) -> np.ndarray:
    """Bit 7 marks of the byte after each byte (zero after the last)."""
    out = marks >> _U(8)
    out[:-1] |= marks[1:] << _U(56)
    return out


def unit_ends(words: np.ndarray, word_off: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit 7 of every byte that ends a unit, and of every byte that ends a code point."""
    low = (words | _CASE) & _LOW7
    letter = ((low + _FROM_A) & ~(low + _PAST_Z)) & ~words & _HIGH
    continues = words & ~(words << _ONE) & _HIGH
    point = ~_with_next(continues) & _HIGH
    last = word_off[1:] - 1  # a text's last word holds its last lens % 8 bytes, then zeros
    point[last] &= (_ONE << (_U(8) * (lens % 8).astype(_U))) - _ONE
    return point & ~(letter & _with_next(letter)), point


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Byte position just after the ``rank``-th (from 1) mark of each word."""
    left = word.copy()
    for step in range(1, 8):
        left = np.where(rank > step, left & (left - _ONE), left)
    lowest = left & (~left + _ONE)
    return np.bitwise_count(lowest - _ONE).astype(np.int64) // 8 + 1


class Units:
    """Unit counts of many texts and the byte places of cuts inside them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words, self.word_off = padded_words(data, offsets)
        self.ends, self.points = unit_ends(words, self.word_off, np.diff(offsets))
        self.upto = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.upto[1:])
        self.points_upto = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.points), out=self.points_upto[1:])
        self.counts = self.upto[self.word_off[1:]] - self.upto[self.word_off[:-1]]

    def cut(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of the first ``k`` units of each text (0 <= k <= its count)."""
        first = self.word_off[:-1]
        if not len(k):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        want = self.upto[first] + k
        at = np.maximum(np.searchsorted(self.upto, want, side="left") - 1, first)  # the word that holds it
        rank = want - self.upto[at]
        inside = np.where(k > 0, _select(self.ends[at], rank), 0)
        before = (_ONE << (_U(8) * np.minimum(inside, 7).astype(_U))) - _ONE
        before = np.where(inside == 8, ~_U(0), before)
        points = self.points_upto[at] - self.points_upto[first] + np.bitwise_count(self.points[at] & before)
        return np.where(k > 0, (at - first) * 8 + inside, 0), np.where(k > 0, points, 0)


def draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit numbers per document id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16] for d in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def join_parts(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = MARKS
    if form == "plain":
        return prefix + middle + suffix
    if form == "psm":
        return b"".join([p, prefix, s, suffix, m, middle])
    return b"".join([s, suffix, p, prefix, m, middle])


def restore(form: str, output: bytes) -> bytes:
    """The text, from an output and its form alone."""
    if form == "plain":
        return output
    second = MARKS[1] if form == "psm" else MARKS[0]
    first, _, rest = output[3:].partition(second)
    other, _, middle = rest.partition(MARKS[2])
    prefix, suffix = (first, other) if form == "psm" else (other, first)
    return prefix + middle + suffix


def _task(seed: int, plain_from: int, spm_below: int, digests: bool):
    def run(batches):
        for block in text_blocks(batches, most=BLOCK):
            text = block.column("text").fill_null("")
            data, offsets = W.text_bytes(text)
            units = Units(data, offsets)
            n = units.counts
            h = draws(block.column("doc_id").to_pylist(), seed)
            a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            cut1, points1 = units.cut(np.minimum(a, b))
            cut2, points2 = units.cut(np.maximum(a, b))
            plain = (np.diff(offsets) == 0) | (h[:, 2] % 100 >= plain_from)
            for mark in MARKS:
                plain |= pc.match_substring(text, mark.decode()).to_numpy(zero_copy_only=False)
            forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_below, "spm", "psm")).tolist()
            raw, out1, out2 = data.tobytes(), [], []
            for form, start, end, p, q in zip(forms, offsets[:-1].tolist(), offsets[1:].tolist(), cut1.tolist(), cut2.tolist(), strict=True):
                output = join_parts(form, raw[start:start + p], raw[start + p:start + q], raw[start + q:end])
                if digests:
                    out1.append(hashlib.sha256(output).hexdigest())
                    out2.append(hashlib.sha256(restore(form, output)).hexdigest())
                else:
                    out1.append(output.decode())
            cols = [block.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), pa.array(points1, mask=plain),
                    pa.array(points2 - points1, mask=plain), pa.array(out1, pa.string())]
            names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            if digests:
                names[-1] = "output_sha256"
                cols.append(pa.array(out2, pa.string()))
                names.append("restored_sha256")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def fill_in_middle(spark: SparkSession, docs: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM,
                   spm_below: int = SPM_BELOW, digests: bool = False) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row; with ``digests`` the output's
    SHA-256 and that of the text restored from it, instead of the output."""
    ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, "
    schema += "output_sha256 string, restored_sha256 string" if digests else "output string"
    return docs.select("doc_id", "text").mapInArrow(_task(seed, plain_from, spm_below, digests), schema)


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return fill_in_middle(spark, docs, digests=True)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
k AS (
  SELECT doc_id, text, u, len(u) AS n,
         CAST('0x' || h[1:8] AS UBIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS pre,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:n], '') AS suf
  FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
