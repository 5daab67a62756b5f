"""Token ids as patched frame-of-reference files.

Documents are range-partitioned and sorted by id, encoded in that order, and written as segments:
whole documents, cut when a segment reaches SEGMENT ids.  A segment's ids are stored in blocks of
BLOCK: the block minimum is subtracted, the differences are packed at the width that holds
PERCENTILE percent of them, and larger ones are kept in an exception list (position, value).  A
segment starts with a header, the documents' token counts and the byte start of every block, so one
block or document is read without the ones before it.

The files are written by Spark as Parquet rows ``part, seg, part_start, doc_ids, n_ids, payload``
under the shared folder: a lost task is written again and never half visible.  Parts and segments
are in document order.  Starts over the whole corpus need one number per part (not per document).

Encoding uses the tokenizers library on words between ASCII spaces and line ends, which its
pre-tokenizer always separates; words seen before come from a bounded table.

Edge cases: null text counts as empty (only the end id).  Null ids come first.  Rows with equal ids
are ordered by text (null first).  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.llm import words as W
from clickmetrics.llm.common import ship, text_blocks, written
from clickmetrics.llm.ragged import Growing, offsets_of, slices, take

BLOCK = 256
SEGMENT = 1 << 17
PERCENTILE = 90
END_ID = 2
TABLE_BYTES = 160 << 20
_BREAK = np.zeros(256, bool)  # bytes between words here
_BREAK[[0x20, 0x0A]] = True
# Latin letters and one mark after them: two pieces for the pre-tokenizer, and A-Z is lower-cased by
# the normalizer, so the ids follow from the lower-case letters' and the mark's.
_SIMPLE = re.compile("([A-Za-z][a-z\u00e0-\u00f6\u00f8-\u00ff]*|[\u00e0-\u00f6\u00f8-\u00ff][a-z\u00e0-\u00f6\u00f8-\u00ff]*)([.,;:!?]?)")
_LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")
# Byte-level vocabularies write a byte from 0xA1 on (but for 0xAD) as its Latin-1 character, the others as U+0100 on.
_BYTE_LEVEL = {c: "".join(chr(b if b > 0xA0 and b != 0xAD else 0x143 if b == 0xAD else b + 0xA2 if b > 0x7E else b)
                          for b in chr(c).encode()) for c in range(0xE0, 0x100)}
_HEAD = struct.Struct("<4sIIII")
_MAGIC = b"PFR1"


# ---- the file format --------------------------------------------------------------------------

def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A segment of uint32 ``ids`` that belong to documents of ``counts`` ids."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    filled = np.empty(n_blocks * BLOCK, np.uint32)
    filled[:n] = ids
    if n_blocks:
        filled[n:] = ids[-1]
    rows = filled.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    typical = np.partition(diff, rank, axis=1)[:, rank] if n_blocks else low
    width = np.zeros(n_blocks, np.int64)
    for k in range(32):
        width[typical >= (1 << k)] = k + 1
    patched = (diff.astype(np.uint64) >> width.astype(np.uint64)[:, None]) > 0
    n_patch = patched.sum(axis=1)
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width).tolist():
        # bit planes: bit k of all values of a block, then bit k + 1
        at = np.flatnonzero(width == w)
        group = diff[at]
        planes = [np.packbits(((group >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), axis=1) for k in range(w)]
        raw = np.concatenate(planes, axis=1) if planes else np.zeros((len(at), 0), np.uint8)
        for i, r in zip(at.tolist(), raw, strict=True):
            packed[i] = r.tobytes()
    body, starts, place = [], [], 0
    for b in range(n_blocks):
        starts.append(place)
        where = np.flatnonzero(patched[b])
        part = (struct.pack("<IBH", int(low[b]), int(width[b]), int(n_patch[b])) + packed[b]
                + where.astype("<u2").tobytes() + diff[b][where].astype("<u4").tobytes())
        body.append(part)
        place += len(part)
    return b"".join([_HEAD.pack(_MAGIC, len(counts), n, n_blocks, BLOCK), np.asarray(counts, "<u4").tobytes(),
                     np.array(starts, "<u4").tobytes(), *body])


def _block_at(payload: bytes, b: int) -> tuple[int, int, int, int, int]:
    """Minimum, width, number of exceptions, and the byte places of a block's planes and exceptions."""
    _, n_docs, _, n_blocks, size = _HEAD.unpack_from(payload)
    index = _HEAD.size + 4 * n_docs
    at = index + 4 * n_blocks + struct.unpack_from("<I", payload, index + 4 * b)[0]
    low, width, n_patch = struct.unpack_from("<IBH", payload, at)
    return low, width, n_patch, at + 7, at + 7 + size // 8 * width


def _unpack_blocks(payload: bytes, blocks: range) -> np.ndarray:
    size = _HEAD.unpack_from(payload)[4]
    parts = [_block_at(payload, b) for b in blocks]
    out = np.zeros((len(parts), size), np.uint32)
    widths = np.array([p[1] for p in parts], np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        raw = np.frombuffer(b"".join(payload[parts[i][3]:parts[i][4]] for i in at.tolist()), np.uint8)
        bits = np.unpackbits(raw.reshape(len(at), -1), axis=1).reshape(len(at), w, size)
        values = np.zeros((len(at), size), np.uint32)
        for k in range(w):
            values |= bits[:, k, :].astype(np.uint32) << np.uint32(k)
        out[at] = values
    for i, (low, _, n_patch, _, at) in enumerate(parts):
        if n_patch:
            where = np.frombuffer(payload, "<u2", n_patch, at)
            out[i, where] = np.frombuffer(payload, "<u4", n_patch, at + 2 * n_patch)
        out[i] += np.uint32(low)
    return out.reshape(-1)


def unpack_block(payload: bytes, b: int) -> np.ndarray:
    """The ids of one block, found through the index of block starts."""
    magic, _, n, n_blocks, size = _HEAD.unpack_from(payload)
    if magic != _MAGIC or not 0 <= b < n_blocks:
        raise ValueError("not a segment, or no such block")
    return _unpack_blocks(payload, range(b, b + 1))[:min(size, n - b * size)]


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a segment and the documents' counts."""
    magic, n_docs, n, n_blocks, _ = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a segment")
    counts = np.frombuffer(payload, "<u4", n_docs, _HEAD.size).astype(np.int64)
    return _unpack_blocks(payload, range(n_blocks))[:n], counts


# ---- encoding ---------------------------------------------------------------------------------

class WordEncoder:
    """Ids of texts by the tokenizers library, through a table of the words met so far.

    A block's words are told apart by Arrow's dictionary encoding; only words that the table lacks are
    looked at one by one, and all ids of a block are taken from the table in one step.  A table above
    TABLE_BYTES is emptied, which changes no result."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        bar = self.tok.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        # Lower-case Latin letters pass this normalizer and pre-tokenizer unchanged, as one piece in the
        # byte-level alphabet, so the library's model can be asked for their ids at once.
        parts = json.loads(spec)
        kinds = [[x["type"] for x in (parts[k] or {}).get(v, [])] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.model = self.tok.model if kinds == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and parts["post_processor"] is None else None
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids, self.ends = Growing(np.uint32), Growing(np.int64)
        self.letters = 0
        self.ends.append(np.zeros(1, np.int64))
        self._store([""], [0], [])

    def _store(self, words: list[str], lens, ids) -> None:
        """Put words into the table: the number of ids of each, and all ids one after another."""
        first = self.ends.size - 1
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))
        self.letters += sum(map(len, words))
        self.ends.append(self.ids.size + np.cumsum(lens))
        self.ids.append(np.asarray(ids, np.uint32))

    def _learn(self, words: list[str]) -> None:
        """Put words that the table lacks into it; simple ones are put together from their parts."""
        rows, split, plain = self.rows, {}, set()
        for w in words:
            m = _SIMPLE.fullmatch(w)
            if m is None:
                plain.add(w)
                continue
            core, mark = m.groups()
            if core[0] < "a":
                core = core.lower()
            if core == w:
                plain.add(w)
                continue
            split[w] = (core, mark)
            if core not in rows:
                plain.add(core)
            if mark not in rows:
                plain.add(mark)
        self._encode(sorted(plain))
        if split:
            parts = np.array([rows[x] for pair in split.values() for x in pair], np.int64)
            ids, ends = take(self.ids.values, self.ends.values, parts)
            self._store(list(split), np.diff(ends[::2]), ids)

    def _encode(self, words: list[str]) -> None:
        """Encode words, many in one call with a bar between them."""
        if self.model is not None:
            ask, lens, ids, letters, others = self.model.tokenize, [], [], [], []
            for w in words:
                if _LETTERS.fullmatch(w):
                    found = [t.id for t in ask(w if w.isascii() else w.translate(_BYTE_LEVEL))]
                    letters.append(w)
                    lens.append(len(found))
                    ids += found
                else:
                    others.append(w)
            if letters:
                self._store(letters, lens, ids)
            words = others
        alone = [w for w in words if self.bar is None or "|" in w]
        plain = [w for w in words if self.bar is not None and "|" not in w]
        for a in range(0, len(plain), 1000):
            part = plain[a:a + 1000]
            ids = np.array(self.tok.encode(" | ".join(part), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(ids == self.bar)
            if len(cut) == len(part) - 1:
                self._store(part, np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1, np.delete(ids, cut))
            else:
                alone += part
        if alone:
            found = [e.ids for e in self.tok.encode_batch(alone, add_special_tokens=False)]
            self._store(alone, [len(x) for x in found], [i for x in found for i in x])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the texts' offsets into them."""
        if 4 * self.ids.size + 4 * self.letters + 100 * len(self.rows) > TABLE_BYTES:
            self.clear()
        starts, ends, bounds = W.word_spans(data, offsets, _BREAK)
        lens = offsets_of(ends - starts)
        coded = slices(data[~_BREAK[data]], lens).cast(pa.large_string()).dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        get = self.rows.get
        rows = list(map(get, known))
        new = [w for w, r in zip(known, rows, strict=True) if r is None]
        if new:
            self._learn(new)
            rows = list(map(get, known))
        rows = np.array(rows, np.int64)
        at = rows[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        ids, ends = take(self.ids.values, self.ends.values, at)
        return ids, ends[bounds]


_encoders: dict[bytes, WordEncoder] = {}


def encoder_for(spec: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


def _write_task(shared, kind):
    def run(batches):
        gc.disable()  # no cycles here, and looking for them means walking the whole table
        enc = encoder_for(shared.value)
        part = TaskContext.get().partitionId()
        seg, start, total, held, ids, counts = 0, 0, 0, [], [], []
        end = np.array([END_ID], np.uint32)

        def flush():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([held], pa.list_(kind)), pa.array([len(flat)], pa.int64()),
                 pa.array([pack(flat, np.array(counts, np.uint32))], pa.binary())],
                ["part", "seg", "part_start", "doc_ids", "n_ids", "payload"])

        for block in text_blocks(batches):
            flat, bounds = enc.encode(*W.text_bytes(block.column("text")))
            for doc, a, b in zip(block.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                held.append(doc)
                ids += [flat[a:b], end]
                counts.append(b - a + 1)
                total += counts[-1]
                if total >= SEGMENT:
                    yield flush()
                    seg, start, total, held, ids, counts = seg + 1, start + total, 0, [], [], []
        if held:
            yield flush()
    return run


def write_ids(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Encode and write all documents in ascending id order; the written segments."""
    ship(spark)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary: bounded
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    segments = rows.mapInArrow(_write_task(shared, arrow), f"part int, seg int, part_start long, doc_ids array<{kind}>, "
                               "n_ids long, payload binary")
    return written(spark, segments, "token-files")


def _read_task(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, counts = unpack(row["payload"])
            stops = np.cumsum(counts)
            starts = stops - counts
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                 pa.array(starts + row["part_start"] + row["before"]), pa.array(counts), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from written segments."""
    ship(spark)
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offsets, before = [], 0
    for part, n in totals:  # one row per part of the files
        offsets.append((part, before))
        before += n
    kind = dict(segments.dtypes)["doc_ids"][len("array<"):-1]
    first = spark.createDataFrame(offsets, "part int, before long")
    return segments.join(F.broadcast(first), "part").mapInArrow(
        _read_task, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op10(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return read_ids(spark, write_ids(spark, docs, path or public_tokenizers.path("word_bpe_49k.json")))
