"""Cross-tokenizer alignment: groups of tokens of two tokenizers between the byte offsets where both end.

**Fragments.**  The tokens that end in a byte range of a document are a fragment: an open prefix (up
to the first offset where tokens of both end), closed groups, and an open suffix (after the last such
offset).  Joining neighbours concatenates the left one's suffix and the right one's prefix and looks
there for common ends again, so joining is associative (:func:`join`): any cutting of a document into
ranges, joined in any order, gives the same groups.  Documents above LONG bytes are cut into byte ranges
of RANGE; Spark tasks make the fragments, and a tree reduction joins FAN neighbours a round.  Only the
open ends and counts travel up; groups that a join closes are given out with their byte offset where
they arise.  Shorter documents are one fragment, handled many at a time.

**Encoding.**  Both tokenizers are run through their libraries on units: stretches between single
spaces or line ends where neither can join what it separates.  (A's pattern never does;  B's vocabulary
is checked for pieces that would, and where it has some, a text is one unit.)  A unit is encoded once
per task memory and its groups, links and counts are kept in a table, which is emptied when it passes
TABLE_BYTES.  That holds work already done and changes no result.

**Counts.**  A block of documents ("part") gives its distinct id pairs with the number of its documents that
hold each; Spark sums them.  The counts go back to the parts by an equi-join on the pair: a pair
occurs at most once per part, so no key is hot.  The highest count per A id is a table of at most A's
vocabulary, which is broadcast.  Long documents give their pairs per fragment; a pair that
several fragments hold is one row per document before it is counted.

Edge cases: null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no
tokens: zeros and the empty string.  Every row counts as one document; rows with null or equal ids stay
apart.  Special tokens' strings in a text are plain text.  Empty tables give an empty result.  A very long
text is cut into ranges; only a unit (a stretch without a space or line end) must fit one task.  Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.llm import words as W
from clickmetrics.llm.common import ship, text_blocks, written
from clickmetrics.llm.ragged import Growing, offsets_of, slices, take

LONG = 1 << 16
RANGE = 1 << 15
FAN = 16
PART = 1 << 20
TABLE_BYTES = 96 << 20
_JOINED = 8 << 10  # bytes of units that are encoded in one call
_SPACE = W.IS_SPACE
# Bytes that may follow a cut: no ASCII white space or control separator, no first byte of a Unicode space.
_FIRM = ~_SPACE
_FIRM[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


# ---- groups of two tokenizations --------------------------------------------------------------

def cells(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all overlaps of A and B tokens over the same bytes, and the index of either token.

    Two tilings of a range overlap in as many pairs as they have distinct ends."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Names:
    """Decimal ids with each separator, as Arrow strings to take from."""

    def __init__(self, size: int):
        self.table = pa.array([f"{i}{s}" for i in range(size) for s in ",|;"], pa.large_string())

    def render(self, ids_a, ends_a, ids_b, ends_b, common) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids in group order, each with the separator that follows it; and A's and B's group numbers."""
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        order = np.zeros(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
        last_a[:-1] = group_a[1:] != group_a[:-1]
        last_b[:-1] = group_b[1:] != group_b[:-1]
        order[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a * 3 + last_a
        order[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")] = ids_b * 3 + 2 * last_b
        return self.table.take(pa.array(order)), group_a, group_b


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a freshly taken large string or binary array."""
    _, offs, data = strings.buffers()
    offsets = np.frombuffer(offs, np.int64)[:len(strings) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def open_group() -> dict:
    return {"ids_a": np.zeros(0, np.int64), "ends_a": np.zeros(0, np.int64),
            "ids_b": np.zeros(0, np.int64), "ends_b": np.zeros(0, np.int64)}


def _cut_at(run: dict, end: int) -> tuple[dict, dict]:
    """Tokens of ``run`` that end up to ``end``, and the others."""
    a, b = np.searchsorted(run["ends_a"], end, side="right"), np.searchsorted(run["ends_b"], end, side="right")
    return ({"ids_a": run["ids_a"][:a], "ends_a": run["ends_a"][:a], "ids_b": run["ids_b"][:b], "ends_b": run["ends_b"][:b]},
            {"ids_a": run["ids_a"][a:], "ends_a": run["ends_a"][a:], "ids_b": run["ids_b"][b:], "ends_b": run["ends_b"][b:]})


def _chain(x: dict, y: dict) -> dict:
    return {k: np.concatenate([x[k], y[k]]) for k in x}


def fragment(run: dict) -> tuple[dict, tuple[int, dict] | None]:
    """``{prefix, suffix, last}`` of the tokens of a byte range, and the groups it closes with their first byte.

    ``last`` is the last common end in the range, -1 without one (then all tokens are the prefix)."""
    common = np.intersect1d(run["ends_a"], run["ends_b"], assume_unique=True)
    if not len(common):
        return {"prefix": run, "suffix": open_group(), "last": -1}, None
    prefix, rest = _cut_at(run, common[0])
    groups, suffix = _cut_at(rest, common[-1])
    return {"prefix": prefix, "suffix": suffix, "last": int(common[-1])}, (int(common[0]), groups) if len(common) > 1 else None


def join(x: dict, y: dict) -> tuple[dict, tuple[int, dict] | None]:
    """The fragment of two neighbouring ranges, and the groups that the joining closed with their first byte."""
    between = _chain(x["prefix"] if x["last"] < 0 else x["suffix"], y["prefix"])
    common = np.intersect1d(between["ends_a"], between["ends_b"], assume_unique=True)
    if not len(common):  # then y has no common end either: its first one would be in ``between``
        if x["last"] < 0:
            return {"prefix": between, "suffix": open_group(), "last": -1}, None
        return {"prefix": x["prefix"], "suffix": between, "last": x["last"]}, None
    groups, after = _cut_at(between, common[-1])
    prefix, start = x["prefix"], x["last"]
    if start < 0:
        prefix, groups = _cut_at(groups, common[0])
        start = int(common[0])
    suffix, last = (after, int(common[-1])) if y["last"] < 0 else (y["suffix"], y["last"])
    return {"prefix": prefix, "suffix": suffix, "last": last}, (start, groups) if len(groups["ids_a"]) else None


# ---- the two tokenizers -----------------------------------------------------------------------

def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin, in texts that each start with a space: the texts' starts, and single spaces and
    line ends between other characters."""
    n = len(data)
    at = np.zeros(n + 1, bool)
    if n > 2:
        at[1:n - 1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & ~_SPACE[data[:-2]] & _FIRM[data[2:]]
    at[offsets] = True  # a text's first byte is a space, so the byte before it isn't cut from it
    return np.flatnonzero(at[:n])


class Pair:
    """Both tokenizers, and a table of the units met so far with their groups and links."""

    def __init__(self, spec_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        size_a = self.a.get_vocab_size()
        alphabet = _byte_alphabet()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.bytes_a = [b""] * size_a
        for token, i in self.a.get_vocab().items():
            if i not in special:
                self.bytes_a[i] = bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                        for p in pieces]
        self.lens_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.lens_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.space_b = self.b.piece_to_id("▁")
        self.cuttable = not any(c in p.lstrip("▁") for p in pieces for c in ("▁", "\n"))
        self.size_b = len(pieces)
        self.names = Names(max(size_a, self.size_b))
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.codes, self.text = Growing(np.uint32), Growing(np.uint8)
        self.code_ends, self.text_ends = Growing(np.int64), Growing(np.int64)
        self.n = Growing(np.int32)  # flat rows of: A tokens, B tokens, groups, 1 if both give the bytes back
        self.code_ends.append(np.zeros(1, np.int64))
        self.text_ends.append(np.zeros(1, np.int64))

    def ids_b(self, unit: str) -> list[int]:
        """B's ids of a unit; a space in front is what B itself adds, before a line end it is taken off."""
        if unit[0] == " ":
            return self.b.encode(unit[1:]) if len(unit) > 1 else [self.space_b]
        ids = self.b.encode(unit)
        return ids[1:] if ids[:1] == [self.space_b] else ids

    def _joined(self, units: list[bytes]) -> dict | None:
        """Tokens of regular units encoded as one text after a spare unit, or None where that doesn't hold."""
        spare = b" a"
        raw = spare + b"".join(units)
        text = raw.decode()
        ids_a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        ids_b = np.array(self.b.encode(text[1:]), np.int64)
        if b"".join([self.bytes_a[i] for i in ids_a]) != raw or b"".join([self.bytes_b[i] for i in ids_b]) != raw:
            return None
        ends_a, ends_b = np.cumsum(self.lens_a[ids_a]), np.cumsum(self.lens_b[ids_b])
        bounds = np.cumsum([len(spare), *map(len, units)])
        if not (np.isin(bounds, ends_a).all() and np.isin(bounds, ends_b).all()):
            return None
        a, b = np.searchsorted(ends_a, len(spare)) + 1, np.searchsorted(ends_b, len(spare)) + 1
        return {"ids_a": ids_a[a:], "ends_a": ends_a[a:] - len(spare), "ids_b": ids_b[b:], "ends_b": ends_b[b:] - len(spare),
                "bounds": bounds - len(spare)}

    def _single(self, unit: bytes) -> dict | None:
        text = unit.decode()
        ids_a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        ids_b = np.array(self.ids_b(text), np.int64)
        if b"".join([self.bytes_a[i] for i in ids_a]) != unit or b"".join([self.bytes_b[i] for i in ids_b]) != unit:
            return None
        return {"ids_a": ids_a, "ends_a": np.cumsum(self.lens_a[ids_a]), "ids_b": ids_b, "ends_b": np.cumsum(self.lens_b[ids_b]),
                "bounds": np.array([0, len(unit)])}

    def closed(self, run: dict, bounds: np.ndarray) -> tuple:
        """Codes, text and counts of groups over bytes that both tokenizers tile, cut at ``bounds`` (common ends)."""
        ends_a, ends_b = run["ends_a"], run["ends_b"]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends, at_a, at_b = cells(ends_a, ends_b)
        codes = (run["ids_a"][at_a] * self.size_b + run["ids_b"][at_b]).astype(np.uint32)
        strings, _, _ = self.names.render(run["ids_a"], ends_a, run["ids_b"], ends_b, common)
        text, offsets = _bytes_of(strings)
        upto = [np.searchsorted(x, bounds, side="right") for x in (ends_a, ends_b, common, ends)]
        return codes, upto[3], text, offsets[upto[0] + upto[1]], np.column_stack([np.diff(u) for u in upto[:3]])

    def _store(self, units: list[bytes], run: dict | None) -> None:
        first = len(self.code_ends.values) - 1
        for i, unit in enumerate(units):
            self.rows[unit] = first + i
        if run is None:  # no tokens, and texts that hold it have none either
            self.code_ends.append(np.full(len(units), self.codes.size))
            self.text_ends.append(np.full(len(units), self.text.size))
            self.n.append(np.zeros(4 * len(units), np.int32))
            return
        codes, code_at, text, text_at, counts = self.closed(run, run["bounds"])
        self.code_ends.append(self.codes.size + code_at[1:])
        self.text_ends.append(self.text.size + text_at[1:])
        self.codes.append(codes)
        self.text.append(text[:text_at[-1]])
        self.n.append(np.column_stack([counts, np.ones(len(units), np.int64)]).astype(np.int32).ravel())

    def regular(self, unit: bytes) -> bool:
        """Whether a unit may stand between others in one call of the tokenizers."""
        return self.cuttable and len(unit) > 1 and unit[0] in b" \n" and bool(_FIRM[unit[1]]) and not _SPACE[unit[-1]]

    def tokens(self, piece: bytes) -> dict | None:
        """Tokens of a piece of a text and their ends, or None if a tokenizer doesn't give it back."""
        return (self._joined([piece]) if self.regular(piece) else None) or self._single(piece)

    def learn(self, units: list[bytes]) -> None:
        """Put units that the table lacks into it."""
        batch, held = [], 0
        for unit in units:
            if self.regular(unit):
                batch.append(unit)
                held += len(unit)
                if held >= _JOINED:
                    self._learn_joined(batch)
                    batch, held = [], 0
            else:
                self._store([unit], self._single(unit))
        if batch:
            self._learn_joined(batch)

    def _learn_joined(self, batch: list[bytes]) -> None:
        run = self._joined(batch)
        if run is not None:
            self._store(batch, run)
        elif len(batch) == 1:
            self._store(batch, self._single(batch[0]))
        else:
            half = len(batch) // 2
            self._learn_joined(batch[:half])
            self._learn_joined(batch[half:])

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all units of texts (each starts with a space), and each text's range of them."""
        if self.text.size + 4 * self.codes.size + 100 * len(self.rows) > TABLE_BYTES:
            self.clear()
        starts = unit_starts(data, offsets) if self.cuttable else np.unique(offsets[:-1][np.diff(offsets) > 0])
        coded = slices(data, np.append(starts, len(data))).dictionary_encode()
        known = coded.dictionary.to_pylist()
        get = self.rows.get
        self.learn([u for u in known if get(u) is None])
        rows = np.array([self.rows[u] for u in known], np.int64)
        return rows[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64), np.searchsorted(starts, offsets)

    def counts(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text its A tokens, B tokens and groups (zeros where it isn't valid), and whether it is valid."""
        upto = np.zeros((len(rows) + 1, 4), np.int64)
        np.cumsum(self.n.values.reshape(-1, 4)[rows], axis=0, out=upto[1:])
        per = upto[bounds[1:]] - upto[bounds[:-1]]
        n_units = np.diff(bounds)
        ok = (per[:, 3] == n_units) & (n_units > 0)
        return np.where(ok[:, None], per[:, :3], 0), ok


_pairs: dict[bytes, Pair] = {}


def pair_for(shared) -> Pair:
    """One pair of tokenizers per worker process."""
    spec, model = shared.value
    key = hashlib.sha256(spec.encode() + model).digest()
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(spec, model)
    return _pairs[key]


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    lens = np.diff(offsets)
    out = offsets_of(lens + (lens > 0))
    flat = np.full(int(out[-1]), 0x20, np.uint8)
    for at, a, b in zip(out[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[at - (b - a):at] = data[a:b]
    return flat, out


# ---- shorter documents: a part at a time ------------------------------------------------------

def _narrow(x: np.ndarray) -> bytes:
    """Numbers as bytes, at the width of the largest (1, 2 or 4); the first byte tells it."""
    width = 1 if not len(x) or x.max() < 256 else 2 if x.max() < 65536 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


_PART = ("part long, doc_ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, "
         "sha array<string>, codes binary, code_docs binary, pairs binary, slots binary, times binary")


def _parts_task(shared):
    def run(batches):
        pair = pair_for(shared)
        part = TaskContext.get().partitionId() << 32
        for block in text_blocks(batches, most=PART):
            data, offsets = spaced(*W.text_bytes(block.column("text")))
            rows, bounds = pair.units(data, offsets)
            n, ok = pair.counts(rows, bounds)
            text, text_at = take(pair.text.values, pair.text_ends.values, rows)
            raw, text_at = text.tobytes(), text_at[bounds]
            sha = [hashlib.sha256(raw[a:b - 1]).hexdigest() if good else ""
                   for a, b, good in zip(text_at[:-1].tolist(), text_at[1:].tolist(), ok.tolist(), strict=True)]
            codes, code_at = take(pair.codes.values, pair.code_ends.values, rows)
            links = np.diff(code_at[bounds])
            owner = np.repeat(np.arange(len(links), dtype=np.uint64), links)
            valid = ok[owner.astype(np.int64)]
            # One row per document and distinct pair, in order of both.
            keys, times = np.unique((owner[valid] << np.uint64(32)) | codes[valid], return_counts=True)
            distinct, slots, held_by = np.unique(keys.astype(np.uint32), return_inverse=True, return_counts=True)
            per_doc = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(links))
            one = [pa.array([part], pa.int64()), pa.array([block.column("doc_id").to_pylist()], pa.list_(block.column("doc_id").type))]
            one += [pa.array([n[:, i]], pa.list_(pa.int64())) for i in range(3)]
            one += [pa.array([sha], pa.list_(pa.string()))]
            one += [pa.array([x], pa.binary()) for x in (distinct.astype("<u4").tobytes(), held_by.astype("<u4").tobytes(),
                                                         _narrow(per_doc), _narrow(slots), _narrow(times))]
            yield pa.RecordBatch.from_arrays(one, ["part", "doc_ids", "n_a", "n_b", "n_groups", "sha", "codes", "code_docs",
                                                   "pairs", "slots", "times"])
            part += 1
    return run


def _part_pairs_task(batches):
    for batch in batches:
        for part, codes, docs in zip(*[batch.column(c).to_pylist() for c in ("part", "codes", "code_docs")], strict=True):
            codes = np.frombuffer(codes, "<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), part)), pa.array(np.arange(len(codes), dtype=np.int32)),
                 pa.array(codes.astype(np.int64)), pa.array(np.frombuffer(docs, "<u4").astype(np.int64))],
                ["part", "slot", "code", "docs"])


_RESULT = ("doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def _finish_part(parts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Rows of a part's documents, from its pair lists and the corpus counts of its pairs."""
    total = np.zeros(len(counts), np.int64)
    best = np.zeros(len(counts), bool)
    slot = counts["slot"].to_numpy()
    total[slot], best[slot] = counts["count"].to_numpy(), counts["best"].to_numpy()
    out = []
    for p in parts.itertuples():
        per_doc, slots, times = (_wide(x).astype(np.int64) for x in (p.pairs, p.slots, p.times))
        bounds = offsets_of(per_doc)
        weights = total[slots] * times if len(slots) else np.zeros(0, np.int64)
        n_best = times * best[slots] if len(slots) else np.zeros(0, np.int64)
        sums = [W.per_text(x, bounds) for x in (times, n_best, weights)]
        out.append(pd.DataFrame({"doc_id": pd.Series(list(p.doc_ids), dtype=object), "n_a": p.n_a, "n_b": p.n_b, "n_groups": p.n_groups,
                                 "n_links": sums[0], "n_best": sums[1], "count_sum": sums[2], "groups_sha256": p.sha}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["doc_id"])


# ---- long documents: byte ranges and a tree ---------------------------------------------------

_RUN = "array<struct<id:int,end:long>>"
_OUT = "array<struct<at:long,text:binary,codes:binary,groups:long>>"
_FRAGMENT = f"row long, no long, prefix_a {_RUN}, prefix_b {_RUN}, suffix_a {_RUN}, suffix_b {_RUN}, last long, n_a long, n_b long, ok boolean, out {_OUT}"


def _ranges_task(shared, range_bytes: int):
    """Cut each text, a space before it, near every multiple of ``range_bytes`` where a unit begins."""
    def run(batches):
        cuttable = pair_for(shared).cuttable
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.frombuffer(b" " + text.encode(), np.uint8)
                starts = unit_starts(raw, np.array([0, len(raw)])) if cuttable else np.zeros(1, np.int64)
                marks = np.arange(range_bytes, len(raw), range_bytes)
                cuts = np.unique(np.append(starts, len(raw))[np.searchsorted(starts, marks)])
                edges = [0, *cuts[cuts < len(raw)].tolist(), len(raw)]
                for no, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([no], pa.int64()), pa.array([a], pa.int64()),
                                                      pa.array([raw[a:b].tobytes()], pa.binary())], ["row", "no", "start", "piece"])
    return run


def _run_rows(run: dict, side: str) -> list[dict]:
    return [{"id": i, "end": e} for i, e in zip(run["ids_" + side].tolist(), run["ends_" + side].tolist(), strict=True)]


def _run_of(a, b) -> dict:
    return {"ids_a": np.array([t["id"] for t in a], np.int64), "ends_a": np.array([t["end"] for t in a], np.int64),
            "ids_b": np.array([t["id"] for t in b], np.int64), "ends_b": np.array([t["end"] for t in b], np.int64)}


def _given_out(pair: Pair, start: int, run: dict) -> dict:
    """Closed groups that begin at byte ``start``: their text, links and number."""
    codes, _, text, text_at, counts = pair.closed(run, np.array([start, run["ends_a"][-1]]))
    return {"at": start, "text": text[:text_at[-1]].tobytes(), "codes": codes.astype("<u4").tobytes(), "groups": int(counts[0, 2])}


def _fragment_row(row, no, f: dict, n_a, n_b, ok: bool, out: list[dict]) -> dict:
    return {"row": row, "no": no, "prefix_a": _run_rows(f["prefix"], "a"), "prefix_b": _run_rows(f["prefix"], "b"),
            "suffix_a": _run_rows(f["suffix"], "a"), "suffix_b": _run_rows(f["suffix"], "b"), "last": f["last"],
            "n_a": int(n_a), "n_b": int(n_b), "ok": ok, "out": out}


def _fragments_task(shared, range_bytes: int):
    """Fragments of the byte ranges that each piece touches: a token belongs to the range that its last byte is in."""
    def run(batches):
        pair = pair_for(shared)
        for batch in batches:
            rows = []
            for row, no, start, piece in zip(*[batch.column(c).to_pylist() for c in ("row", "no", "start", "piece")], strict=True):
                tokens = pair.tokens(piece)
                if tokens is None:
                    nothing = {"prefix": open_group(), "suffix": open_group(), "last": -1}
                    rows.append(_fragment_row(row, 2 * no, nothing, 0, 0, False, []))
                    continue
                tokens["ends_a"], tokens["ends_b"] = tokens["ends_a"] + start, tokens["ends_b"] + start
                # A piece ends at the first cut after a multiple of the range, so it reaches into the next range.
                edge = (start + len(piece) - 1) // range_bytes * range_bytes
                for k, part in enumerate(_cut_at(tokens, edge)):
                    if len(part["ids_a"]) or len(part["ids_b"]):
                        f, groups = fragment(part)
                        rows.append(_fragment_row(row, 2 * no + k, f, len(part["ids_a"]), len(part["ids_b"]), True,
                                                  [] if groups is None else [_given_out(pair, *groups)]))
            yield pa.RecordBatch.from_pylist(rows, _ARROW_FRAGMENT)
    return run


_ARROW_RUN = pa.list_(pa.struct([("id", pa.int32()), ("end", pa.int64())]))
_ARROW_FRAGMENT = pa.schema([
    ("row", pa.int64()), ("no", pa.int64()), *[(c, _ARROW_RUN) for c in ("prefix_a", "prefix_b", "suffix_a", "suffix_b")],
    ("last", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("ok", pa.bool_()),
    ("out", pa.list_(pa.struct([("at", pa.int64()), ("text", pa.binary()), ("codes", pa.binary()), ("groups", pa.int64())])))])


def _join_group(shared):
    """At most FAN neighbouring fragments of a document become one."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pair = pair_for(shared)
        whole, out, ok = None, [], bool(rows["ok"].all())
        for r in rows.sort_values("no").itertuples():
            f = {"prefix": _run_of(r.prefix_a, r.prefix_b), "suffix": _run_of(r.suffix_a, r.suffix_b), "last": int(r.last)}
            groups = None
            if whole is None:
                whole = f
            elif ok:
                whole, groups = join(whole, f)
            if groups is not None:
                out.append(_given_out(pair, *groups))
        return pd.DataFrame([_fragment_row(key[0], key[1], whole, rows["n_a"].sum(), rows["n_b"].sum(), ok, out)])
    return run


def _whole_task(shared):
    """A document's start is a common end, so its prefix is its first group."""
    def run(batches):
        pair = pair_for(shared)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["out"] = [_given_out(pair, 0, _run_of(r["prefix_a"], r["prefix_b"]))] if r["ok"] and r["prefix_a"] else []
            yield pa.RecordBatch.from_pylist(rows, _ARROW_FRAGMENT)
    return run


def _digest_task(batches):
    """One SHA-256 per document over its groups' texts, which come in order of their bytes."""
    row, digest, held = None, None, b""

    def flush():
        digest.update(held[:-1])  # without the last semicolon
        return pa.RecordBatch.from_arrays([pa.array([row]), pa.array([digest.hexdigest()])], ["row", "groups_sha256"])

    for batch in batches:
        for r, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if r != row:
                if row is not None:
                    yield flush()
                row, digest, held = r, hashlib.sha256(), b""
            digest.update(held)
            held = text
    if row is not None:
        yield flush()


def _run_pairs_task(batches):
    for batch in batches:
        for row, codes in zip(batch.column("row").to_pylist(), batch.column("codes").to_pylist(), strict=True):
            code, times = np.unique(np.frombuffer(codes, "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row)), pa.array(code.astype(np.int64)), pa.array(times)],
                                             ["row", "code", "times"])


def _long_documents(spark: SparkSession, shared, docs: DataFrame, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``row, doc_id, n_a, n_b, n_groups, groups_sha256`` per long document, and its ``row, code, times``."""
    docs = written(spark, docs.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    pieces = docs.select("row", "text").mapInArrow(_ranges_task(shared, range_bytes), "row long, no long, start long, piece binary")
    pieces = written(spark, pieces, "long-pieces")
    spread = pieces.repartition("row", "no")
    level = written(spark, spread.mapInArrow(_fragments_task(shared, range_bytes), _FRAGMENT), "long-fragments")
    levels, most = [level], level.agg(F.max("no").alias("most")).first()["most"] or 0
    while most > 0:
        groups = level.select(*[c for c in level.columns if c != "out"], F.expr(f"no div {FAN}").alias("up"))
        level = written(spark, groups.groupBy("row", "up").applyInPandas(_join_group(shared), _FRAGMENT), "long-fragments")
        levels.append(level)
        most //= FAN
    whole = written(spark, level.mapInArrow(_whole_task(shared), _FRAGMENT), "long-whole")
    good = whole.where("ok").select("row")
    out = None
    for x in [*levels, whole]:
        x = x.select("row", F.inline("out"))
        out = x if out is None else out.unionByName(x)
    out = written(spark, out.join(good, "row", "left_semi"), "long-groups")
    times = out.select("row", "codes").mapInArrow(_run_pairs_task, "row long, code long, times long")
    pairs = written(spark, times.groupBy("row", "code").agg(F.sum("times").alias("times")), "long-pairs")
    digests = (out.select("row", "at", "text").repartition("row").sortWithinPartitions("row", "at")
               .select("row", "text").mapInArrow(_digest_task, "row long, groups_sha256 string"))
    n_groups = out.groupBy("row").agg(F.sum("groups").alias("n_groups"))
    n = whole.select("row", *[F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b")])
    facts = (docs.select("row", "doc_id").join(n, "row").join(n_groups, "row", "left").join(digests, "row", "left")
             .select("row", "doc_id", "n_a", "n_b", F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
                     F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    return facts, pairs


# ---- the operator -----------------------------------------------------------------------------

def align_documents(spark: SparkSession, docs: DataFrame, spec_a: str, model_b: bytes, long_bytes: int = LONG,
                    range_bytes: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Results per document (``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``), and the
    corpus's id pairs ``a, b, count, best``."""
    ship(spark)
    shared = spark.sparkContext.broadcast((spec_a, model_b))  # two vocabularies: bounded
    size_b = Pair(spec_a, model_b).size_b
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    parts = written(spark, rows.where(~is_long).mapInArrow(_parts_task(shared), _PART.format(kind=kind)), "align-parts")
    facts, long_pairs = _long_documents(spark, shared, rows.where(is_long), range_bytes)

    part_pairs = parts.select("part", "codes", "code_docs").mapInArrow(_part_pairs_task, "part long, slot int, code long, docs long")
    held = part_pairs.select("code", "docs").unionByName(long_pairs.select("code", F.lit(1).cast("long").alias("docs")))
    counts = written(spark, held.groupBy("code").agg(F.sum("docs").alias("count")), "align-counts")
    a_id = F.expr(f"code div {size_b}")
    most = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("most"))  # at most one row per id of A: broadcast
    weighed = (counts.withColumn("a", a_id).join(F.broadcast(most), "a")
               .select("code", "a", (F.col("code") % size_b).alias("b"), "count", (F.col("count") == F.col("most")).alias("best")))

    weights = part_pairs.select("part", "slot", "code").join(weighed.select("code", "count", "best"), "code")
    weights = weights.select("part", "slot", "count", "best")
    lists = parts.drop("codes", "code_docs")
    short = (lists.groupBy("part").cogroup(weights.groupBy("part"))
             .applyInPandas(_finish_part, _RESULT.format(kind=kind)))
    sums = (long_pairs.join(weighed, "code").groupBy("row")
            .agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("count")).alias("count_sum")))
    zero = F.lit(0).cast("long")
    long = facts.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", *[F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256")
    return short.unionByName(long), weighed.select("a", "b", "count", "best")


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return align_documents(spark, docs, spec, model)[0]
