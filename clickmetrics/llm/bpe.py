"""Byte-level BPE by longest match and backtracking over an Aho-Corasick automaton.

Bytes are mapped to Latin-1 characters, so that the automaton (pyahocorasick) reads byte strings.
A piece is encoded from left to right: take the longest token that starts here; it may follow the
token before it only if the two are compatible, i.e. if merging their joint bytes by rank gives
exactly the two tokens again (memoised per pair).  If not, the next shorter token is tried, and if
none is left, the token before is taken back and shortened in turn; a position that failed once is
never entered again, so the time is linear in the piece.  A token sequence whose neighbours are all
compatible is the one that merging by rank gives, so results equal the plain merge loop's.

Texts are split by the pattern of the rank file.  A unit (a space and what follows up to the next
space) is split on its own and its ids are kept in a bounded memo; texts with other white space
runs are split whole.  The memo holds work already done; once full it takes no more, which changes no result.

Decoding looks up the bytes of every id.

Edge cases: a null text is encoded as the empty text (no ids).  Empty tables give an empty result.
Repeated rows get equal rows.  Very long pieces aren't memoised.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from clickmetrics.llm.common import ship, text_blocks

MEMO = 600_000
LONGEST_MEMO = 64
_ODD_SPACE = regex.compile(r"[^\S \n]")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        # A token that merging its own bytes doesn't give can't stand inside a piece.
        self.usable = {t for i, t in enumerate(tokens) if len(t) == 1 or self.merged(t) == [i]}
        self.automaton = ahocorasick.Automaton()
        for t in self.usable:
            self.automaton.add_word(t.decode("latin-1"), (self.rank[t], len(t)))
        self.automaton.make_automaton()
        # The next shorter token that a token starts with (-1: none).
        self.shorter = [next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.usable), -1) for t in tokens]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.names = [str(i) for i in range(len(tokens))]

    def merged(self, raw: bytes) -> list[int]:
        """The plain merge loop: join the neighbours of lowest joint rank until none has one."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        rank = self.rank
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Work out and keep whether token b may follow token a."""
        known = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        if len(self.compatible) >= MEMO:
            self.compatible.clear()
        self.compatible[a, b] = known
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.rank.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [-1] * n  # the longest token that starts at each byte
        for end, (token, length) in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - length] = token  # ends only grow, so the last one stays
        path: list[int] = []
        dead = bytearray(n + 1)
        known, shorter, tokens = self.compatible.get, self.shorter, self.tokens
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + len(tokens[token])]:
                    if not path:
                        break
                    fits = known((path[-1], token))
                    if self.fits(path[-1], token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += len(tokens[token])
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = path.pop()
                at -= len(tokens[token])
                token = shorter[token]
        return path

    def encode_unit(self, unit: str) -> bytes:
        """Little-endian 32-bit ids of a unit, split by the pattern on its own."""
        ids = [i for piece in self.split(unit) for i in self.encode_piece(piece.encode())]
        out = np.array(ids, "<u4").tobytes()
        if len(unit) <= LONGEST_MEMO and len(self.memo) < MEMO:
            self.memo[unit] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        # A single space always joins what follows it, so units between single spaces are independent.
        units = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        if len(units) > 1 and ("  " in text or text[0] == " " or text[-1] == " " or _ODD_SPACE.search(text)):
            units = [text]
        get, make = self.memo.get, self.encode_unit
        return np.frombuffer(b"".join([get(u) or make(u) for u in units]), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple, Encoder] = {}


def encoder_for(tokens: list[bytes], pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (hashlib.sha256(b"\n".join(map(base64.b64encode, tokens))).digest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokens, pattern)
    return _encoders[key]


def _task(shared, pattern: str, names: list[str], with_ids: bool):
    def run(batches):
        enc = encoder_for(shared.value, pattern)
        for block in text_blocks(batches):
            n_tokens, ids_sha, dec_sha, ids_out = [], [], [], []
            for text in block.column("text").to_pylist():
                ids = enc.encode(text or "")
                as_list = ids.tolist()
                n_tokens.append(len(as_list))
                ids_sha.append(hashlib.sha256(" ".join(map(enc.names.__getitem__, as_list)).encode()).hexdigest())
                dec_sha.append(hashlib.sha256(enc.decode(as_list)).hexdigest())
                if with_ids:
                    ids_out.append(as_list)
            cols = [block.column(c) for c in names] + [pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()),
                                                       pa.array(dec_sha, pa.string())]
            out = names + ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                out = out + ["ids"]
            yield pa.RecordBatch.from_arrays(cols, out)
    return run


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) per row: encoded by the ranks in
    ``path`` (a vocabulary: bounded, broadcast), then decoded again."""
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(path))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_task(shared, pattern, ["doc_id"], with_ids), schema + (", ids array<int>" if with_ids else ""))


def op7(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark, docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            pattern or public_tokenizers.PATTERN, with_ids=False)
