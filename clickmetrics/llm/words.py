"""Vectorised word hashing over the raw UTF-8 bytes of many texts at once (numpy, inside tasks).

A word is ``[^\\x20\\x09-\\x0D]+``.  All separators are single bytes, so words are found on bytes.
Word hashes are 64-bit polynomial hashes of random byte values, finished by a mixer that also
takes the length; sequences of words are hashed from word hashes.

Sums run over stretches of CHUNK entries, so the tables of powers have a fixed size and work arrays
don't grow with the text.  What grows with a text is its bytes, its words' places (16 bytes a word)
and their hashes (8 bytes each).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_PRIME_INV = pow(_PRIME, -1, 1 << 64)
_SECOND = 0xD6E8FEB86659FD93 | 1
_SECOND_INV = pow(_SECOND, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240101))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

CHUNK = 1 << 16
BLOCK = 1 << 20  # bytes of text that one step of a task works on (or one longer text)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; tables of up to 2 * CHUNK + 1 entries are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * CHUNK + 1), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * CHUNK + 1:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and offsets (one more than rows) of an Arrow text column; null counts as empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offs, data = arr.buffers()
    if len(arr) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per text the range of its words (offsets into them).

    ``space`` tells which bytes separate words."""
    n = len(data)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        inside = np.zeros(b - a + 2, bool)  # one byte more at either side
        inside[(a == 0):b - a + 1 + (b < n)] = ~space[data[max(a - 1, 0):b + 1]]
        here = inside[1:-1]
        edge = np.zeros(b - a + 1, bool)  # a text begins here
        edge[offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b, side="right")] - a] = True
        starts.append(np.flatnonzero(here & (~inside[:-2] | edge[:-1])) + a)
        ends.append(np.flatnonzero(here & (~inside[2:] | edge[1:])) + a + 1)
    starts = np.concatenate(starts)
    return starts, np.concatenate(ends), np.searchsorted(starts, offsets)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unfinished hashes of spans that lie within ``data``, which is at most 2 * CHUNK long."""
    n = len(data)
    sums = np.zeros(n + 1, U)
    np.cumsum(values[data] * powers(_PRIME, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(_PRIME_INV, n + 1)[starts]


def _long_sum(parts, base: int) -> np.uint64:
    """The polynomial of a long sequence from values that come in stretches of CHUNK."""
    total, scale = 0, 1
    for x in parts:
        total += int((x * powers(base, len(x))).sum(dtype=U)) * scale
        scale = scale * pow(base, len(x), 1 << 64) % (1 << 64)
    return U(total % (1 << 64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (an empty span hashes as its length); spans come in order."""
    out = np.zeros(len(starts), U)
    lens = ends - starts
    cuts = np.searchsorted(starts, np.arange(0, (int(starts[-1]) if len(starts) else -1) + CHUNK + 1, CHUNK))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if i == j:
            continue
        if ends[j - 1] - starts[i] > 2 * CHUNK:  # only the last span can reach that far
            j -= 1
            a, b = int(starts[j]), int(ends[j])
            out[j] = _long_sum((values[data[k:min(k + CHUNK, b)]] for k in range(a, b, CHUNK)), _PRIME)
            if i == j:
                continue
        a = starts[i]
        out[i:j] = _span_hashes(data[a:ends[j - 1]], starts[i:j] - a, ends[i:j] - a, values)
    return mix(out + lens.astype(U) * U(0xA24BAED4963EE407))


def _family(words: np.ndarray, second: bool) -> tuple[np.ndarray, int, int]:
    if second:
        return mix(words ^ U(0x5851F42D4C957F2D)), _SECOND, _SECOND_INV
    return words, _PRIME, _PRIME_INV


def window_hashes(words: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Hash of every run of ``width`` (below CHUNK) consecutive word hashes (``len(words) - width + 1`` of them).

    ``second`` gives an independent family, for 128 bits together."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), U)
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        w, base, inv = _family(words[a:b + width - 1], second)
        sums = np.zeros(len(w) + 1, U)
        np.cumsum(w * powers(base, len(w)), out=sums[1:])
        out[a:b] = mix((sums[width:] - sums[:b - a]) * powers(inv, b - a) + U(width))
    return out


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range of ``offsets``, which tile them (empty ranges give 0)."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[:offsets[-1]], offsets[some], dtype=np.int64)
    return out


def repeated(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which entries share owner and key with another entry."""
    k = mix(keys + owner.astype(U) * U(0xC2B2AE3D27D4EB4F))
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(k), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def text_digests(words: np.ndarray, word_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole word sequence."""
    out = []
    lens = np.diff(word_off)
    for second in (False, True):
        sums = np.zeros(len(lens), U)
        i = 0
        while i < len(lens):
            a = int(word_off[i])
            j = max(i + 1, int(np.searchsorted(word_off, a + CHUNK, side="right")) - 1)
            j = min(j, len(lens))
            b = int(word_off[j])
            if b - a > CHUNK:  # one long text
                _, base, _ = _family(words[:0], second)
                sums[i] = _long_sum((_family(words[k:min(k + CHUNK, b)], second)[0] for k in range(a, b, CHUNK)), base)
            else:
                w, base, inv = _family(words[a:b], second)
                upto = np.zeros(b - a + 1, U)
                np.cumsum(w * powers(base, b - a), out=upto[1:])
                at = word_off[i:j + 1] - a
                sums[i:j] = (upto[at[1:]] - upto[at[:-1]]) * powers(inv, b - a + 1)[at[:-1]]
            i = j
        out.append(mix(sums + lens.astype(U)))
    return out[0], out[1]
