"""Word hashing against plain integers, at stretch edges, and its memory on a long text."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from clickmetrics.llm import words as W

M64 = (1 << 64) - 1


def mixed(x):
    return int(W.mix(np.array([x & M64], np.uint64))[0])


def plain_hash(raw: bytes):
    total = sum(int(W.BYTE_VALUE[b]) * pow(W._PRIME, i, 1 << 64) for i, b in enumerate(raw))
    return mixed(total + len(raw) * 0xA24BAED4963EE407)


def test_spans_and_hashes(monkeypatch):
    texts = [None, "", " a\tbb  c ", "x" * 300 + " tail " + "y" * 40, "é ü\n" * 30, "one", "two three " * 25]
    want = [w.encode() for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    for chunk in (1 << 16, 64, 7):
        monkeypatch.setattr(W, "CHUNK", chunk)
        data, offsets = W.text_bytes(pa.array(texts, pa.string()))
        starts, ends, per = W.word_spans(data, offsets)
        assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == want
        assert np.diff(per).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
        hashes = W.span_hashes(data, starts, ends)
        assert hashes.tolist() == [plain_hash(w) for w in want]
        if chunk > 7:
            for width in (1, 5):
                got = W.window_hashes(hashes, width).tolist()
                assert got == [mixed(sum(int(h) * pow(W._PRIME, k, 1 << 64) for k, h in enumerate(hashes[i:i + width])) + width)
                               for i in range(len(hashes) - width + 1)]
        digests = W.text_digests(hashes, per)[0].tolist()
        assert digests == [mixed(sum(int(h) * pow(W._PRIME, k, 1 << 64) for k, h in enumerate(hashes[a:b])) + int(b - a))
                           for a, b in zip(per[:-1], per[1:], strict=True)]


def test_sums_per_text():
    assert W.per_text(np.array([1, 0, 1, 1], bool), np.array([0, 0, 2, 2, 4, 4])).tolist() == [0, 1, 0, 2, 0]
    assert W.per_text(np.zeros(0, bool), np.array([0, 0])).tolist() == [0]


@pytest.mark.parametrize("text", ["word and more " * 1_200_000, "x" * 16_000_000])
def test_long_text_stays_bounded(text):
    data, offsets = W.text_bytes(pa.array([text]))
    tracemalloc.start()
    starts, ends, per = W.word_spans(data, offsets)
    hashes = W.span_hashes(data, starts, ends)
    W.window_hashes(hashes, 50)
    W.text_digests(hashes, per)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 64 * len(starts) + (24 << 20)  # places and hashes of words, and fixed work arrays
    assert sum(p.nbytes for p in W._powers.values()) < 8 << 20
