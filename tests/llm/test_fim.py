"""Fill-in-middle: SWAR counts and cuts against a plain tokenization, outputs against the contract."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from clickmetrics.llm import fim
from clickmetrics.llm import words as W

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXT = st.text(alphabet="abXYZ@[`{09 \n<>PSMéß日𝒳\x00\x7fzA", max_size=40)


def plain(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form = "plain"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    chars = (None, None) if form == "plain" else (len(p), len(m))
    return doc, n, form, *chars, out


@given(st.lists(TEXT, min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_counts_and_cuts(texts, draw):
    units = fim.Units(*W.text_bytes(pa.array(texts)))
    found = [UNIT.findall(t) for t in texts]
    assert units.counts.tolist() == [len(f) for f in found]
    k = [draw.randint(0, len(f)) for f in found]
    want = ["".join(f[:i]) for f, i in zip(found, k, strict=True)]
    size, points = units.cut(np.array(k))
    assert size.tolist() == [len(w.encode()) for w in want] and points.tolist() == [len(w) for w in want]


@given(TEXT, TEXT, TEXT, st.sampled_from(["psm", "spm", "plain"]))
def test_outputs_come_apart(prefix, middle, suffix, form):
    whole = prefix + middle + suffix
    if not any(m.decode() in whole for m in fim.MARKS):
        parts = [x.encode() for x in (prefix, middle, suffix)]
        assert fim.restore(form, fim.join_parts(form, *parts)) == whole.encode()


def test_rows(spark, rows):
    some = [(r[0], r[1]) for r in rows] + [(500 + i, "wörd " * i + "x" * i) for i in range(120)] + [(900, "a <S> b"), (None, None)]
    some.append((901, "word é\n" * 300_000))  # about 2.4 MB: more than a block
    df = spark.createDataFrame(some, "doc_id long, text string")
    want = [plain(*r) for r in some]
    assert Counter(map(tuple, fim.fill_in_middle(spark, df).collect())) == Counter(want)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = Counter((*w[:5], sha(w[5]), sha(t)) for w, (_, t) in zip(want, some, strict=True))
    assert Counter(map(tuple, fim.op13(spark, df).collect())) == digests
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_empty_and_extra_columns(spark, empty, docs):
    assert fim.op13(spark, empty).count() == 0
    wide = docs.withColumn("form", docs["lang"]).withColumn("n", docs["source"])
    assert fim.op13(spark, wide).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert fim.op13(spark, wide).count() == docs.count()
