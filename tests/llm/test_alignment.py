"""Cross-tokenizer alignment against a plain version, and the laws of fragments."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clickmetrics.llm import align


@pytest.fixture(scope="module")
def files():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return spec, f.read()


def plain(rows, files):
    """Every row by the two libraries alone, token by token."""
    a_tok = Tokenizer.from_str(files[0])
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    alphabet = align._byte_alphabet()
    a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in a_tok.get_vocab().items() if t != "<|endoftext|>"}

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()

    per, held = [], Counter()
    for doc, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            raw_a, raw_b = [a_bytes[i] for i in a], [b_bytes(i) for i in b]
            if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                a, b = [], []
        i = j = end_a = end_b = 0
        if a:
            end_a, end_b = len(raw_a[0]), len(raw_b[0])
            group = ([a[0]], [b[0]])
        while i < len(a):
            links.append((a[i], b[j]))
            if end_a == end_b:
                groups.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                group = ([], [])
            step_a, step_b = end_a <= end_b, end_b <= end_a
            if step_a:
                i += 1
                if i < len(a):
                    end_a += len(raw_a[i])
                    group[0].append(a[i])
            if step_b:
                j += 1
                if j < len(b):
                    end_b += len(raw_b[j])
                    group[1].append(b[j])
        held.update(set(links))
        per.append((doc, a, b, links, groups))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return Counter((doc, len(a), len(b), len(groups), len(links), sum(held[x] == best[x[0]] for x in links),
                    sum(held[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                   for doc, a, b, links, groups in per)


BITS = ["a", "b ", " ", "  ", "\n", "\n\n", "é", "日本", "▁", "\xa0", "　", " x", "'s", "12", "!?", "\t", "\r\n", "<s>",
        "<|endoftext|>", "\x00", "the", "ﬁ", "\x1c", "\x85", "é", " word", " "]


def awkward(n):
    draw = random.Random(5)
    return [(i, "".join(draw.choice(BITS) for _ in range(draw.randrange(25)))) for i in range(n)]


def test_equals_plain_version(spark, rows, files):
    some = [(r[0], r[1]) for r in rows] + awkward(400) + [(None, None), (7, ""), (None, " "), (7, "\n"), (7, "\n")]
    df = spark.createDataFrame(some, "doc_id long, text string")
    result, pairs = align.align_documents(spark, df, *files)
    assert Counter(map(tuple, result.collect())) == plain(some, files)
    assert pairs.groupBy("a", "b").count().where("count > 1").isEmpty()


def test_byte_ranges_give_the_same_rows(spark, files):
    """Every text above 60 bytes is cut into ranges of 50 and joined in a tree of several rounds."""
    from .conftest import prose

    some = awkward(15) + [(100, prose(3, 400)), (101, prose(3, 400)), (102, "nospaceatall" * 30), (103, " ▁ bad " * 20), (None, prose(4, 30))]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = align.align_documents(spark, df, *files, long_bytes=60, range_bytes=50)[0]
    assert Counter(map(tuple, got.collect())) == plain(some, files)


def test_columns_and_empty(spark, empty, docs, files):
    assert align.op11(spark, empty).count() == 0
    wide = docs.limit(3).withColumn("part", docs["source"]).withColumn("row", docs["lang"]).withColumn("code", docs["lang"])
    out = align.align_documents(spark, wide, *files)[0]
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.count() == 3


def _tiling(lens):
    ends = np.cumsum(lens)
    return np.arange(len(lens)), ends


def _same(x, y):
    return x["last"] == y["last"] and all(np.array_equal(x[s][k], y[s][k]) for s in ("prefix", "suffix") for k in x[s])


@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30),
       st.lists(st.integers(0, 120), max_size=5), st.randoms(use_true_random=False))
def test_joining_is_associative(lens_a, lens_b, cuts, draw):
    """Any cuts, joined in any order of neighbours, give the fragment of the whole and all its groups once."""
    (ids_a, ends_a), (ids_b, ends_b) = _tiling(lens_a), _tiling(lens_b)
    run = {"ids_a": ids_a, "ends_a": ends_a, "ids_b": ids_b, "ends_b": ends_b}
    whole, groups = align.fragment(run)
    rest, parts, closed = run, [], []
    for c in sorted(cuts):
        left, rest = align._cut_at(rest, c)
        parts.append(left)
    made = [align.fragment(p) for p in [*parts, rest]]
    closed = [g for _, g in made if g is not None]
    todo = [f for f, _ in made]
    while len(todo) > 1:
        i = draw.randrange(len(todo) - 1)
        f, g = align.join(todo[i], todo[i + 1])
        todo[i:i + 2] = [f]
        closed += [g] if g is not None else []
    assert _same(todo[0], whole)
    joined = {k: np.concatenate([g[k] for _, g in sorted(closed, key=lambda x: x[0])]) if closed else [] for k in run}
    assert all(np.array_equal(joined[k], groups[1][k] if groups else []) for k in run)
