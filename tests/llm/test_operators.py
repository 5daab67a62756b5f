"""Every operator against a plain Python version on a small corpus of awkward rows, and on empty tables."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickmetrics.llm import bpe, langid, linededup, paretomix, pfor, quality, recompress, sigtree, toxicity, vptree
from clickmetrics.llm import words as W

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_line_dedup(spark, docs, rows):
    seen = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            seen.setdefault(line.strip(SPACE).translate(LOWER), set()).add(d)
    want = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (k := x.strip(SPACE).translate(LOWER)) or len(seen[k]) < 10]
        want[(d, len(lines), len(lines) - len(keep), sha("\n".join(keep)))] += 1
    assert got(linededup.op2(spark, docs)) == want
    assert any(k[2] for k in want)


def test_line_dedup_keeps_columns(spark, docs):
    wide = docs.withColumnRenamed("n_chars", "line_dedup_hash").withColumn("dropped", docs["source"])
    out = linededup.drop_lines(spark, wide)
    assert out.columns == wide.columns and out.count() == wide.count()


def test_line_dedup_lowers_ascii_only(spark):
    """Lines beyond ASCII keep their own letters: only A-Z is lowered in a key."""
    lines = ["\u00c9tude A", "\u00e9tude a", "\u212aELVIN", "kelvin", "\u0130", "i", "PLAIN", "plain", "\x0b Plain\t", "\U0001f600 X"]
    text = {d: "\n".join(lines[j] for j in range(len(lines)) if (d + j) % 2 or j > 6) for d in range(12)}
    seen = {}
    for d, t in text.items():
        for line in t.split("\n"):
            seen.setdefault(line.strip(SPACE).translate(LOWER), set()).add(d)
    want = {d: "\n".join(x for x in t.split("\n") if len(seen[x.strip(SPACE).translate(LOWER)]) < 10) for d, t in text.items()}
    out = linededup.drop_lines(spark, spark.createDataFrame(list(text.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert any("tude" in t for t in want.values()) and not any("plain" in t.lower() for t in want.values())


def test_line_dedup_strips(spark):
    """Every white space of the contract goes at either end, no other character does."""
    pads = ["", *SPACE.replace("\n", ""), "\r\t ", "\u00a0", "\x1f", "\x08", "\x0e"]
    text = {d: "\n".join(p + c + q for p in pads for q in pads for c in ("", "x", f"own {d}")) for d in range(10)}
    want = {d: "\n".join(x for x in t.split("\n") if not (k := x.strip(SPACE)) or "own" in k) for d, t in text.items()}
    out = linededup.drop_lines(spark, spark.createDataFrame(list(text.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want


def test_line_dedup_few_files(spark, monkeypatch):
    """The frequent hashes are few rows; they aren't written as one file for each shuffle partition."""
    files, put = {}, linededup.written
    def counted(spark, df, name):
        out = put(spark, df, name)
        files[name] = len(out.inputFiles())
        return out
    monkeypatch.setattr(linededup, "written", counted)
    many = spark.createDataFrame([(d, "\n".join(f"line {i}" for i in range(300))) for d in range(10)], "doc_id long, text string")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "60"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        marks = linededup.keep_bitmaps(spark, many).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["n_dropped"] for r in marks] == [300] * 10
    assert files["frequent-lines"] <= spark.sparkContext.defaultParallelism < 60


def test_line_dedup_many_lines(spark):
    """A text of many lines is split a few times, not once for each of its lines."""
    n = 20_000
    long = "\n".join("shared" if i % 7 == 3 else f"own line {i}" for i in range(n))
    docs = spark.createDataFrame([(0, long)] + [(d, "shared") for d in range(1, 11)], "doc_id long, text string")
    linededup.op2(spark, docs.filter("doc_id > 0")).collect()
    began = time.monotonic()
    found = {r["doc_id"]: r for r in linededup.op2(spark, docs).collect()}
    took = time.monotonic() - began
    kept = [x for x in long.split("\n") if x != "shared"]
    assert (found[0]["n_lines"], found[0]["n_dropped"]) == (n, n - len(kept))
    assert found[0]["kept_sha256"] == sha("\n".join(kept))
    assert took < 15, took


def test_mix(spark, docs, rows):
    size, per = Counter(), Counter()
    for _, t, _, s, _ in rows:
        per[s] += len(words(t))
    order = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = set(), 1.5 * sum(per.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(2 * per[s] for s in full)
        level = left / sum(weight[s] for s in open_)
        more = {s for s in open_ if weight[s] * level > 2 * per[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * per[s] if s in full else weight[s] * level for s in order}
    first = paretomix.copies(spark, docs.select("doc_id", "source", "text")).collect()
    again = paretomix.copies(spark, docs.select("doc_id", "source", "text")).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert len(first) == len(rows)
    largest = Counter()
    for r in first:
        assert r["source_size"] == per[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 2
        size[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(size[s] - target[s]) <= largest[s] / 2 + 1e-6, s


def test_mix_sources_without_words(spark):
    schema = "doc_id long, text string, source string, n_chars long"
    rows = [(1, None, "a", None), (2, "", "a", 0), (3, " \t\n", "a", 3), (None, None, "a", None), (4, "", None, 0)]
    bare = spark.createDataFrame(rows, schema)
    assert got(paretomix.op4(spark, bare)) == Counter((r[0], 0, 0, 0.0, 0) for r in rows)
    assert paretomix.mix_documents(spark, bare).count() == 0
    texts = [(10 + i, "word " * 10, "b", 50) for i in range(20)]
    both = spark.createDataFrame(rows + texts, schema)
    out = paretomix.op4(spark, both).collect()
    assert {tuple(r)[1:] for r in out if (r["doc_id"] or 0) < 10} == {(0, 0, 0.0, 0)}
    assert sum(r["taken"] for r in out) == pytest.approx(300, abs=5) and len(out) == 25
    mixed = paretomix.mix_documents(spark, both).collect()
    assert len(mixed) == 30 and {r["source"] for r in mixed} == {"b"}


def test_mix_counts_equal_rows_once_each(spark):
    text = "word " * 10
    rows = [(None, text, "a", i) for i in range(60)] + [(i, text, "a", 100 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = sum(r["taken"] for r in paretomix.op4(spark, df).collect())
    out = paretomix.mix_documents(spark, df)
    per = Counter(r["n_chars"] for r in out.collect())
    assert out.columns == df.columns
    assert 10 * sum(per.values()) == taken == 1200
    assert set(per) == {r[3] for r in rows} and set(per.values()) == {1, 2}


def test_jaccard_join(spark, docs, rows):
    sets = {}
    for d, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets.setdefault(d, []).append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    ids = [d for d in sets if d is not None]
    comp = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    want = Counter((d, len(s), comp.get(d)) for d, v in sets.items() for s in v)
    assert got(sigtree.op5(spark, docs)) == want
    assert comp[2] == 1 and comp[3] == 1 and comp[10] == 9
    assert sigtree.one_per_group(spark, docs).count() == len(set(comp.values())) + 1


def test_repeated_id_links_all_its_texts(spark):
    from .conftest import prose

    t1, t2, t3 = prose(201, 100), prose(202, 100), prose(203, 60)
    near = t2.split(" ")
    near[30] = "changed"
    rows = [(3, t1), (5, t1), (5, t2), (9, " ".join(near)), (5, ""), (5, None), (6, ""), (20, t3), (21, t3), (21, "x y z"),
            (None, t1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["component_id"]) for r in sigtree.op5(spark, df).collect()}
    assert out == {(3, 3), (5, 3), (9, 3), (6, 6), (20, 20), (21, 20), (None, None)}
    left = Counter((r["doc_id"], r["text"]) for r in sigtree.one_per_group(spark, df).collect())
    assert left == Counter([(3, t1), (6, ""), (20, t3), (None, t1)])


def test_null_ids_are_not_one_group(spark):
    rows = [(None, f"some text {i}") for i in range(80)] + [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sigtree.one_per_group(spark, df).withColumn("at", F.spark_partition_id()).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [1, 3]
    null = [r for r in out if r["doc_id"] is None]
    assert len(null) == len({r["text"] for r in null}) == 80
    assert max(Counter(r["at"] for r in null).values()) <= 40


def test_signature_tree_finds_every_component():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (60, 80, 400)]
    sets = []
    for i in range(240):
        s = base[i % 3].copy()
        s[rng.choice(len(s), int(len(s) * 0.02 * (i % 14)), replace=False)] = rng.integers(0, 1 << 62, dtype=np.uint64)
        sets.append(np.unique(s))
    links = [(i, j) for i in range(240) for j in range(i) if sigtree.linked(sets[i], sets[j])]

    def parts(pairs):
        c = list(range(240))
        for i, j in pairs:
            old, new = c[i], c[j]
            c = [new if x == old else x for x in c]
        return [c.index(x) for x in c]

    out = sigtree.join_group(sets, np.arange(240))
    assert len(out) < 240 and parts(out) == parts(links)
    side = np.arange(240) % 2
    across = sigtree.join_group(sets, np.arange(240), side)
    assert parts(across) == parts([(i, j) for i, j in links if side[i] != side[j]])


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    for n in [*range(1, 90), 200, 1000]:
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[:max(1, -(-3 * len(a) // 4))]]]))
        if sigtree.linked(a, b):
            ka, kb = sigtree.keys_of(a), sigtree.keys_of(b)
            assert any(set(x) & set(y) for x, y in zip(ka, kb, strict=True)), n


def test_quality(spark, docs, rows):
    out = {}
    for r in quality.op6(spark, docs).collect():
        out.setdefault(r["doc_id"], []).append(r)
    for d, t, *_ in rows:
        w, lines = words(t), (t or "").split("\n")
        seen, dup = set(), 0
        for line in lines:
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        bad = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        r = next(x for x in out[d])
        assert tuple(r)[1:7] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover), bad)
        assert not (bad and r["kept"])
    assert out[1][0]["kept"] and out[12][0]["kept"]
    kept = quality.quality_filter(spark, docs)
    assert kept.columns == docs.columns and {1, 2, 3, 4} <= {r["doc_id"] for r in kept.collect()}


def test_bpe(spark, docs, rows):
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))}
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t, *_ in rows:
        ids = tk.encode_ordinary(t or "")
        want[(d, len(ids), sha(" ".join(map(str, ids))), sha(t or ""))] += 1
    assert got(bpe.op7(spark, docs)) == want


def test_bpe_on_odd_texts():
    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = bpe.Encoder(tokens, P.PATTERN)
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.rank, special_tokens={})
    for t in ["", " ", "  a  b ", "a\n b \n\nc", "\ta\x0bb", "it's we'll", "日本 é\x00x", "a" * 3000, "<|endoftext|>", "   x\x85y"]:
        assert enc.encode(t).tolist() == tk.encode_ordinary(t), repr(t)
        assert enc.decode(enc.encode(t).tolist()) == t.encode()


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at, want = 0, Counter()
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[(d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert got(pfor.op10(spark, docs)) == want


@pytest.mark.parametrize("ids", [[], [5], [0] * 300, [4294967295, 0] * 200, list(range(1000)), [7] * 255 + [1 << 31]])
def test_pfor_round_trip(ids):
    a = np.array(ids, np.uint32)
    payload = pfor.pack(a, np.array([len(a)]))
    back, counts = pfor.unpack(payload)
    assert back.tolist() == ids and counts.tolist() == [len(ids)]
    for b in range(-(-len(ids) // pfor.BLOCK)):
        assert pfor.unpack_block(payload, b).tolist() == ids[b * pfor.BLOCK:(b + 1) * pfor.BLOCK]


def test_substring_dedup(spark, docs, rows):
    first = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i:i + 50])
                first[k] = min(first.get(k, d), d)
    want = Counter()
    for d, t, *_ in rows:
        w = words(t)
        gone = {j for i in range(len(w) - 49) if d is not None and first[tuple(w[i:i + 50])] < d for j in range(i, i + 50)}
        want[(d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    assert got(recompress.op9(spark, docs)) == want
    assert any(k[2] for k in want)


def test_equal_windows_have_equal_anchors():
    from clickmetrics.llm import words as W

    rng = np.random.default_rng(9)
    block = W.mix(rng.integers(0, 50, 120).astype(np.uint64))
    runs = np.repeat(W.mix(np.arange(3, dtype=np.uint64)), 70)
    texts = [np.concatenate([W.mix(rng.integers(0, 50, n).astype(np.uint64)), block, runs,
                             W.mix(rng.integers(0, 50, n + 7).astype(np.uint64))]) for n in (0, 3, 30, 61)]
    found = {}
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    flat = np.concatenate(texts)
    at, anchor = recompress.anchors(flat, off)
    assert len(at) == sum(len(t) - 49 for t in texts)
    for i, a in zip(at.tolist(), anchor.tolist(), strict=True):
        assert found.setdefault(tuple(flat[i:i + 50].tolist()), a) == a


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    v = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    v += [(400 + i, v[50][1]) for i in range(40)]  # copies tie; the smaller ids win
    v += [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0, None] + [0.0] * 6),
          (950, [1.0, 2.0]), (1000, [2.0, 4.0]), (None, v[0][1]), (5, v[5][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumnRenamed("label", "x")
    fine = {i: np.array(x) for i, x in v if i is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    want = []
    for q in sorted(i for i in fine if i % 50 == 0):
        s = [(-float(fine[q] @ x / np.linalg.norm(fine[q]) / np.linalg.norm(x)), i) for i, x in fine.items()
             if i != q and len(x) == len(fine[q])]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(sorted((round(c, 12), i) for c, i in s)[:5])]
    exact = vptree.nearest(spark, df.filter("vec_id % 50 = 0"), df, factor=1.0, shard=100, query_block=4, leaf=16)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in exact.collect()) == sorted(want)
    near = {(r["query_id"], r["vec_id"]) for r in vptree.op3(spark, df).collect()}
    assert len(near & {(q, i) for q, _, i in want}) >= 0.9 * len(want)


def test_search_finds_k_in_a_shard_without_the_query():
    # Two clusters and queries half way between them: both halves of the tree have a large bound.
    rng = np.random.default_rng(4)
    angle = np.concatenate([rng.uniform(0, 0.05, 500), rng.uniform(np.pi / 2 - 0.05, np.pi / 2, 500)])
    middle = rng.uniform(np.pi / 4 - 0.02, np.pi / 4 + 0.02, 50)
    units, queries = (np.stack([np.cos(x), np.sin(x)], axis=1) for x in (angle, middle))
    q, r = vptree.Tree(units, leaf=16).search(queries, 3, vptree.FACTOR)
    assert np.bincount(q, minlength=50).min() >= 3
    assert len(set(zip(q.tolist(), r.tolist(), strict=True))) == len(q)


def test_recall_with_many_shards():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    units = vptree.unit(centres[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 16)))
    queries, k, best = units[:100], 6, [[] for _ in range(100)]
    for shard in range(20):
        rows = np.arange(shard, 6000, 20)
        for i, j in zip(*vptree.Tree(units[rows], leaf=32).search(queries, k, vptree.FACTOR), strict=True):
            best[i].append((-float(units[rows[j]] @ queries[i]), int(rows[j])))
    want = np.argsort(-(queries @ units.T), axis=1)[:, :k]
    hits = sum(len({j for _, j in sorted(b)[:k]} & set(w.tolist())) for b, w in zip(best, want, strict=True))
    assert hits >= 0.9 * want.size


@pytest.fixture(scope="module")
def learnable(spark):
    texts = [("the and that with for this was %d the of" % i, "en", 0) for i in range(120)]
    texts += [("der und die das mit für ist %d nicht" % i, "de", 0) for i in range(120)]
    texts += [("the and you idiot moron that with %d" % i, "en", 1) for i in range(120)]
    rows = [(i, t, lang, "s", len(t), y) for i, (t, lang, y) in enumerate(texts)]
    rows += [(1000, None, None, None, None, 0), (1001, "", "en", "s", 0, None), (1002, "123 456 !!", "de", "s", 10, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, y int")
    return df.drop("y"), df.selectExpr("doc_id", "1 as quality", "y as toxic")


def test_language_id(spark, learnable):
    docs, _ = learnable
    out = {r["doc_id"]: r for r in langid.op1(spark, docs).collect()}
    assert {out[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in out.items() if r["held_out"] and i < 1000]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert np.mean([out[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    g = langid.Gru(rng.normal(0, 0.5, (6, 257)), rng.normal(0, 0.5, (6, 3)))
    codes, d = rng.integers(0, 257, (7, 4)), rng.normal(size=(7, 3, 4)).astype(np.float32)
    keep = []
    g32 = langid.Gru(g.table.astype(np.float32), g.rec.astype(np.float32))
    g32.run(codes, keep)
    _, d_rec = g32.back(codes, keep, d)
    for i, j in ((0, 0), (2, 1), (4, 2)):
        for sign, store in ((1, "hi"), (-1, "lo")):
            r = g32.rec.copy()
            r[i, j] += sign * 1e-2
            value = float((langid.Gru(g32.table, r).run(codes) * d).sum())
            hi, lo = (value, 0) if store == "hi" else (hi, value)
        assert d_rec[i, j] == pytest.approx((hi - lo) / 2e-2, rel=0.05, abs=0.02)


def test_toxicity(spark, learnable):
    docs, labels = learnable
    out = {r["doc_id"]: r for r in toxicity.op8(spark, docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i, r in out.items() if r["held_out"] and i < 1000]
    assert len(held) > 30 and np.mean([out[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    none = toxicity.op8(spark, docs, labels.filter("false")).collect()
    assert {r["predicted"] for r in none} == {0}


@pytest.mark.parametrize("op", [langid.op1, linededup.op2, paretomix.op4, sigtree.op5, quality.op6, bpe.op7, recompress.op9,
                                pfor.op10])
def test_empty_documents(spark, empty, op):
    assert op(spark, empty).count() == 0


def test_empty_others(spark, empty):
    assert toxicity.op8(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert vptree.op3(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_language_probabilities_are_those_of_a_plain_pass():
    """`pooled` against one byte at a time in plain Python: whole texts, also beyond one segment and one block."""
    rng = np.random.default_rng(3)
    net = langid.train([b"the and that with", b"der und die das"] * 4, ["en", "de"] * 4, epochs=1)
    texts = [bytes(rng.integers(32, 127, n).tolist()).decode() for n in (0, 1, 47, 48, 49, 700)] + ["Straße ÄÖ — ζ"]

    def direction(g, codes):
        h, out = np.zeros(g.rec.shape[1]), []
        for c in codes:
            s = g.table[:, c].astype(float) + g.rec @ h
            s = s / (1 + np.abs(s))
            z, cand = (s[:len(h)] + 1) / 2, s[len(h):]
            h = h + z * (cand - h)
            out.append(h)
        return out

    col = pa.array(texts, pa.string())
    got = net.pooled(*W.text_bytes(col), at_once=3)
    for text, row in zip(texts, got, strict=True):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        total = np.zeros(2)
        for a in range(0, len(raw), langid.STEPS):
            part = list(raw[a:a + langid.STEPS])
            codes = part + [langid.PAD] * (langid.STEPS - len(part))
            f, b = direction(net.fwd, codes), direction(net.bwd, codes[::-1])[::-1]
            for i in range(len(part)):
                e = np.exp(net.out @ np.concatenate([f[i], b[i]]) + net.bias)
                total += e / e.sum()
        assert row == pytest.approx(total / max(1, len(raw)), abs=1e-4)


def test_classifiers_leave_further_columns_alone(spark, learnable):
    docs, labels = learnable
    names = ["l", "rate", "draw", "toxic", "lettered", "held_out", "score", "slot", "n", "count"]
    wide = docs.select("*", *[F.lit(1.5).alias(n) for n in names])
    more = labels.select("*", F.lit("x").alias("text"), F.lit(1).alias("draw"), F.lit(2).alias("lang"))
    for op, a, b in ((langid.op1, (docs,), (wide,)), (toxicity.op8, (docs, labels), (wide, more))):
        assert sorted(op(spark, *a).collect()) == sorted(op(spark, *b).collect())


def test_classifiers_on_long_and_repeated_texts(spark, learnable):
    docs, labels = learnable
    long = [(5000 + i, "the and that with for this was you " * 200_000, "en", "s", 0) for i in range(1)]
    again = docs.where("doc_id < 40").unionByName(docs.where("doc_id < 40"))
    more = docs.unionByName(again).unionByName(spark.createDataFrame(long, docs.schema))
    out = [r.asDict() for r in langid.op1(spark, more).collect()]
    assert len(out) == more.count() and {r["lang_pred"] for r in out if r["doc_id"] == 5000} == {"en"}
    for r in (toxicity.op8(spark, more, labels).collect(), langid.op1(spark, more).collect()):
        assert len({(x["doc_id"], x["score"]) for x in r if x["doc_id"] < 40}) == 40


def test_toxicity_against_plain_counts(spark, learnable):
    """Slots, their counts and the scores against sets of n-grams in plain Python."""
    docs, labels = learnable
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def grams(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        return {raw[i:i + g] for g in toxicity.GRAMS for i in range(len(raw) - g + 1)}

    def slot(gram):
        code = 0
        for b in gram:
            code = (code * 257 + b) % 2 ** 64
        mixed = W.mix(np.array([(code * 8 + len(gram)) % 2 ** 64], np.uint64))
        return int(mixed[0] >> np.uint64(64 - toxicity.FEATURE_BITS))

    plain = {i: {slot(g) for g in grams(t)} for i, t in texts.items()}
    col = pa.array(list(texts.values()), pa.string())
    for want, f in zip(plain.values(), toxicity.features(*W.text_bytes(col)), strict=True):
        assert sorted(f.tolist()) == sorted(want)
    model = toxicity.learn(spark, docs, labels)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()
             if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    n1 = sum(known.values())
    n0 = len(known) - n1
    use = set()
    for s in set().union(*plain.values()):
        c1 = sum(s in plain[i] for i, y in known.items() if y)
        c0 = sum(s in plain[i] for i, y in known.items() if not y)
        r = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
        if abs(r) >= toxicity.LEAST_RATIO and c1 + c0 >= toxicity.LEAST_DOCS:
            use.add(s)
    assert set(np.flatnonzero(model.table).tolist()) <= use and len(use) < toxicity.MOST_SLOTS
    out = {r["doc_id"]: r["score"] for r in toxicity.op8(spark, docs, labels).collect()}
    for i, slots in plain.items():
        z = sum(float(model.table[s]) for s in slots) + model.bias
        assert out[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
