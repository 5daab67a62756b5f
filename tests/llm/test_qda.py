"""The quadratic discriminant against plain formulas, its statistics against plain counts, held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clickmetrics.llm import qda
from clickmetrics.llm import words as W

from .conftest import SCHEMA, prose

TEXTS = ["", "a", "Hello, World! Hello,", "x1 ## 22\nx1 ## 22\n\n", "éü ß DE", "one two three four five one two three four", " \n\t "]


def odds(part, whole):
    return math.log((part + 0.5) / (whole - part + 0.5))


def plain(text):
    raw = text.encode()
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    lens = [len(w) for w in words]
    n = len(words)
    mean = sum(lens) / n if n else 0
    body = [b for b in raw if b not in b" \t\n\x0b\x0c\r"]
    kinds = Counter("lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else
                    "symbol" if b in b"#*$%&|<>" else "mark" if b in b".,;:!?'\"()-" else "high" if b > 127 else "other" for b in body)
    letterless = sum(not re.search(rb"[A-Za-z\x80-\xff]", w) for w in words)
    marked = sum(w[-1] in b"#*$%&|<>.,;:!?'\"()-" for w in words)
    again = sum(words.count(w) > 1 for w in words)
    runs = [tuple(words[i:i + 4]) for i in range(n - 3)]
    cells = Counter(b & 63 for b in raw)
    entropy = -sum(c / len(raw) * math.log2(c / len(raw)) for c in cells.values()) if raw else 0
    return [math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(max(0, sum(x * x for x in lens) / n - mean * mean)) if n else 0),
            math.log1p(max(lens, default=0)), *[odds(kinds[k], len(body)) for k in ("lower", "upper", "digit", "symbol", "mark", "other")],
            odds(raw.count(b"!"), len(body)), odds(letterless, n), odds(marked, n), odds(again, n),
            odds(sum(runs.count(r) > 1 for r in runs), len(runs)), math.log1p(n / (text.count("\n") + 1)), entropy]


def test_statistics():
    x = qda.statistics(*W.text_bytes(pa.array([*TEXTS, *reversed(TEXTS)])))
    assert x.shape[1] == len(qda.STATISTICS)
    assert np.allclose(x[:len(TEXTS)], [plain(t) for t in TEXTS], atol=1e-6)
    assert np.allclose(x[:len(TEXTS)], x[len(TEXTS):][::-1])


def test_density_is_the_regularised_gaussian():
    rng = np.random.default_rng(3)
    d = len(qda.STATISTICS)
    x = {0: rng.normal(1, 2, (300, d)), 1: rng.normal(0, 1, (700, d)) @ rng.normal(0, 1, (d, d)) / 4}
    first = {k: (len(v), v.mean(axis=0), v.T @ v / len(v)) for k, v in x.items()}
    center, reach = qda._span(first)
    held = {k: np.clip(v, center - reach, center + reach) for k, v in x.items()}
    model = qda.fit(first, {k: (len(v), v.mean(axis=0), v.T @ v / len(v)) for k, v in held.items()}, center, reach)
    cov = {k: np.cov(v.T, bias=True) for k, v in held.items()}
    pooled = 0.3 * cov[0] + 0.7 * cov[1]
    logs = []
    for k in (0, 1):
        c = (1 - qda.POOL) * cov[k] + qda.POOL * pooled
        c = (1 - qda.DIAGONAL) * c + qda.DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.diag(np.diag(pooled))
        z = np.vstack([held[0], held[1]]) - held[k].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z) + np.linalg.slogdet(c)[1]))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0] + math.log(700 / 300))))
    assert np.allclose(model.scores(np.vstack([x[0], x[1]])), want, atol=1e-8)


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = prose(i, 20 + i % 90)
        rows.append((i, text if good else re.sub(r"(\w+)", r"\1#$", text), "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark, labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in qda.op12(spark, docs, labels).collect()}
    assert len(got) == 600
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_learned(spark, labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in qda.op12(spark, docs, x).collect()} for x in (labels, turned))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_edges(spark, docs, empty, labelled):
    labels = labelled[1]
    none = labels.limit(0)
    assert qda.op12(spark, empty, labels).count() == 0 and qda.op12(spark, empty, none).count() == 0
    assert {r["score"] for r in qda.op12(spark, docs, none).collect()} == {0.5}
    assert {r["score"] for r in qda.op12(spark, docs, labels.where("quality = 1")).collect()} == {1.0}
    wide = docs.withColumn("quality", docs["lang"]).withColumn("x", docs["source"]).withColumn("held_out", docs["source"])
    awkward = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 7), (4, 1), (5, 0), (9, 1), (12, 1)], "doc_id long, quality int")
    out = qda.op12(spark, wide, awkward.withColumn("text", awkward["doc_id"]).withColumn("x", awkward["doc_id"]))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    same = [r["score"] for r in out.where("doc_id = 11").collect()]
    assert len(same) == 2 and same[0] == same[1]
    truth = labels.withColumn("quality", labels["quality"] == 1)
    assert qda.op12(spark, labelled[0], truth).where("score > 0.9").count() > 300
