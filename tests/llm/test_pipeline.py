"""The pipeline on a small corpus, stage by stage, and its registration."""

from __future__ import annotations

import os
import tempfile

import corpus_pipeline
from clickmetrics.llm import quality, queries, sigtree
from clickmetrics.session import checkpoint_dir


def test_registered():
    import __spark_entry__ as E

    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(queries.ORACLE) <= set(E.oracle_sql())
    assert [int(n[2:n.index("_")]) for n in queries.QUERIES] == list(range(1, 14))


def test_stages(spark, docs):
    wide = docs.withColumn("copies", docs["source"])
    cols = wide.columns
    df = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = df
        df = stage(spark, before, "unused")
        assert df.columns == cols, name
        path = os.path.join(tempfile.mkdtemp(prefix="stage-", dir=checkpoint_dir(spark)), "out")
        df.write.parquet(path)
        df = spark.read.parquet(path)
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.verdicts(spark, before).filter("kept").collect()}
            assert {r["doc_id"] for r in df.collect()} == kept
        if name == "line dedup":
            assert df.count() == before.count()
            assert not [r for r in df.collect() if "shared footer" in (r["text"] or "")]
            assert all(r["n_chars"] == len(r["text"]) for r in df.collect() if r["text"] is not None)
        if name == "n-gram Jaccard join":
            groups = {r["component_id"] for r in sigtree.op5(spark, before).collect() if r["component_id"] is not None}
            assert sorted(r["doc_id"] for r in df.collect() if r["doc_id"] is not None) == sorted(groups)
        if name == "mixing sources":
            assert {r["doc_id"] for r in df.collect()} <= {r["doc_id"] for r in before.collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, df, "unused")
    assert out.count() == df.count()


def test_empty(spark, empty):
    df = empty
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "unused")
    assert df.count() == 0
