"""One registered query per operator, over its whole table, and the SQL oracles."""

from __future__ import annotations

from clickmetrics.llm import (align, bpe, fim, langid, linededup, oracles, paretomix, pfor, qda, quality, recompress, sigtree,
                              toxicity, vptree)
from clickmetrics.llm.common import read_table


def _over(table, op, *more):
    def query(spark, sf_dir):
        return op(spark, *[read_table(spark, sf_dir, t) for t in (table, *more)])

    query.__doc__ = op.__doc__
    return query


QUERIES = {
    "op1_language_id": _over("documents", langid.op1),
    "op2_line_dedup": _over("documents", linededup.op2),
    "op3_nearest_neighbours": _over("embeddings", vptree.op3),
    "op4_source_mix": _over("documents", paretomix.op4),
    "op5_ngram_jaccard_join": _over("documents", sigtree.op5),
    "op6_quality_rules": _over("documents", quality.op6),
    "op7_byte_bpe": _over("documents", bpe.op7),
    "op8_toxicity": _over("documents", toxicity.op8, "labels"),
    "op9_substring_dedup": _over("documents", recompress.op9),
    "op10_token_files": _over("documents", pfor.op10),
    "op11_token_alignment": _over("documents", align.op11),
    "op12_quality_classifier": _over("documents", qda.op12, "labels"),
    "op13_fill_in_middle": _over("documents", fim.op13),
}

ORACLE = {
    "op2_line_dedup": linededup.ORACLE,
    "op5_ngram_jaccard_join": oracles.JACCARD,
    "op6_quality_rules": oracles.QUALITY,
    "op9_substring_dedup": oracles.SUBSTRINGS,
    "op13_fill_in_middle": fim.ORACLE,
}
