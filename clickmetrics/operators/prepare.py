"""Data preparation: label text markers (T1, T2) and derive the session/pageview table.

The reference updates ``website_sessions`` in place; here cleaning is an
immutable column transform, applied before the derived table is built
(clean -> derive -> measure).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from clickmetrics.constants import DIRECT_SEARCH, DIRECT_SOURCE, MISSING_MARKER
from clickmetrics.functions.compat import label_marker
from clickmetrics.operators.joins import HOT_KEY_ROWS, skew_join
from clickmetrics.sources.schema import SESSION_PAGEVIEW_COLUMNS



def label_missing(df: DataFrame, col: str = "utm_source", marker: str = MISSING_MARKER,
                  label: str = DIRECT_SOURCE) -> DataFrame:
    """Replace the *text* marker in ``col`` by ``label``; real NULLs stay NULL."""
    return df.withColumn(col, label_marker(col, marker, label))


def clean_sessions(ws: DataFrame) -> DataFrame:
    """T1 then T2: ``utm_source`` 'NULL' -> Direct_Source, ``utm_content`` 'NULL' -> Direct_Search."""
    ws = label_missing(ws, "utm_source", MISSING_MARKER, DIRECT_SOURCE)
    return label_missing(ws, "utm_content", MISSING_MARKER, DIRECT_SEARCH)


def session_pageviews(wp: DataFrame, ws: DataFrame, hot_threshold: int = HOT_KEY_ROWS) -> DataFrame:
    """Pageviews inner-joined to their session, the 11 reference columns in order.

    The result has one row per hit, so the hits must move to their session;
    a session with more than ``hot_threshold`` hits is spread over several
    tasks by pageview id (:func:`~clickmetrics.operators.joins.skew_join`).
    """
    return skew_join(wp, ws.drop("created_at"), ["website_session_id"], "inner",
                     spread_by=["website_pageview_id"], threshold=hot_threshold).select(*SESSION_PAGEVIEW_COLUMNS)

