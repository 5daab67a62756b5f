"""clickmetrics: web-analytics metrics over clickstream tables, as Spark DataFrame operators.

Every metric is a function ``DataFrame(s) -> DataFrame`` built from Spark's own
expressions, aggregates, joins and (bounded) windows, so Catalyst plans it and
it runs at cluster scale.  See ``clickmetrics.plans.catalog`` for the named
analyses and ``clickmetrics.sources`` for loading tables.
"""

from clickmetrics.session import get_spark, checkpoint_dir
from clickmetrics.sources.tables import WebTables

__all__ = ["get_spark", "checkpoint_dir", "WebTables"]
