"""Operators of a training-data pipeline over ``documents``, ``embeddings`` and ``labels``.

Nothing else in the package imports this one.  Every operator takes DataFrames and returns
DataFrames; :mod:`clickmetrics.llm.queries` registers one thin query per operator.
"""
