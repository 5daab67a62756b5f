"""Tests of the training-data operators: a package, so that its conftest isn't the top-level one."""
