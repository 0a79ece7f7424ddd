"""Operators for large text-corpus pipelines.  Nothing outside this subpackage imports it."""
