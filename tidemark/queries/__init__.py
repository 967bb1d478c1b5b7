"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.queries import changes, feed, hybrid, lifecycle, log, tiering

_GROUPS = (hybrid, lifecycle, tiering, changes, feed, log)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: run for group in _GROUPS for name, run in group.QUERIES.items()}
ORACLES: dict[str, str] = {
    name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
