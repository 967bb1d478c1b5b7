"""Foreign keys: the order of tables by what they refer to, and what must move with what."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GOES = "_goes"


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of ``child`` refer to ``parent_columns`` of ``parent``."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def parents_first(references: Sequence[ForeignKey], tables: Iterable[str] = ()) -> list[str]:
    """All tables, each after those it refers to; rows are added in this order and deleted in the
    reverse. A table that refers to itself is one of its own place; a longer circle is an error."""
    graph = TopologicalSorter({t: set() for t in tables})
    for ref in references:
        graph.add(ref.child, *({ref.parent} - {ref.child}))
    return list(graph.static_order())


def dependents(references: Sequence[ForeignKey], tables: Iterable[str]) -> set[str]:
    """The tables and all that refer to them, directly or through others."""
    found = set(tables)
    for name in parents_first(references):
        if any(r.child == name and r.parent in found for r in references):
            found.add(name)
    return found


def marked(rows: DataFrame, goes, moving: Sequence[tuple[ForeignKey, DataFrame]]) -> DataFrame:
    """``rows`` with ``_goes``: those that the condition selects, and those that refer to a row that
    moves. ``moving`` gives for each reference the parent rows that do. The rows are the left side of
    each join, so a parent with very many children can be split at run time."""
    out = rows.withColumn(_GOES, F.coalesce(goes, F.lit(False)))
    for ref, parents in moving:
        keys = parents.select(*[F.col(p).alias(c) for c, p in zip(
            ref.columns, ref.parent_columns, strict=True)]).distinct().withColumn("_with", F.lit(True))
        out = out.join(keys, list(ref.columns), "left").withColumn(
            _GOES, F.col(_GOES) | F.coalesce("_with", F.lit(False))).drop("_with")
    return out.select(*rows.columns, _GOES)


def divided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(stay, go)`` of marked rows."""
    return rows.where(~F.col(_GOES)).drop(_GOES), rows.where(F.col(_GOES)).drop(_GOES)
