"""Query-log statements as column expressions: class, tables, parameters, route.

Every function takes the statement text as a column and returns a column, so a log of any size
is profiled inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide a statement's class, tested on trimmed upper case.
WRITE_PATTERN = r"^\s*(INSERT|UPDATE|DELETE|REPLACE)\s"
ANALYTIC_PATTERNS = (
    r"\s(GROUP\sBY|HAVING|ORDER\sBY|DISTINCT|LIMIT)\s",
    r"\s(SUM|AVG|COUNT|MAX|MIN)\s*\(",
    r"\sJOIN\s",
)
# What names a table, what is a placeholder, and the statements and words a log is
# filtered by; the control patterns are tested on trimmed upper case, as one.
TABLE_PATTERN = r"(?i)(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
PLACEHOLDER_PATTERN = r"\$\d+"
CONTROL_PATTERN = r"^SET |^SHOW |^BEGIN|^COMMIT|PG_STAT_STATEMENTS|PG_CATALOG"
TPCC_KEYWORDS = ("history", "order_line", "customer")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def statement_class(text: Column) -> Column:
    """OLTP for writes, OLAP for reads, else UNKNOWN (so a bare WITH is UNKNOWN)."""
    upper = F.upper(strip(text))
    analytic = F.lit(False)
    for pattern in ANALYTIC_PATTERNS:
        analytic = analytic | upper.rlike(pattern)
    return (
        F.when(upper.rlike(WRITE_PATTERN), "OLTP")
        .when(analytic | upper.startswith("SELECT"), "OLAP")
        .otherwise("UNKNOWN")
    )


def tables_referenced(text: Column) -> Column:
    """Distinct names after FROM or JOIN, sorted; comma-joined tables are not seen."""
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(text, F.lit(TABLE_PATTERN), F.lit(1))))


def positional(text: Column) -> Column:
    """``$1, $2`` placeholders rewritten to ``?``."""
    return F.regexp_replace(text, PLACEHOLDER_PATTERN, "?")


def parameter_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PLACEHOLDER_PATTERN))


def is_workload(text: Column) -> Column:
    """False for session control and catalogue statements."""
    return ~F.upper(strip(text)).rlike(CONTROL_PATTERN)


def mentions(text: Column, words: tuple[str, ...] = TPCC_KEYWORDS) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.ilike(f"%{word}%")
    return hit


def route(text: Column) -> Column:
    """Which tier runs the statement: writes and locking reads hot, other reads hybrid."""
    kind = statement_class(text)
    return (
        F.when((kind == "OLTP") | text.ilike("%for update%"), "hot")
        .when(kind == "OLAP", "hybrid")
        .otherwise("none")
    )


def dummy_arguments(text: Column) -> Column:
    """One argument of value 1 per placeholder."""
    return F.array_repeat(F.lit(1), parameter_count(text))
