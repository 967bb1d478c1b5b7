"""Statement-log jobs. The log is derived from the events table: one call per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import statements as S
from tidemark.plans.workload import profile, top_statements, unseen
from tidemark.queries.staging import given

# The statement that an event stands for, the same text in both SQL dialects.
STATEMENT = """
CASE
  WHEN event_type = 'view' THEN
    'SELECT SUM(ol_amount) FROM order_line WHERE ol_w_id = $1 AND ol_i_id = ' || CAST(user_id AS STRING)
  WHEN event_type = 'click' THEN
    '  update customer set c_balance = 0 where c_id = ' || CAST(user_id AS STRING)
  WHEN event_type = 'signup' THEN
    'INSERT INTO history SELECT c_id FROM customer WHERE c_id = ' || CAST(user_id AS STRING) || ' GROUP BY c_id'
  WHEN event_type = 'purchase' THEN
    'SELECT * FROM oorder o JOIN customer c ON o.o_c_id = c.c_id WHERE c.c_id = $1 AND o.o_id > $2 AND o.o_w_id = ' || CAST(user_id AS STRING)
  WHEN value < 10 THEN
    'SELECT c_id FROM customer WHERE c_id = ' || CAST(user_id AS STRING) || ' FOR UPDATE'
  WHEN value < 30 THEN 'SET application_name = customer_' || CAST(user_id AS STRING)
  WHEN value < 60 THEN
    'WITH t AS (SELECT c_id FROM customer) SELECT * FROM t WHERE c_id = ' || CAST(user_id AS STRING)
  ELSE 'SELECT query FROM pg_stat_statements WHERE query = ''customer'' AND userid = ' || CAST(user_id AS STRING)
END"""

POLLED = "TIMESTAMP_NTZ '2024-01-15 00:00:00'"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events").select(F.expr(STATEMENT).alias("query"), "ts")


def statement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).groupBy("query").agg(F.count(F.lit(1)).alias("calls"))


def _profile(*columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = profile(statement_log(spark, sf_dir))
        log = log.withColumn("tables", F.concat_ws(",", "tables"))
        return log.select("query", "calls", *columns)
    return run


def log_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_log(spark, sf_dir).where(S.is_workload(F.col("query")))


def log_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_statements(statement_log(spark, sf_dir))


def log_top_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where control statements are the most called: they take places and are left out."""
    log = statement_log(spark, sf_dir)
    busy = F.when(F.col("query").startswith("SET"), 1000).otherwise(0)
    return top_statements(log.withColumn("calls", F.col("calls") + busy))


def log_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the second half of the month that the first half did not have."""
    calls = _calls(spark, sf_dir)
    return unseen(calls.where(f"ts > {POLLED}"), calls.where(f"ts <= {POLLED}"))


def log_dummy_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = statement_log(spark, sf_dir)
    return log.select("query", S.positional(F.col("query")).alias("text"), F.concat_ws(
        ",", S.dummy_arguments(F.col("query")).cast("array<string>")).alias("args"))


def log_class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements and calls per class and route."""
    return profile(statement_log(spark, sf_dir)).groupBy("class", "route").agg(
        F.count(F.lit(1)).alias("statements"), F.sum("calls").alias("calls"))


QUERIES = {
    "log_classify": _profile("class"),
    "log_tables": _profile("tables"),
    "log_normalize": _profile("normalized", "params"),
    "log_route": _profile("route"),
} | {f.__name__: f for f in (log_valid, log_top, log_top_control, log_new, log_dummy_args, log_class_totals)}

_LOG = (f"WITH calls AS (SELECT {STATEMENT} AS query, ts FROM events), "
        "log AS (SELECT query, COUNT(*) AS calls, "
        r"upper(regexp_replace(query, '^\s+|\s+$', '', 'g')) AS q FROM calls GROUP BY query), ")
_CLASS = (r"CASE WHEN regexp_matches(q, '^\s*(INSERT|UPDATE|DELETE|REPLACE)\s') THEN 'OLTP' "
          r"WHEN regexp_matches(q, '\s(GROUP\sBY|HAVING|ORDER\sBY|DISTINCT|LIMIT)\s') "
          r"OR regexp_matches(q, '\s(SUM|AVG|COUNT|MAX|MIN)\s*\(') "
          r"OR regexp_matches(q, '\sJOIN\s') OR starts_with(q, 'SELECT') THEN 'OLAP' "
          "ELSE 'UNKNOWN' END")
_CLASSED = (_LOG + f"classed AS (SELECT *, {_CLASS} AS class FROM log), routed AS (SELECT *, "
            "CASE WHEN class = 'OLTP' OR q LIKE '%FOR UPDATE%' THEN 'hot' "
            "WHEN class = 'OLAP' THEN 'hybrid' ELSE 'none' END AS route FROM classed) ")
_PARAMS = r"len(regexp_extract_all(query, '\$\d+'))"
_WORKLOAD = "NOT regexp_matches(q, '^SET |^SHOW |^BEGIN|^COMMIT|PG_STAT_STATEMENTS|PG_CATALOG')"

ORACLES = {
    "log_classify": _CLASSED + "SELECT query, calls, class FROM routed",
    "log_route": _CLASSED + "SELECT query, calls, route FROM routed",
    "log_class_totals": _CLASSED + "SELECT class, route, COUNT(*) AS statements, "
                                   "CAST(SUM(calls) AS BIGINT) AS calls FROM routed GROUP BY ALL",
    "log_tables": _CLASSED + r"""SELECT query, calls, array_to_string(list_sort(list_distinct(
        regexp_extract_all(query, '(?i)(?:FROM|JOIN)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1))), ',')
        AS tables FROM routed""",
    "log_normalize": _CLASSED + r"""SELECT query, calls,
        regexp_replace(regexp_replace(query, '^\s+|\s+$', '', 'g'), '\$\d+', '?', 'g') AS normalized,
        """ + _PARAMS + " AS params FROM routed",
    "log_valid": _CLASSED + f"SELECT query, calls FROM routed WHERE {_WORKLOAD}",
    "log_top": _CLASSED + f""", top AS (SELECT query, calls, q FROM routed
        WHERE query ILIKE '%history%' OR query ILIKE '%order_line%' OR query ILIKE '%customer%'
        ORDER BY calls DESC, query LIMIT 50)
        SELECT query, calls FROM top WHERE {_WORKLOAD}""",
    "log_top_control": _CLASSED + f""", top AS (SELECT query, q, calls
          + CASE WHEN starts_with(query, 'SET') THEN 1000 ELSE 0 END AS calls FROM routed
        WHERE query ILIKE '%history%' OR query ILIKE '%order_line%' OR query ILIKE '%customer%'
        ORDER BY calls DESC, query LIMIT 50)
        SELECT query, CAST(calls AS BIGINT) AS calls FROM top WHERE {_WORKLOAD}""",
    "log_new": _CLASSED + """SELECT DISTINCT query FROM calls
        WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND query NOT IN
        (SELECT query FROM calls WHERE ts <= TIMESTAMP '2024-01-15 00:00:00')""",
    "log_dummy_args": _CLASSED + r"SELECT query, regexp_replace(query, '\$\d+', '?', 'g') AS text, "
                                 f"rtrim(repeat('1,', {_PARAMS}), ',') AS args FROM routed",
}
