"""Policies, and the settled rows they select for moving."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import (
    EPOCH,
    after,
    in_window,
    local_bound,
    local_to_utc,
    ntz,
    outside_window,
)
from tidemark.operators.keyed import keyed_upsert

# The categories a policy may have.
CATEGORIES = ("append_only", "update_once")


@dataclass(frozen=True)
class CloseBy:
    """A parent row settles when the last of its child rows does."""

    child: str
    on: tuple[tuple[str, str], ...]  # (parent column, child column)
    ts_column: str


@dataclass(frozen=True)
class TablePolicy:
    relname: str
    category: str
    ts_column: str
    pk_columns: tuple[str, ...]
    enabled: bool = True
    close_by: CloseBy | None = None
    zone: str | None = None
    unique: bool = True  # whether pk_columns are a true key
    cluster: tuple[str, ...] = ()  # columns that moved rows are kept together by


# The policies of the order-processing schema and its time zone.
TPCC_ZONE = "Asia/Seoul"
TPCC_POLICIES = (
    TablePolicy("orders", "update_once", "o_entry_d", ("o_w_id", "o_d_id", "o_id"),
                close_by=CloseBy("order_line", (("o_w_id", "ol_w_id"), ("o_d_id", "ol_d_id"),
                                                ("o_id", "ol_o_id")), "ol_delivery_d"),
                zone=TPCC_ZONE),
    TablePolicy("order_line", "update_once", "ol_delivery_d",
                ("ol_w_id", "ol_d_id", "ol_o_id", "ol_number"), zone=TPCC_ZONE),
    TablePolicy("hhistory", "append_only", "h_date",
                ("h_c_id", "h_c_d_id", "h_c_w_id", "h_date"), zone=TPCC_ZONE, unique=False),
)

POLICY_SCHEMA = T.StructType([
    T.StructField("relname", T.StringType(), False),
    T.StructField("category", T.StringType()),
    T.StructField("ts_column", T.StringType(), False),
    T.StructField("pk_columns", T.ArrayType(T.StringType()), False),
    T.StructField("enabled", T.BooleanType()),
])
WATERMARK_SCHEMA = T.StructType([
    T.StructField("relname", T.StringType(), False),
    T.StructField("last_ts", T.TimestampNTZType(), False),
])


def policy_frame(spark: SparkSession, policies: list[TablePolicy] | tuple[TablePolicy, ...]):
    return spark.createDataFrame(
        [(p.relname, p.category, p.ts_column, list(p.pk_columns), p.enabled) for p in policies],
        POLICY_SCHEMA)


def upsert_policies(base: DataFrame, changes: DataFrame) -> DataFrame:
    return keyed_upsert(base, changes, ["relname"])


def active_policies(policies: DataFrame) -> DataFrame:
    """Enabled (a missing flag counts as enabled) and of a known category."""
    return policies.where(F.coalesce("enabled", F.lit(True)) & F.col("category").isin(*CATEGORIES))


def rejected_policies(policies: DataFrame) -> DataFrame:
    return policies.where(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)))


def with_watermark(policies: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Each policy with its high-water mark; a table never moved starts at the epoch."""
    return policies.join(watermarks.select("relname", "last_ts"), "relname", "left").withColumn(
        "last_ts", F.coalesce("last_ts", ntz(EPOCH)))


def settled(policy: TablePolicy, last: datetime, until: datetime):
    """The row condition of a policy that looks at its own timestamp only.

    An ``update_once`` row without its timestamp has not had its update yet: no window holds it.
    """
    return in_window(F.col(policy.ts_column), last, until, policy.zone)


def unsettled(policy: TablePolicy, last: datetime, until: datetime):
    """The rows that :func:`settled` leaves."""
    return outside_window(F.col(policy.ts_column), last, until, policy.zone)


def closed_parents(policy: TablePolicy, parent: DataFrame, child: DataFrame, last: datetime,
                   until: datetime) -> DataFrame:
    """Parent rows whose latest child timestamp lies in the window.

    Children at or before ``last`` cannot be the latest one of a parent in the window, so the
    lower bound goes to the child scan; children after ``until`` must stay, since they hold
    their parent back. Each task reduces its children to one row per parent before the exchange.
    """
    close, zone = policy.close_by, policy.zone
    ts = F.col(close.ts_column)
    last_ts = ts
    if local_bound(last, zone) is None or local_bound(until, zone) is None:
        last_ts, zone = local_to_utc(ts, zone), None
    last_child = (
        child.where(ts.isNotNull() & after(ts, last, policy.zone))
        .groupBy(*[F.col(c).alias(p) for p, c in close.on])
        .agg(F.max(last_ts).alias("_closed_at"))
        .where(in_window(F.col("_closed_at"), last, until, zone))
    )
    on = [p for p, _ in close.on]
    return parent.join(last_child.select(*on), on, "left_semi")


def extract(policy: TablePolicy, hot: DataFrame, last: datetime, until: datetime,
            child: DataFrame | None = None) -> DataFrame:
    """The rows to move: the category and ``close_by`` of the policy choose the rule."""
    if policy.category not in CATEGORIES:
        raise ValueError(f"{policy.relname}: unknown category {policy.category!r}")
    if policy.close_by is not None:
        return closed_parents(policy, hot, child, last, until)
    return hot.where(settled(policy, last, until))

