"""Migration rounds driven by a stream of ticks, with its checkpoint as the record of rounds done."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.extract import TablePolicy
from tidemark.plans.migrate import run_batch
from tidemark.plans.store import TierStore
from tidemark.streaming.ingest import stream_id


def clock(spark: SparkSession, start: datetime, every_seconds: int) -> DataFrame:
    """One tick for each interval since ``start`` (UTC), one to a micro-batch: a run that was down goes on
    with the round that it missed."""
    millis = int((start - datetime(1970, 1, 1)).total_seconds() * 1000)
    ticks = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1)
             .option("startTimestamp", millis).option("advanceMillisPerBatch", every_seconds * 1000).load())
    zone = spark.conf.get("spark.sql.session.timeZone")
    local = F.col("timestamp").cast("timestamp_ntz")
    return ticks.select(F.convert_timezone(F.lit(zone), F.lit("UTC"), local).alias("at"))


def run_stream(ticks: DataFrame, store: TierStore, policies: Sequence[TablePolicy], checkpoint: str,
               delay_minutes: int = 1, every: str | None = None) -> StreamingQuery:
    """Start the rounds: each micro-batch of ``ticks`` (a column ``at``) is one migration batch as of its
    last tick.

    The commit of a round notes the stream and the micro-batch. One that is run again after a failure
    is passed over if it was published; if not, the same round is run, as of the same moment. Without
    ``every`` all ticks there are run and the query ends; with it a round starts at that interval.
    Give ticks one to a micro-batch to run every round, or all at once to catch up in one.
    """
    names = {p.relname for p in policies}
    spark = ticks.sparkSession

    def run(batch: DataFrame, epoch: int) -> None:
        at = batch.agg(F.max("at")).first()[0]
        if at is None:
            return
        source = stream_id(spark, checkpoint)
        states = store.state()[1]
        if any((states[n].epochs or {}).get(source) == epoch for n in names & states.keys()):
            return
        run_batch(store, policies, at, delay_minutes, note={source: epoch})

    writer = ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
