"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled order that is the same in each run. A document's
virtual finish time is the words its source has sent up to and including it, over the source's
target; sources that get more than they hold go round again, up to three times. All documents
together, range-sorted by finish time and cut off at the budget, are the mix: each source comes as
near to its target as whole documents allow.

Targets share the budget by weight. None exceeds ``rounds`` times its source's size; what that
leaves is shared by weight among the others until none is above. In closed form: with sources by
rising ratio of limit to weight, the level rises until the budget is met.

Running sums never pass through one task: a source's order is cut into ranges of hashes and finish
times into intervals, whose totals are summed first. Only the sources (one row each), the totals of
ranges, and the interval that holds the cut are ordered as wholes.

Defined results: a null text has size 0, a null source is a source of its own, last in order. Rows
with the same id and source are taken together, and ties in finish time go by source and shuffle key.
Documents of size 0 do not queue, whole sources of them included: each is taken once, adds nothing, and
stands at a place in the mix that is drawn from its id. Of a very long text only the number of words
counts. A null id is an id. Other columns stay in the mix, whatever their names. An empty table gives
an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, word_count

WEIGHTS = (1, 2, 3)
ROUNDS = 3
#: Rows that a range of hashes or an interval of finish times should hold.
RANGE = 4096
#: Hexadecimal digits of the shuffle key, and how many values they have.
DIGITS = 12
KEYS = 16 ** DIGITS


def shuffle_key(id_col: str) -> Column:
    """A place in the shuffled order: the first digits of the id's MD5."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, target) from (source, size); one row for each source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = sums.withColumn("weight", weight).withColumn(
        "limit", (rounds * F.col("source_size")).cast("double")).withColumn(
        "level", (F.sum("source_size").over(whole)
                  - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that stays below its limit sets the level for itself and all behind it
    stays = F.col("level") * F.col("weight") <= F.col("limit")
    level = level.withColumn("at", F.min(F.when(stays, F.struct(
        (F.col("source_size") / F.col("weight")).alias("ratio"), F.col("level")))).over(whole))
    return level.select("source", "source_size", F.least(
        F.col("limit"), F.col("weight") * F.col("at.level")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(id, source, _key, size, source_size, target, repeats, finish) of every row of ``docs``;
    ``finish`` is that of the first time."""
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size"),
                               shuffle_key(id_col).alias("_key")), "sizes")
    share = stored(targets(sized, weights, rounds), "targets")
    ranges = max(1, sized.count() // RANGE)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    unit = sized.where("size > 0").groupBy("source", "_key").agg(F.sum("size").alias("size")).withColumn(
        "range", F.floor(F.col("_key") / (KEYS // ranges + 1)))
    totals = unit.groupBy("source", "range").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s2"), F.col("range").alias("r2"),
                           F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("_key")
    sent = unit.withColumn("inside", F.sum("size").over(inside)).join(
        totals, same("source", "s2") & (F.col("range") == F.col("r2"))).drop("s2", "r2")
    sent = sent.join(share.withColumnRenamed("source", "s3"), same("source", "s3")).drop("s3")
    sent = sent.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    finish = F.when(F.col("target") > 0, (
        F.col("before") + F.col("inside") + F.col("round") * F.col("source_size")) / F.col("target")) \
        .otherwise(F.col("round").cast("double"))
    queue = stored(sent.select("source", "_key", "size", "round", finish.alias("finish")), "queue")

    # finish times are cut into intervals; the budget runs out in one of them
    budget = share.agg(F.sum("source_size")).first()[0] or 0
    cuts = F.floor(F.col("finish") * ranges)
    spans = queue.groupBy(cuts.alias("span")).agg(F.sum("size").alias("total"))
    so_far = spans.withColumn("upto", F.sum("total").over(Window.orderBy("span")))
    last = so_far.where(F.col("upto") > budget).orderBy("span").select(
        "span", (F.col("upto") - F.col("total")).alias("before")).first()
    if last is None:
        taken = queue
    else:
        order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "_key", "round")
        rest = queue.where(cuts == last["span"]).withColumn("upto", F.sum("size").over(order))
        within = rest.where(F.col("upto") <= budget - last["before"])
        taken = queue.where(cuts < last["span"]).unionByName(within.drop("upto"))
    chosen = taken.groupBy("source", "_key").agg(F.count("*").alias("repeats"),
                                                 F.min("finish").alias("finish"))
    chosen = chosen.select(F.col("source").alias("s4"), F.col("_key").alias("k4"), "repeats", "finish")
    empty = F.col("size") == 0
    return sized.join(chosen, same("source", "s4") & (F.col("_key") == F.col("k4")), "left").join(
        share.withColumnRenamed("source", "s5"), same("source", "s5")).select(
        "id", "source", "_key", "size", "source_size", "target",
        F.coalesce("repeats", F.when(empty, 1).otherwise(0)).cast("long").alias("repeats"),
        F.coalesce("finish", F.when(empty, F.col("_key") / KEYS)).alias("finish"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
          ) -> DataFrame:
    """The rows of the mix, a document as often as it is taken, range-sorted by finish time."""
    chosen = mix(docs, id_col, text_col, source_col).where("repeats > 0").select(
        F.col("source").alias("_s"), F.col("_key").alias("_k"), "repeats", "finish",
        F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).otherwise(1.0).alias("_step")
    ).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), shuffle_key(id_col).alias("_key"),
                       F.col(source_col).alias("_source")).join(
        chosen, (F.col("_key") == F.col("_k")) & F.col("_source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_round", F.explode(F.sequence(F.lit(0), (F.col("repeats") - 1).cast("int"))))
    return rows.orderBy(F.col("finish") + F.col("_round") * F.col("_step"), "_key").select("_row.*")
