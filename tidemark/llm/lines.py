"""Line dedup: lines that many documents share go everywhere.

Lines are exploded as 128-bit hashes of their keys with their positions; documents are counted for
each hash (a document's own repeats count once, before the shuffle); the positions of lines over
the threshold return to their document, which is put together again by position. No text is
exploded, and a line that a third of all documents hold is one row per task in the count.

Defined results: a document is an id, so rows that repeat an id count as one document, and only they are
told apart before counting; rows without an id are a document each. Every row loses its own lines. A null
or empty text is one empty line. Ties do not arise. Very long texts are one row throughout; what is
exploded are hashes. An empty table gives an empty table. All columns of the input stay; those named like
the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, ascii_lower

MIN_DOCS = 10
MIN_CHARS = 1


def line_keys(text: Column) -> Column:
    """The key of each line: stripped at both ends, A-Z lowered."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(BLANKS))))


def drop_shared_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text that stays, and ``_lines``, ``_dropped``: lines before, lines gone."""
    tag = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("_tag")
    hashed = docs.select(tag, F.col(id_col).alias("_id"), line_keys(F.col(text_col)).alias("_keys"))
    hashed = hashed.select("_tag", "_id", F.transform("_keys", lambda k: F.when(
        F.char_length(k) >= min_chars,
        F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b")))).alias("_keys"))
    own = hashed.select("_id", F.explode(F.array_distinct("_keys")).alias("k")).where("k IS NOT NULL").select(
        "_id", "k.a", "k.b")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_rep")).count().where(
        "count > 1").select("_rep")
    if repeated.head(1):  # ids of several rows count once for a line
        own = own.join(repeated, F.col("_id") == F.col("_rep"), "left")
        several = own.where("_rep IS NOT NULL").select("a", "b", "_id").distinct()
        own = own.where("_rep IS NULL").select("a", "b", "_id").unionAll(several)
    often = own.groupBy("a", "b").count().where(F.col("count") >= min_docs).select("a", "b")
    places = hashed.select("_tag", "_id", F.posexplode("_keys").alias("p", "k")).where(
        "k IS NOT NULL").select("_tag", "_id", "p", "k.a", "k.b")
    gone = places.join(often, ["a", "b"]).groupBy("_tag", "_id").agg(
        F.collect_set("p").alias("_gone"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), tag)
    row = lambda c: F.col(f"_row.`{c}`")
    joined = whole.join(gone.withColumnRenamed("_id", "_doc").withColumnRenamed("_tag", "_key"),
                        (F.col("_tag") == F.col("_key"))
                        & row(id_col).eqNullSafe(F.col("_doc")), "left")
    text = F.coalesce(row(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(
        F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n"))
    results = {"_lines": F.size(lines).cast("long"),
               "_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return joined.select(
        *[kept.alias(c) if c == text_col else row(c).alias(c) for c in docs.columns if c not in results],
        *[column.alias(name) for name, column in results.items()])
