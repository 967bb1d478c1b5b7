"""Document fingerprints by one-permutation MinHash, in DataFrame expressions alone.

Every shingle is hashed once; the top bits of the hash name one of 128 bins, and each bin keeps its
smallest hash. An empty bin takes over the value of another one, the first occupied in an order of
all bins that is drawn for that bin and is the same for all documents (optimal densification). Of
each value the low eight bits stay, packed into sixteen longs. Two fingerprints agree in a bin by
chance once in 256 times, and the likeness corrects for that.

Shingles have five words; words are what white space separates, in lower case. A text of fewer
words is one shingle; a null text is empty, and an empty text is one shingle without words.
Equal texts have equal fingerprints.

The neighbour of a document is the next by descending id, nulls last, equal ids by descending text;
after the last comes the first, so a single document is its own neighbour. The order is cut into
ranges by quantiles of the id, so no task sees more than a few of them; only the head of each range
travels to the end of the one before. Rows that repeat, and equal ids with equal texts, have equal
fingerprints whichever comes first. Very long texts are hashed whole, within their row. An empty table
gives an empty table. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: 2 to the power of this many bins, eight to a long.
BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 8
#: Hashes are signed, so the bins of the top bits run from -64 to 63.
_DOWN = 64 - BIN_BITS
_LOW = (1 << _DOWN) - 1
_ONES = 0x0101010101010101


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A hash for each place of a shingle, at least one."""
    split = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")),
                    r"[\x20\x09-\x0D]+")
    # the hash passes over nulls, so a short text hashes the words it has
    return let(F.transform(split, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])))


def _empty_mark(j: Column) -> Column:
    """The largest hash of a bin, which stands for none."""
    return F.shiftleft((j - BINS // 2).cast("long"), _DOWN).bitwiseOR(F.lit(_LOW))


def _densify(least: Column) -> Column:
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    full = F.filter(bins, lambda j: F.get(least, j) != _empty_mark(j))
    return F.when(F.size(F.filter(least, lambda x: x.bitwiseAND(F.lit(_LOW)) == _LOW)) == 0, least) \
        .otherwise(let(full, lambda some: F.transform(least, lambda x, i: F.when(
            x != _empty_mark(i), x).otherwise(F.get(least, F.array_min(F.transform(
                some, lambda j: F.xxhash64(i, j).bitwiseAND(F.lit(-BINS)).bitwiseOR(
                    j.cast("long")))).bitwiseAND(F.lit(BINS - 1)).cast("int"))))))


def _pack(values: Column) -> Column:
    def long(g: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(8):
            low = F.get(values, g * 8 + k).bitwiseAND(F.lit(255))
            out = out.bitwiseOR(F.shiftleft(low, 8 * k))
        return out
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), long)


def packed(text: Column) -> Column:
    """The fingerprint of a text as an array of longs."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), _empty_mark)
    return let(F.sort_array(F.concat(shingle_hashes(text), marks)), lambda s: let(
        F.filter(s, lambda x, i: (i == 0) | (
            F.shiftright(x, _DOWN) != F.shiftright(F.get(s, i - 1), _DOWN))),
        lambda least: let(_densify(least), _pack)))


def as_text(fingerprint: Column) -> Column:
    """Lowercase hex, 16 digits a long."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, from 0 to 1."""
    def differ(x: Column) -> Column:
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(_ONES)))
    off = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0),
                      lambda n, x: n + let(x, differ))
    chance = 2.0 ** -VALUE_BITS
    return F.greatest(F.lit(0.0), ((BINS - off) / BINS - chance) / (1 - chance))


def _place(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below a key. They are looked through in two steps, so many
    ranges cost each row little more than few."""
    if not cuts:
        return F.lit(0)
    wide = math.ceil(math.sqrt(len(cuts)))
    parts = [cuts[i:i + wide] for i in range(0, len(cuts), wide)]
    below = lambda some: F.size(F.filter(some, lambda c: c < key))
    ends = F.array(*[F.lit(p[-1]) for p in parts[:-1]]).cast("array<long>")
    listed = F.array(*[F.array(*map(F.lit, p)).cast("array<long>") for p in parts])
    return let(below(ends), lambda n: n * wide + below(F.get(listed, n)))


def with_neighbour(docs: DataFrame, id_col: str, text_col: str, ranges: int | None = None
                   ) -> DataFrame:
    """(id, text, fp, next_text, next_fp) of every row."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("k"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = sorted({int(x) for x in rows.approxQuantile(
        "k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    rows = rows.withColumn("r", _place(F.col("k"), cuts))
    tops = rows.groupBy("r").agg(F.max("k").alias("top"))
    heads = rows.join(F.broadcast(tops.withColumnRenamed("r", "r2")),
                      (F.col("r") == F.col("r2")) & (F.col("k") == F.col("top")), "left_semi")
    heads = heads.groupBy("r").agg(F.max("text").alias("text"))
    around = Window.orderBy(F.desc("r"))
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.col("r").alias("range"),
        F.coalesce(F.lead("text").over(around), F.first("text").over(everything)).alias("head"))
    own = rows.withColumn("fp", packed(F.col("text")))
    order = Window.partitionBy("r").orderBy(F.desc("k"), F.desc("text"))
    led = own.withColumn("next", F.lead(F.struct("text", "fp")).over(order))
    ended = led.join(heads.withColumn("head_fp", packed(F.col("head"))),
                     (F.col("r") == F.col("range")) & F.col("next").isNull(), "left")
    return ended.select("id", "text", "fp", F.coalesce("next.text", "head").alias("next_text"),
                        F.coalesce("next.fp", "head_fp").alias("next_fp"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like both and the next are.

    The edited text has the last half of the code points replaced by the next document's first."""
    rows = with_neighbour(docs, id_col, text_col)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half),
                      F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_fp", packed(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col), F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
