"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

1. A window is ten consecutive words of an item. Of the six five-word grams of a window the one with
   the smallest hash is its fingerprint, at the first place where it stands, so equal windows have
   equal fingerprints wherever they are: every span of ten words that a document shares is found.
   An item of fewer words is one window, with grams of half its length.
2. In each document the fingerprints that a table of bits lets through (those of all items, and few others)
   are kept with the words around them, all that a window with that fingerprint can cover.
3. They are joined with the items' fingerprints, and hits are extended: the windows around a hit that are
   windows of an item, word by word. Spans are merged, and documents that hold the same windows share one
   lookup of the items.

Texts are read once; from then on only hits move. Keys that very many documents hold meet the items in a
broadcast join, or beyond ``BROADCAST`` rows on the items' side in a join by a salted key.

Defined results: a word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z. A null or empty text
has no words and no hits; an item without words has no window; an item without an id makes words hit and
is not listed, and rows that repeat an id are one item. Rows of documents that repeat give equal rows. Ties
between grams go to the first. Very long texts are one row throughout, of which only hits are exploded.
Other columns of documents stay, but for those named like the results. An empty table gives an empty
result, and no items no hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, stored
from tidemark.llm.fingerprints import let

WINDOW = 10
#: Rows of the items' side that are broadcast, at most; salts of a key beyond that.
BROADCAST = 200_000
SALTS = 16
#: Bits for each fingerprint in the table, and the most bits (as powers of two) that it has.
_BITS_EACH, _LEAST, _MOST = 64, 12, 23

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    body = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " "))


def shape(window: int) -> tuple[int, int]:
    """(words of a gram, grams of a window)."""
    gram = (window + 1) // 2
    return gram, window - gram + 1


def grams(found: Column, window: int) -> Column:
    """A hash for each place of a gram."""
    gram = shape(window)[0]
    return let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (gram - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, gram)])))


def least_grams(g: Column, window: int) -> Column:
    """The fingerprint of each place of a window."""
    n = shape(window)[1]
    first = F.slice(g, 1, F.greatest(F.size(g) - (n - 1), F.lit(0)))
    return F.transform(first, lambda x, i: F.least(x, *[F.get(g, i + k) for k in range(1, n)])) if n > 1 else first


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, length, window, mark) of every window of every item."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("_words"))
    rows = stored(rows.where(F.size("_words") > 0), "item-words")
    length = F.least(F.size("_words"), F.lit(window))
    lengths = [r[0] for r in rows.select(length).distinct().collect()]  # at most ``window``
    out = None
    for n in sorted(lengths) or [window]:
        marks = least_grams(grams(F.col("_words"), n), n)
        one = rows.where(length == n).select("item", F.col("_words").alias("w"), F.posexplode(marks).alias("s", "mark"))
        one = one.select("item", F.lit(n).alias("length"),
                         F.array_join(F.slice("w", F.col("s") + 1, n), " ").alias("window"), "mark")
        out = one if out is None else out.unionByName(one)
    return out


def _bits(marks: DataFrame, count: int) -> tuple[Column, int]:
    """The table that lets marks through: bit ``mark mod size``, 64 to a long."""
    power = min(_MOST, max(_LEAST, (count * _BITS_EACH).bit_length()))
    at = F.col("mark").bitwiseAND(F.lit((1 << power) - 1))
    rows = marks.groupBy(F.shiftright(at, 6).alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    table = [0] * (1 << (power - 6))
    for i, v in rows.collect():  # as many rows as the table has entries, at most
        table[i] = v
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>"), power


def _passes(mark: Column, table: Column, power: int) -> Column:
    at = mark.bitwiseAND(F.lit((1 << power) - 1))
    return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _candidates(found: Column, window: int, table: Column, power: int) -> Column:
    """Fingerprints that the table lets through: (length, mark, from, context), the words that windows with
    the fingerprint can cover, from word ``from``."""
    gram, n = shape(window)

    def of(w: Column, g: Column) -> Column:
        places = F.transform(least_grams(g, window), lambda m, s: F.when(_passes(m, table, power), F.struct(
            m.alias("mark"),
            (s + F.array_position(F.slice(g, s + 1, n), m).cast("int") - 1).alias("at"))))
        places = F.array_distinct(F.filter(places, lambda p: p.isNotNull()))
        return F.transform(places, lambda p: let(F.greatest(p["at"] - (n - 1), F.lit(0)), lambda start: F.struct(
            F.lit(window).alias("length"), p["mark"].alias("mark"), start.alias("start"),
            F.slice(w, start + 1, p["at"] - start + gram + n - 1).alias("context"))))

    return let(found, lambda w: let(grams(w, window), lambda g: of(w, g)))


def _lookup(rows: DataFrame, known: DataFrame, on: list[str], how: str, few: bool) -> DataFrame:
    """Join with the items' side, which has each key once; keys of ``rows`` may be hot."""
    if few:
        return rows.join(F.broadcast(known), on, how)
    salt = F.pmod(F.xxhash64("_a", "_b", "start"), F.lit(SALTS))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(known.hint("merge"), [*on, "_salt"], how).drop("_salt")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  broadcast: int = BROADCAST, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those to ``keep``) with ``_n_words``, ``_spans`` (array of start, end: words
    inside a window of an item) and ``_items`` (sorted ids of the items with such windows, as strings)."""
    listed = stored(item_windows(items, item_id_col, item_text_col, window), "item-windows")
    marks = listed.select("length", "mark").distinct()
    windows = listed.select("length", "window").distinct()
    n_marks, n_windows = marks.count(), windows.count()
    few = max(n_marks, n_windows) <= broadcast
    table, power = _bits(marks, n_marks)
    lengths = [r[0] for r in listed.select("length").distinct().collect()]

    # one pass over the texts
    key = [F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("_a"),
           F.xxhash64(F.lit(1), F.col(id_col).cast("string"), F.col(text_col)).alias("_b")]
    results = ("_n_words", "_spans", "_items")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    none = F.array().cast("array<struct<length:int,mark:long,start:int,context:array<string>>>")
    found = let(words(F.col(text_col)), lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        F.concat(none, *[_candidates(w, n, table, power) for n in sorted(lengths)]).alias("c")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *key, found.alias("_f"))
    rows = stored(rows.select("_row", "_a", "_b", F.col("_f.n").alias("_n"), F.col("_f.c").alias("_c")), "grams")

    # fingerprints of both sides, and the windows around hits
    hits = rows.select("_a", "_b", F.explode("_c").alias("c")).select("_a", "_b", "c.*")
    hits = _lookup(hits, marks, ["length", "mark"], "left_semi", few)
    around = F.transform(F.sequence(F.lit(0), F.size("context") - F.col("length")), lambda k: F.struct(
        (F.col("start") + k).alias("start"),
        F.array_join(F.slice("context", k + 1, F.col("length")), " ").alias("window")))
    hits = hits.where(F.size("context") >= F.col("length")).select(
        "_a", "_b", "length", F.explode(around).alias("w")).select("_a", "_b", "length", "w.*").distinct()
    hits = stored(_lookup(hits, windows, ["length", "window"], "inner", few).select(
        "_a", "_b", "start", (F.col("start") + F.col("length")).alias("end"), "window"), "hits")

    # spans, and the items of each set of windows
    by_start = Window.partitionBy("_a", "_b").orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    spans = hits.withColumn("new", new).withColumn("nth", F.sum("new").over(
        by_start.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_a", "_b", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("_a", "_b").agg(F.sort_array(F.collect_list(F.struct(
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("_spans"))
    sets = hits.groupBy("_a", "_b").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    sets = sets.withColumn("_set", F.sha2(F.array_join("windows", "|"), 256))
    distinct = sets.groupBy("_set").agg(F.first("windows").alias("windows"))
    named = distinct.select("_set", F.explode("windows").alias("window")).join(
        listed.select("window", "item").distinct().hint("merge"), "window").where("item IS NOT NULL").groupBy(
        "_set").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    per_doc = spans.join(sets.select("_a", "_b", "_set"), ["_a", "_b"]).join(named, "_set", "left").select(
        F.col("_a").alias("_x"), F.col("_b").alias("_y"), "_spans", "_items")
    out = rows.select("_row", "_a", "_b", "_n").join(
        per_doc.hint("merge"), (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")), "left")
    return out.select(
        *[F.col(f"_row.`{c}`") for c in kept], F.col("_n").alias("_n_words"),
        F.coalesce("_spans", F.array().cast("array<struct<start:long,end:long>>")).alias("_spans"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("_items"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           **options) -> DataFrame:
    """One row per document: words, words hit, items, and whether it is contaminated."""
    out = decontaminate(docs, items, id_col, text_col, keep=[id_col], **options)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        id_col, F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"))
