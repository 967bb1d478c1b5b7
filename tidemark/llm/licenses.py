"""License scan by ordered signature rules, in DataFrame expressions alone.

A text becomes its words, lower-case and joined by single blanks. Only texts with one of a few
dozen words that every rule needs are looked at further; of the hundreds of rules, those apply whose
keyword occurs. Every place of a rule's pattern is a detection, an interval of words. A detection
that lies inside another of the same or a higher priority is suppressed, the earlier in the order
(start, longer, higher priority, earlier rule) being the one that stays; the base phrases are always
kept. Everything happens within the row: no shuffle, and a source full of licenses is spread as its
rows are.

Defined results: a null or empty text has no words, no detections and score 0. Rows that repeat
give equal rows. Ties between detections go by the order above. Very long texts are scanned whole, within
their row. Other columns stay, but for those named like the results. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER
from tidemark.llm.fingerprints import let
from tidemark.llm.license_rules import IDENTIFIER, NAME, NOTICE, PHRASE, TEXT, all_rules

#: Beginnings of words of which every detection holds one.
GATE = ("0bsd", "advertising materials", "afl 3", "agpl", "all rights reserved", "apache", "copyright and",
        "artistic [12]", "attribution ", "beer in return", "blueoak", "boost org", "bsd ",
        "bsl 1 0", "busl 1", "cc by ", "cc0", "cddl", "cecill", "clause bsd", "confidential and",
        "copyright notice", "cpl v? ?1", "creative commons", "creativecommons", "curl se",
        "disclaimed", "disclaimer", "do what the", "eclipse ", "edl v? ?1", "elastic 2",
        "endorse or", "epl ?v? ?[12]", "eupl", "for good not evil", "gfdl", "gnu ", "gpl",
        "json org", "latex project", "lgpl", "libpng 2", "licen", "lppl", "misrepresented", "mit 0",
        "mit no attribution", "mozilla org", "mpl ?v? ?[12]", "ms [pr]l", "mulanpsl", "naist 2003",
        "odbl", "odc by", "ofl 1 1", "opendatacommons", "openssl", "osl 3", "pddl", "perl itself",
        "perlfoundation", "permission ", "php net", "postgresql", "proprietary and", "psf 2",
        "public domain", "qpl 1", "redistribut", "ruby lang", "scripts sil", "sspl",
        "strictly prohibited", "unicode dfs", "unicode org", "unlicense", "upl 1", "w3 org",
        "wtfpl", "zpl 2", "warranty", "warranties", "you just do")
GATE_PATTERN = " (?:" + "|".join(GATE) + ")"

#: How sure a detection of a priority makes.
SURE = {PHRASE: 0.5, NAME: 0.6, IDENTIFIER: 0.8, NOTICE: 0.9, TEXT: 1.0}

_MARK = "\x01"
#: Other letters whose lower case holds an ASCII letter.
_TO_ASCII = "[\u0130\u212a]"


def normal_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z, each after one blank,
    and a blank at the end; letters beyond ASCII may be lowered as well."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(_TO_ASCII), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    body = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(body == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_array() -> Column:
    return F.array(*[F.struct(
        F.lit(i).alias("nth"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
        F.lit(" " + r.keyword).alias("keyword"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"))
        for i, r in enumerate(all_rules())])


def _places(text: Column, rule: Column) -> Column:
    """One rule's detections, in the form in which they sort."""
    marked = F.split(F.regexp_replace(text, rule["pattern"], F.lit(_MARK + "$0")), " ", -1)
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(_MARK)), i - 1)),
                      lambda i: i.isNotNull())
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    return F.zip_with(starts, found, lambda at, what: F.struct(
        at.alias("start"), (-(at + _blanks(what) + 1)).alias("neg_end"),
        (-rule["priority"]).alias("neg_priority"), rule["nth"].alias("nth"), rule["label"].alias("label")))


def _kept(found: Column) -> Column:
    """Without those inside an earlier one of at least their priority."""
    inside = lambda a, b: (b["neg_end"] <= a["neg_end"]) & (b["neg_priority"] <= a["neg_priority"])
    return F.filter(found, lambda a, i: (a["neg_priority"] == -PHRASE) | ~F.exists(
        F.slice(found, 1, i), lambda b: inside(a, b)))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_words``, ``_detections`` (start, end, priority, label, in order of start)
    and ``_base`` (the starts of the base phrases)."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), normal_words(F.col(text_col)).alias("_words"))
    rows = rows.withColumn("_gated", F.col("_words").rlike(GATE_PATTERN))
    none = F.array().cast("array<struct<start:int,neg_end:int,neg_priority:int,nth:int,label:string>>")
    found = F.when(F.col("_gated"), F.sort_array(F.flatten(F.transform(
        F.filter(_rule_array(), lambda r: F.contains(F.col("_words"), r["keyword"])
                 & F.rlike(F.col("_words"), r["pattern"])),
        lambda r: _places(F.col("_words"), r))))).otherwise(none)
    rows = rows.withColumn("_found", found)
    rows = rows.withColumn("_detections", let(F.col("_found"), lambda f: F.transform(
        _kept(f), lambda d: F.struct(
            d["start"].alias("start"), (-d["neg_end"]).alias("end"),
            (-d["neg_priority"]).alias("priority"), d["label"].alias("label")))))
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("_n_words", "_detections", "_base")]
    return rows.select(*kept, (_blanks(F.col("_words")) - 1).cast("long").alias("_n_words"), "_detections",
                       F.transform(F.filter("_detections", lambda d: d["priority"] == PHRASE),
                                   lambda d: d["start"]).alias("_base"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base phrases, first and last of them, labels and score."""
    out = scan(docs.select(id_col, text_col), text_col)
    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(which, lambda d: d["label"]))), ",")
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])
    return out.select(
        id_col, F.col("_n_words").alias("n_words"), F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"),
        F.array_max("_base").cast("long").alias("last_word"),
        labels(F.filter("_detections", lambda d: d["priority"] == PHRASE)).alias("base_labels"),
        labels(F.col("_detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_detections", lambda d: sure[d["priority"]])),
                   F.lit(0.0)).alias("score"))
