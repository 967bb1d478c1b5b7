"""Small inputs with every awkward case."""

CLASH = ["_tag", "_row", "_key", "_words", "id", "n", "s", "k", "repeats", "finish", "component",
         "_ids", "_toxic", "_lang", "_lines", "_n_words", "label_", "size"]


def edge_docs(spark, extra=()):
    """Null ids, texts, languages and sources, empty and very long texts, rows that repeat, and
    columns whose names the operators use themselves."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa\n" * 3000
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"),
            (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n \x0b", "de", None), (5, long, "de", None),
            (None, "one two three four five six", None, None), (7, "Ünï \u0130 \u212a 日本 😀 \x00 x\xa0y", "fr", "b"),
            (8, "x" * 5000, None, "c"), (9, "one  two three four\tfive six ", "en", "c"), *extra]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1]), *[f"own {c}" for c in CLASH]) for r in rows], schema)


def empty(df):
    return df.where("false")


def kept_columns(before, after, results=()):
    """All columns are there, and those that are no results have their values."""
    assert set(before.columns) <= set(after.columns)
    for c in set(CLASH) & set(before.columns) - set(results):
        assert {r[0] for r in after.select(f"`{c}`").distinct().collect()} <= {f"own {c}"}
