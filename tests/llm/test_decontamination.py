"""Decontamination against brute force; the query is held against SQL elsewhere."""

import hashlib
import random
import re

from data import edge_docs, empty, kept_columns
from pyspark.sql import functions as F

from tidemark.llm import decontamination as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window=10):
    parts = {}
    for own, text in items:
        w = words(text)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            parts.setdefault(tuple(w[s:s + size]), set()).add(own)
    sizes, out = {len(p) for p in parts}, []
    for own, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                of = parts.get(tuple(w[s:s + size]))
                if of:
                    hit.update(range(s, s + size))
                    found |= {str(x) for x in of if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((own, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def got(df):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"))


def test_random_texts_against_brute_force(spark):
    """Few words, so that windows meet everywhere, repeat within texts and tie; items of every length."""
    rnd = random.Random(13)

    def text(n, some):
        return " ".join(rnd.choice(some) for _ in range(n))

    few, many = ["a", "B", "é", "É"], [f"w{k}" for k in range(400)]
    items = [(k, text(rnd.randint(10, 30), many)) for k in range(20)] + [
        (k, text(rnd.randint(0, 25), few)) for k in range(18, 40)] + [
        (50 + n, text(n, many)) for n in range(1, 13)] + [(None, text(12, many)), (3, text(15, many)), (70, None)]
    docs = []
    for k in range(60):
        body = text(rnd.randint(0, 120), many if k % 2 else few)
        for _ in range(rnd.randint(0, 3)):
            own = words(rnd.choice(items)[1])
            at = rnd.randint(0, 3)
            body += ", " + " ".join(own[at:at + rnd.randint(8, 20)]).upper().replace("É", "É") + "! " + text(3, many)
        docs.append((k, body))
    docs += [(7, docs[7][1]), (None, docs[8][1]), (None, docs[8][1]), (99, None), (100, "")]
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert sum(r[5] for r in want) > 20 and not all(r[5] for r in want)
    assert got(D.report(d, i)) == want
    # beyond the bound of what is broadcast
    assert got(D.report(d, i, broadcast=0)) == want


def test_every_span_of_the_guaranteed_length_is_found(spark):
    """Ten words of an item anywhere, and nine nowhere."""
    item = [f"t{k}" for k in range(40)]
    docs = [(at, f"x y {' '.join(item[at:at + 10])} z") for at in range(31)] + [
        (100 + at, f"x y {' '.join(item[at:at + 9])} z") for at in range(32)]
    d, i = frames(spark, docs, [(1, " ".join(item))])
    out = D.decontaminate(d, i).collect()
    for r in out:
        spans = [(s.start, s.end) for s in r["_spans"]]
        assert spans == ([(2, 12)] if r.doc_id < 100 else []) and r["_items"] == (["1"] if r.doc_id < 100 else [])


def test_spans_merge_and_stay_apart(spark):
    item = " ".join(f"t{k}" for k in range(14))
    d, i = frames(spark, [(1, f"{item} gap {item} {item}")], [(5, item), (6, "gap")])
    row = D.decontaminate(d, i).first()
    assert [(s.start, s.end) for s in row["_spans"]] == [(0, 43)] and row["_items"] == ["5", "6"]
    row = D.decontaminate(d, i.where("item_id = 5")).first()
    assert [(s.start, s.end) for s in row["_spans"]] == [(0, 14), (15, 43)]


def test_awkward_documents(spark):
    extra = [(20, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "x", "x")]
    df = edge_docs(spark, extra)
    items = spark.createDataFrame([("i1", "alpha beta gamma delta epsilon zeta eta theta iota kappa", 1),
                                   ("i0", "six", 1), (None, "three four", 1)], "item_id string, text string, _row int")
    out = D.decontaminate(df, items)
    kept_columns(df, out, ("_n_words",))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(D.report(df, items)) == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert D.report(empty(df), items).count() == 0
    for none in (empty(items), items.select(F.lit("i").alias("item_id"), F.lit(" ,").alias("text"))):
        assert {r[2:4] + r[5:] for r in got(D.report(df, none))} == {(0, 0, False)}


def test_no_python_in_the_plan(spark, sf):
    from tidemark.llm.common import table
    df = D.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
