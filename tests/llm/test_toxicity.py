import random

import numpy as np
import pytest
from data import edge_docs, empty, kept_columns
from pyspark.sql import functions as F
from tidemark.llm import toxicity as T


def corpus(n, seed):
    rnd = random.Random(seed)
    syllables = ["an", "the", "tion", "er", "in", "st", "ou", "re", "le", "nd"]
    rude = ["grotbag", "snivelwit", "muckhead", "bilgebrain"]
    rows = []
    for i in range(n):
        toxic = int(rnd.random() < 0.25)
        words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(rnd.randint(40, 300))]
        if toxic:
            for at in range(3, len(words), 12):
                words[at] = rnd.choice(rude)
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(700, 5)


def test_held_out_texts_are_told_apart(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.learn(df.where("doc_id < 500").drop("toxic"), df.select("doc_id", "toxic"))
    out = T.score(df.where("doc_id >= 500"), model).collect()
    assert all(0 <= r._toxic <= 1 for r in out)
    right = sum((r._toxic >= 0.5) == bool(r.toxic) for r in out)
    assert right >= 0.95 * len(out)
    assert [r._toxic for r in T.score(df.where("doc_id >= 500"), T.learn(
        df.where("doc_id < 500").drop("toxic"), df.select("doc_id", "toxic"))).collect()] == [
        r._toxic for r in out]


def test_awkward_documents(spark, rows):
    df = edge_docs(spark)
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.learn(labelled, labelled)
    out = T.score(df, model)
    kept_columns(df, out, ["_toxic"])
    got = out.collect()
    assert len(got) == df.count() and all(0 <= r._toxic <= 1 for r in got)
    assert len({r._toxic for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert T.score(empty(df), model).count() == 0


def test_nothing_to_learn_from(spark, rows):
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for labels in (labelled.where("false"), labelled.where("toxic = 1"), labelled.selectExpr(
            "doc_id", "CAST(NULL AS INT) toxic")):
        model = T.learn(labelled, labels)
        assert model is None
    assert {r._toxic for r in T.score(edge_docs(spark), None).collect()} == {0.0}


def test_few_labels_suffice_for_some_model(spark, rows):
    labelled = spark.createDataFrame(rows[:12], "doc_id long, text string, toxic int")
    model = T.learn(labelled, labelled)
    assert model is None or len(T.score_texts(model, ["", None, "the an"])) == 3


def test_windows_cover_the_whole_text():
    words = T.words_of("A b  c\nD " * 10)
    assert b"".join(T.windows(words, 7)).split() == [b"a", b"b", b"c", b"d"] * 10
    assert T.windows([], 7) == [b"  "]


def test_the_share_of_toxic_rows_is_that_of_all_labelled_rows(spark):
    """Labels that say nothing about the texts: scores are near the share, whatever the caps take."""
    rnd = random.Random(8)
    rows = [(i, text, int(rnd.random() < 0.1)) for i, text, toxic in corpus(2400, 8) if not toxic]
    share = sum(y for _, _, y in rows) / len(rows)
    nulls = [(5000 + i, None, 1) for i in range(500)]  # teach nothing, the share neither
    labelled = spark.createDataFrame(rows + nulls, "doc_id long, text string, toxic int")
    for caps in ((120, 120), (150, 60), (60, 600)):
        model = T.learn(labelled, labelled, per_class=caps)
        scores = T.score_texts(model, [t for _, t, _ in rows[:400]])
        assert abs(np.median(scores) - share) < 0.06, caps


def test_odds_follow_the_rows_that_texts_were_chosen_from(rows):
    sides = [[t for _, t, y in rows if y == kind][:90] for kind in (1, 0)]
    even, rare = T.fit(*sides, (90, 90)), T.fit(*sides, (90, 810))
    assert np.isclose(even.weights[0] - rare.weights[0], np.log(9))
    assert (even.weights[1:] == rare.weights[1:]).all()


def test_the_sample_is_taken_without_ranking_a_whole_class(spark, rows, monkeypatch):
    plans, texts = [], []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: (plans.append(
        df._jdf.queryExecution().executedPlan().toString()), collect(df))[1])
    monkeypatch.setattr(T, "fit", lambda *sides: texts.append(sides))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    T.learn(df, df, per_class=(20, 50))
    assert not any("Window" in p for p in plans) and "TakeOrderedAndProject" in plans[-1]
    by_hash = [r.text for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator() if r.toxic == 0]
    assert texts[0][1] == by_hash[:50] and len(texts[0][0]) == 20
    assert texts[0][2] == (sum(y for *_, y in rows), sum(1 - y for *_, y in rows))
