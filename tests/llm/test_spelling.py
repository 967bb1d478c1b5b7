"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from data import edge_docs, empty

from tidemark.llm import spelling
from tidemark.llm.common import table


def brute_counts(rows, min_chars=5, min_count=3, slip=97):
    total = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if own is None else own}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_chars and n >= min_count}


def is_near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1:] == u for k in range(len(v)))


def near_of(words):
    return {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and is_near(w, v)] for w in words}


def brute(words, times=2):
    near = near_of(words)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def got(df):
    rows = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    words = brute_counts([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.word, r.n) for r in spelling.word_counts(docs).collect()} == set(words.items())
    assert got(spelling.variants(docs)) == brute(words)


def test_dense_words_and_blocks(spark):
    """Few letters, so that most words have near ones, some by an inserted repeat of a letter, in one
    group and in groups that are cut into blocks."""
    rnd = random.Random(11)
    words = {"".join(rnd.choice("aabé") for _ in range(rnd.randint(5, 8))): rnd.randint(3, 60)
             for _ in range(700)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {(w, len(vs), min(vs, key=lambda v: (-words[v], v))) for w, vs in near_of(words).items() if vs}
    for block, rows in ((8192, 40_000), (16, 300)):
        found = {(r.word, r.n_near, r.best) for r in spelling.near_words(df, block=block, rows=rows).collect()}
        assert found == want


def test_chain_of_forms_and_ties(spark):
    text = " ".join(["color"] * 3 + ["colour"] * 6 + ["colours"] * 12 + ["abcdx"] * 3 + ["abcdy"] * 6 + ["abcdz"] * 6
                    + ["alone"] * 4)
    found = {r.word: (r.n_near, r.form, r.root)
             for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                                        slip=None).collect()}
    assert found["color"] == (1, "colour", "colours") and found["colour"] == (2, "colours", "colours")
    assert found["abcdx"] == (2, "abcdy", "abcdy") and found["abcdy"][1] is None
    assert found["alone"] == (0, None, "alone")


def test_awkward_documents(spark):
    extra = [(None, "z" * 3000 + " " + ("z" * 2999 + "y ") * 3 + "Straße STRASSE straßen Straßen strassen 日本strasse", "x", "x")]
    df = edge_docs(spark, [*extra, *extra, *extra])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    words = brute_counts(rows)
    assert got(spelling.variants(df)) == brute(words) and any(len(w) > 2900 for w in words)
    assert spelling.variants(empty(df)).count() == 0


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = "Alpha beta, GAMMAÉ delta" * 50
    whole = [w for block in spelling.runs(text) for w in block]
    monkeypatch.setattr(spelling, "_CHUNK", 7)
    blocks = list(spelling.runs(text))
    assert len(blocks) > 100 and [w for block in blocks for w in block] == whole
