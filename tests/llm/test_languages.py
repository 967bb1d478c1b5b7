import random
from collections import Counter

import numpy as np
from data import edge_docs, empty, kept_columns
from tidemark.llm import languages as L
from tidemark.llm.common import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    model = L.learn(docs.where("doc_id % 2 = 0"))
    out = L.predict(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(r._lang == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r._sure <= 1 for r in out)


def test_kernel_is_the_blended_spectrum(spark):
    texts = ["abc abd", "xyz", "ab", "zzz abc"]
    spectrum = L.Spectrum(texts)

    def grams(text):
        text = " " + text + " "
        return {text[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
    got = spectrum.presence(texts) @ spectrum.presence(texts).T
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = grams(a), grams(b)
            assert np.isclose(got[i, j], len(x & y) / np.sqrt(len(x) * len(y)))
    assert spectrum.presence(["", "ÖÖÖ"]).shape == (2, spectrum.size)


def test_awkward_documents(spark):
    df = edge_docs(spark)
    model = L.learn(df)
    out = L.predict(df, model)
    kept_columns(df, out, ["_lang"])
    got = {r.doc_id: (r._lang, r._sure) for r in out.collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0)
    assert {got[i][0] for i in (1, 5, 7, 8)} <= {"en", "de", "fr"}
    assert L.predict(empty(df), model).count() == 0
    assert L.learn(empty(df)) is None
    assert {r._lang for r in L.predict(df, None).collect()} == {"und"}


def test_one_language_only(spark):
    df = spark.createDataFrame([(i, f"text {i}", "xx") for i in range(5)], "doc_id long, text string, lang string")
    assert {r._lang for r in L.predict(df, L.learn(df)).collect()} == {"xx"}


def scripts(n, letters, rows, seed=7):
    """Made-up languages, each in a script of its own, as words of its letters."""
    rnd, out = random.Random(seed), []
    starts = [0x100, 0x400, 0x900, 0x1200, 0x1800, 0x3041, 0x4E00, 0x5800, 0x6200, 0xAC00]
    for k in range(n):
        some = [chr(starts[k] + i) for i in range(letters[k])]
        words = ["".join(rnd.choice(some) for _ in range(rnd.randint(2, 6))) for _ in range(400)]
        out += [(f"l{k}", " ".join(rnd.choice(words) for _ in range(30))) for _ in range(rows)]
    rnd.shuffle(out)
    return out


def test_ten_scripts_some_of_very_many_characters():
    rows = scripts(10, [30, 30, 60, 60, 90, 80, 1500, 1500, 1500, 200], 300)
    model = L.fit([t for _, t in rows[:2500]], [lang for lang, _ in rows[:2500]])
    assert not model.spectrum.place and model.spectrum.base > 3000
    got = L.predict_texts(model, [t for _, t in rows[2500:]])[0]
    right = Counter(lang for lang, found in zip([lang for lang, _ in rows[2500:]], got, strict=True) if lang == found)
    every = Counter(lang for lang, _ in rows[2500:])
    assert all(right[lang] == n for lang, n in every.items())


def test_table_and_list_give_the_same(monkeypatch):
    texts = ["abc abd é", "xyz", "ab ñ", "zzz abc 日本"]
    table = L.Spectrum(texts)
    monkeypatch.setattr(L, "TABLE", 0)
    listed = L.Spectrum(texts)
    assert table.place and not listed.place
    probe = [*texts, "", "абв", "abc 日 xyz " * 50]
    assert np.array_equal(table.presence(probe), listed.presence(probe))


def test_a_column_of_very_many_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES", 3)
    monkeypatch.setattr(L, "SAMPLE", 50)
    rows = [(i, "abc " * 40, "en") for i in range(9)] + [(50 + i, "xyz " * 40, "fr") for i in range(9)] + [
        (100 + i, f"q{i} " * 40, f"junk {i:03}") for i in range(200)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", "junk 000"]
    assert L.predict_texts(model, ["abc " * 30, "xyz xyz"])[0] == ["en", "fr"]
