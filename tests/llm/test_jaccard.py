import random
from collections import Counter, defaultdict

import pytest
from data import edge_docs, empty
from tidemark.llm import jaccard as J


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, words, percent):
    sets = [(i, shingles(t, words)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and None not in (i, j) and 100 * both >= percent * (len(x) + len(y) - both):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def run(spark, rows, words, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return Counter((r.doc_id, r.n_shingles, r.component_id)
                   for r in J.near_sets(df, words=words, percent=percent).collect())


def corpus(seed, groups, copies, length, edits):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(length)]
        if g % 2:
            base[5:5] = passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randint(0, edits)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append(" ".join(text[:rnd.randint(len(text) - 3, len(text))]))
    rnd.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words,percent,few", [(3, 90, 32), (5, 80, 32), (3, 90, 3), (1, 60, 5)])
def test_equals_brute_force(spark, monkeypatch, words, percent, few):
    monkeypatch.setattr(J, "FEW", few)  # so that blocks are used too
    monkeypatch.setattr(J, "BLOCK", 16)
    rows = corpus(words, 12, 9, 70, 6) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(9, 8, 5, 7, 1))]
    want = brute(rows, words, percent)
    assert len({c for _, _, c in want}) < len(rows)
    assert run(spark, rows, words, percent) == want


def test_awkward_documents(spark):
    df = edge_docs(spark)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.near_sets(df).collect())
    want = brute([(r.doc_id, r.text) for r in df.collect()], 3, 90)
    assert got == want
    assert J.near_sets(empty(df)).count() == 0


def test_a_group_of_copies_is_one(spark):
    """Copies, and near copies that link only through others."""
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(words)) for i in range(40)]
    rows += [(100 + i, " ".join(words[i:] + [f"n{j}" for j in range(i)])) for i in range(12)]
    want = brute(rows, 3, 90)
    assert run(spark, rows, 3, 90) == want
    assert len({c for _, _, c in want}) == 1


def test_shingle_sets_follow_the_words(spark):
    assert len(J.shingle_set("A b\x0bC", 3)) == 1 and len(J.shingle_set("a b", 3)) == 1
    assert (J.shingle_set("A B c d", 3) == J.shingle_set("a\tb  C\nD", 3)).all()
    assert len(J.shingle_set("É b c", 3)) == 1 and (J.shingle_set("É", 3) != J.shingle_set("é", 3)).all()
    assert len(J.shingle_set(" ", 3)) == len(J.shingle_set(None, 3)) == 0
    seen = defaultdict(set)
    for i in range(2000):
        seen[int(J.shingle_set(f"a b c{i}", 3)[0])].add(i)
    assert len(seen) == 2000


def chance(texts, shared, others):
    """Long texts of words of their own, that meet at some of ``shared`` common shingles each."""
    rnd = random.Random(8)
    common = [f"a{i} b{i} c{i}" for i in range(shared)]
    rows = []
    for i in range(texts):
        met = rnd.sample(common, others)
        rows.append(" ".join(f"{m} " + " ".join(f"o{i}x{j}x{k}" for k in range(2)) for j, m in enumerate(met)))
    return rows


def kept_tables(monkeypatch):
    """What a run stores: name -> DataFrames."""
    kept, original = defaultdict(list), J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: kept[name].append(original(df, name)) or kept[name][-1])
    return kept


def test_chance_meetings_send_no_text_to_all_others(spark, monkeypatch):
    """Texts that common shingles chain into one large part are counted, not compared each with each."""
    monkeypatch.setattr(J, "FEW", 3)
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "FREQUENT", 1)  # nearly none known as common, as in a large corpus
    texts = chance(120, 25, 16)
    texts += [t + " more" for t in texts[:5]]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute(rows, 3, 90)
    kept = kept_tables(monkeypatch)
    assert run(spark, rows, 3, 90) == want
    assert len({c for _, _, c in want}) == 120
    assert sum(x.where("k > 3").count() for x in kept["open"]) > 0
    assert sum(x.count() for x in kept["blocks"]) == 0


def test_dense_and_sparse_parts_together(spark, monkeypatch):
    """Near misses that share most of what they have stay in blocks beside parts that are counted."""
    monkeypatch.setattr(J, "FEW", 3)
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "FREQUENT", 1)
    texts = chance(100, 25, 16)
    base = [f"t{i}" for i in range(90)]
    for i in range(40):  # a tenth and more of them differ, each in words of its own
        text = list(base)
        for j in range(2 + i % 3):
            text[(7 * i + 29 * j) % 90] = f"z{i}x{j}"
        texts.append(" ".join(text))
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    want = brute(rows, 3, 90)
    kept = kept_tables(monkeypatch)
    assert run(spark, rows, 3, 90) == want
    many = kept["open"][0].where("k > 3").select("s").distinct().count()
    assert 0 < kept["dense"][0].count() < many
    assert 0 < sum(x.count() for x in kept["blocks"]) <= 40
