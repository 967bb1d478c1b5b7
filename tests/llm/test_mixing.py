import random
from collections import defaultdict

from data import edge_docs, empty
from tidemark.llm import mixing as M


def fill(sizes, weights):
    """Targets by sharing the excess again and again, as the rule is stated."""
    total, limit = sum(sizes), [3 * s for s in sizes]
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(limit[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > limit[i] + 1e-9}
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = limit[i]
        open_ -= over
    return target


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def corpus(counts, seed=1):
    rnd, rows = random.Random(seed), []
    for source, n in counts:
        rows += [(len(rows) + i, "w " * rnd.randint(0, 60), source) for i in range(n)]
    return rows


def test_targets_are_shared_by_weight_up_to_the_limit(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 16)
    for counts in ([("a", 300), ("b", 40), ("ä", 5), (None, 60)], [("z", 500), ("y", 3), ("x", 2)],
                   [("only", 30)], [(f"s{i:02}", 10 + i * i) for i in range(12)]):
        rows = corpus(counts)
        out = M.mix(docs(spark, rows)).collect()
        names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
        size = defaultdict(int)
        for _, t, s in rows:
            size[s] += len(t.split())
        want = fill([size[s] for s in names], [i % 3 + 1 for i in range(len(names))])
        taken, target = defaultdict(int), {}
        for r in out:
            assert r.repeats <= 3 and r.source_size == size[r.source]
            taken[r.source] += r.repeats * r.size
            target[r.source] = r.target
        for s, w in zip(names, want):
            assert abs(target[s] - w) < 1e-6 * max(1, w)
            assert abs(taken[s] - w) <= 130  # two of the longest documents
        assert 0 <= sum(size.values()) - sum(taken.values()) <= 60


def test_ranges_do_not_change_the_mix(spark, monkeypatch):
    df = docs(spark, corpus([("a", 200), ("b", 100), ("c", 20)]))
    runs = []
    for rows in (4096, 64, 7):
        monkeypatch.setattr(M, "RANGE", rows)
        runs.append(sorted((r.id, r.repeats) for r in M.mix(df).collect()))
    assert runs[0] == runs[1] == runs[2]


def test_the_mix_is_sorted_and_repeats(spark):
    df = docs(spark, corpus([("a", 200), ("b", 30), ("c", 10)]))
    chosen = {r.id: r.repeats for r in M.mix(df).collect()}
    rows = M.mixed(df).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, n in chosen.items() for _ in range(n))
    assert max(chosen.values()) == 3


def test_awkward_documents(spark):
    df = edge_docs(spark)
    out = M.mix(df).collect()
    assert len(out) == df.count()
    assert all(r.size == 0 for r in out if r.id in (2, 3, 4))
    mixed = M.mixed(df)
    assert mixed.columns == df.columns and mixed.count() > 0
    assert M.mix(empty(df)).count() == 0 and M.mixed(empty(df)).count() == 0
    silent = df.where("doc_id IN (2, 3, 4)")
    assert {(r.target, r.repeats * r.size) for r in M.mix(silent).collect()} == {(0.0, 0)}


def test_empty_texts_do_not_queue(spark, monkeypatch):
    """A source of empty texts alone is in no interval of the queue, and each of them is taken once."""
    monkeypatch.setattr(M, "RANGE", 64)
    rows = corpus([("a", 200), ("b", 50)]) + [(10_000 + i, None if i % 2 else " ", "empty") for i in range(500)]
    kept = []
    original = M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: kept.append((name, original(df, name))) or kept[-1][1])
    out = M.mix(docs(spark, rows)).collect()
    queue = dict(kept)["queue"]
    assert queue.where("source = 'empty' OR size = 0").count() == 0
    empties = [r for r in out if r.size == 0]
    assert len(empties) >= 500 and all(r.repeats == 1 for r in empties if r.source == "empty")
    places = sorted(r.finish for r in empties if r.source == "empty")
    assert 0 <= places[0] < places[-1] < 1 and len(set(places)) == 500
    assert M.mixed(docs(spark, rows)).where("source = 'empty'").count() == 500
    only = docs(spark, [(i, "", "e") for i in range(30)])
    assert M.mixed(only).count() == 30
