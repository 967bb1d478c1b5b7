import hashlib

from data import edge_docs, empty
from pyspark.sql import functions as F
from tidemark.llm import fingerprints as P


def words(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    x, y = words(a), words(b)
    return len(x & y) / len(x | y)


def texts(n):
    base = [f"word{i * i % 977}" for i in range(3000)]
    return [(i, " ".join(base[i * 13:i * 13 + 4 * i + 1] + ["x"] * (i % 3))) for i in range(n)]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.fingerprints(df).collect()}
    order = sorted(rows, reverse=True)
    off = []
    for k, (i, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and len(r.fingerprint) == len(r.edited_fingerprint) == 256
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - similarity(text, edited), r.near_next - similarity(text, after)]
    return off


def test_likeness_estimates_similarity(spark):
    off = check(spark, texts(120))
    assert max(map(abs, off)) < 0.25 and sum(map(abs, off)) / len(off) < 0.05
    assert abs(sum(off) / len(off)) < 0.02


def test_neighbours_across_ranges_and_gaps(spark):
    rows = [(i * i * 1000 - 7, t) for i, t in texts(50)]
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.id: (r.next_text, r.next_fp) for r in P.with_neighbour(df, "doc_id", "text", 1).collect()}
    for ranges in (2, 7, 200):
        got = {r.id: (r.next_text, r.next_fp) for r in P.with_neighbour(df, "doc_id", "text", ranges).collect()}
        assert got == whole
    one = P.fingerprints(df.limit(1)).first()
    assert one.near_next == 1.0


def test_places_among_cuts(spark):
    df = spark.range(-5, 60).toDF("k")
    for cuts in ([], [3], [3, 4], list(range(0, 50, 3)), [-2, 0, 1, 7, 30]):
        got = {r.k: r.p for r in df.select("k", P._place(F.col("k"), cuts).alias("p")).collect()}
        assert got == {k: sum(c < k for c in cuts) for k in range(-5, 60)}


def test_equal_texts_and_awkward_documents(spark):
    df = edge_docs(spark)
    out = P.fingerprints(df).collect()
    assert len(out) == df.count()
    assert len({r.fingerprint for r in out if r.doc_id == 1 or r.doc_id is None}) == 1
    assert len({r.fingerprint for r in out if r.doc_id in (2, 3, 4)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert P.fingerprints(empty(df)).count() == 0


def test_densified_bins_agree_as_often_as_sets(spark):
    """Two words of eight in common: few bins are filled at first."""
    df = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}", f"a{i} b{i} c{i} d{i} e{i} g{i}")
                                for i in range(300)], "i int, x string, y string")
    near = df.select(P.likeness(P.packed(F.col("x")), P.packed(F.col("y"))).alias("n"))
    assert abs(near.agg(F.avg("n")).first()[0] - 1 / 3) < 0.05
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
