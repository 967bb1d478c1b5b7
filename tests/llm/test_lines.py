import hashlib
from collections import defaultdict

from data import CLASH, edge_docs, empty, kept_columns
from pyspark.sql import functions as F
from tidemark.llm import lines as L


def brute(texts, min_docs, min_chars=1, ids=None):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    docs = defaultdict(set)
    for i, ls in enumerate(split):
        for x in ls:
            docs[key(x)].add(i if ids is None or ids[i] is None else f"id {ids[i]}")
    gone = {k for k, d in docs.items() if len(d) >= min_docs and len(k) >= min_chars}
    return [(len(ls), sum(key(x) in gone for x in ls), "\n".join(x for x in ls if key(x) not in gone))
            for ls in split]


def test_equals_brute_force(spark):
    texts = [None, "", "\n\n"] + [f"Shared Line\n own {i}\n\tSHARED line \n\nÉcole\n{'écOLE' if i % 2 else 'ÉCOLE'}"
                                  f"\nİx\n{i % 3}" for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs, chars in ((10, 1), (4, 1), (4, 2), (2, 0)):
        out = L.drop_shared_lines(df, min_docs=docs, min_chars=chars).orderBy("doc_id").collect()
        assert [(r._lines, r._dropped, r.text) for r in out] == brute(texts, docs, chars)


def test_awkward_documents(spark):
    df = edge_docs(spark)
    out = L.drop_shared_lines(df, min_docs=2)
    assert out.count() == df.count()
    kept_columns(df, out, ["_lines"])
    want = brute([r.text for r in df.collect()], 2, ids=[r.doc_id for r in df.collect()])
    got = sorted((r._lines, r._dropped, r.text) for r in out.collect())
    assert got == sorted(want)
    assert L.drop_shared_lines(empty(df)).count() == 0


def test_a_line_counts_once_for_each_document(spark):
    df = spark.createDataFrame([(i, "a\n" * 20) for i in range(9)] + [(99, "b")], "doc_id long, text string")
    assert L.drop_shared_lines(df).agg(F.sum("_dropped")).first()[0] == 0
    more = df.union(spark.createDataFrame([(100, "A ")], df.schema))
    assert {r.text for r in L.drop_shared_lines(more).where("doc_id < 99").collect()} == {""}
    assert hashlib.sha256(b"").hexdigest() and CLASH


def test_rows_that_repeat_an_id_are_one_document(spark):
    """Against the SQL of the query, and brute force with rows without an id."""
    import duckdb
    from tidemark.llm.queries import ORACLES
    rows = [(7, "common\nown")] * 12 + [(i, "often\nrare") for i in range(20, 31)] + [(20, "often\nrare")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = L.drop_shared_lines(df).collect()
    assert sorted((r._lines, r._dropped, r.text) for r in out) == sorted(
        brute([t for _, t in rows], 10, ids=[i for i, _ in rows]))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[2] for r in con.execute(ORACLES["op2_line_dedup"]).fetchall()}
    dropped = {i: sum(r._dropped for r in out if r.doc_id == i) for i in want}
    assert dropped == want and want[7] == 0 and want[21] == 2
    none = spark.createDataFrame([(None, "x\ny")] * 10 + [(1, "x")] * 3, "doc_id long, text string")
    assert {r._dropped for r in L.drop_shared_lines(none).where("doc_id IS NULL").collect()} == {2}
