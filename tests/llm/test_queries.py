"""The registered queries, against SQL where it can express them; components; the pipeline."""

import random
import time

import compare
import corpus_pipeline
import pytest
from data import edge_docs, empty

import __spark_entry__ as contract
from tidemark.llm import bpe, jaccard, lines, mixing, toxicity
from tidemark.llm.common import components, stored, table
from tidemark.llm.queries import ORACLES, QUERIES


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare.difference(compare.connect(sf), ORACLES[name], QUERIES[name](spark, sf)) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_spelling_variants"}))
def test_query_returns_every_document(spark, sf, name):
    df = QUERIES[name](spark, sf)
    ids = sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in table(spark, sf, "documents").select("doc_id").collect())


def test_components_of_random_graphs(spark):
    rnd = random.Random(4)
    for n, m in ((1, 0), (30, 15), (60, 80), (200, 150)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n // 3)]
        parent = list(range(n + 1))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for u, v in edges:
            u, v = find(u), find(v)
            parent[max(u, v)] = min(u, v)
        df = spark.createDataFrame(edges, "u long, v long")
        got = {r.node: r.component for r in components(df).collect()}
        assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
        assert len(got) == components(df).count()


def shuffle_files(spark):
    """Names of the shuffle files on this machine."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """They go when it is written, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(name), shuffle_files(spark)
    rows = spark.range(10_000).selectExpr("id % 1000 AS a", "id AS b")
    out = stored(rows.join(rows.groupBy("a").count().hint("merge"), "a"), "joined")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(name) == setting
    assert out.count() == 10_000


def test_stages_are_their_operators(spark, sf):
    """Each stage's result from its operator's own, which other tests hold against brute force."""
    docs = table(spark, sf, "documents")
    model = toxicity.learn(docs.where(toxicity_rule()), table(spark, sf, "labels"))
    want = [docs.columns]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), "stage")
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            kept = toxicity.score(docs, model).where("_toxic < 0.5")
            assert ids == sorted(r.doc_id for r in kept.collect()) and 0 < len(ids) < docs.count()
        elif name == "line dedup":
            texts = {r.doc_id: r.text for r in lines.drop_shared_lines(docs).collect()}
            assert {r.doc_id: r.text for r in out.collect()} == texts
        elif name == "n-gram Jaccard join":
            groups = {r.component_id for r in jaccard.near_sets(docs, words=5, percent=80).collect()}
            assert ids == sorted(groups)
        elif name == "source mixing":
            taken = {r.id: r.repeats for r in mixing.mix(docs).collect()}
            assert ids == sorted(i for i, n in taken.items() for _ in range(n))
        else:
            assert out.columns == bpe.digests(docs).columns and len(ids) == docs.count()
            continue
        assert out.columns == want[0]
        docs = out


def toxicity_rule():
    from tidemark.llm.common import crc_mod
    return crc_mod("doc_id", 5) != 0


def test_stages_take_awkward_documents(spark, sf):
    for df in (edge_docs(spark), empty(edge_docs(spark))):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, df, sf), "stage")
            if name != "byte-level BPE":
                assert out.columns == df.columns, name
            assert (out.count() == 0) == (df.count() == 0), name


def test_one_row_of_each_group_of_copies_stays(spark, sf):
    """Repeated ids, rows without an id, and texts without words, which are no copies of each other."""
    near = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (None, "a b c d e f", "x"),
            (3, "A b c d e f", "y"), (9, near, "x"), (8, near + " more", "x"), (None, near, "z"),
            (5, None, "x"), (6, None, "x"), (6, None, "x"), (7, "", "x"), (None, "only here and nowhere else", "x"),
            (2, "some other text of its own", "x"), (2, "quite another text with this id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own string")
    out = corpus_pipeline.drop_near_copies(spark, df, sf)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(1, "a b c d e f", "x"), (8, near + " more", "x"), (5, None, "x"), (6, None, "x"), (7, "", "x"),
            (None, "only here and nowhere else", "x"), (2, "some other text of its own", "x"),
            (2, "quite another text with this id", "x")]
    assert got == sorted(want, key=str)
