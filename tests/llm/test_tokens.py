import zlib

import numpy as np
import pytest
from data import edge_docs, empty
from tidemark.llm import tokens as T
from tidemark.session import scratch
from tokenizers import Tokenizer

ODD = ["", "a", " a", "a ", "  a  b", "a\n\n b\t\tc  \n", "x\xa0\n\ny", "'s don't  I'll 12 345 !!\n!!", "ab\x1c\x1dcd",
       "é" * 50, "a \n b", "\na", "a\n", "<|endoftext|> x", "日本 \n語", "word, word. word's \"word\" wor-d w2 x!! y", "a" * 3000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(T.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_are_the_librarys(library):
    own = T.encoder(T.VOCABULARY)
    for text in ODD:
        assert np.frombuffer(own.encode_all([text])[0], own.kind).tolist() == library(text), text


@pytest.mark.parametrize("first", [300, 50257, 70000])
def test_blocks_read_back_from_any_place(first):
    rng = np.random.default_rng(first)
    for n in (0, 1, 2, 3, 50, 5000, 60000):
        ids = np.minimum(rng.zipf(1.4, n), 200).astype(np.uint32)
        for rounds in (0, 1, 6):
            payload = T.compress(ids, first, rounds)
            block = T.Block(payload)
            assert (block.read(0, n) == ids).all()
            for _ in range(10):
                a, b = sorted(rng.integers(0, n + 1, 2).tolist())
                assert (block.read(a, b) == ids[a:b]).all()
    assert len(T.compress(np.tile(ids[:50], 500).astype(np.uint32), first)) < 50000


def test_runs_of_one_id():
    for n in (2, 3, 31, 32, 1000):
        ids = np.full(n, 7, np.uint32)
        assert (T.Block(T.compress(ids, 10, 8)).read(0, n) == ids).all()
    with pytest.raises(ValueError, match="not a block"):
        T.Block(b"????" + bytes(16))


def test_files_hold_every_document_in_order(spark, library, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 200)
    df = edge_docs(spark, [(100 + i, f"text {i} " * (i % 7), "en", "a") for i in range(60)])
    path = scratch(spark, "tokens")
    T.write_tokens(df, path, shards=3)
    got = T.read_tokens(spark, path).join(T.starts(spark, path), ["shard", "block"]).collect()
    got.sort(key=lambda r: r.start + r.offset)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start + r.offset == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = sorted((r.doc_id or -1, zlib.crc32(np.array(library(r.text or "") + [0], "<u4").tobytes()))
                  for r in df.collect())
    assert sorted((r.doc_id or -1, zlib.crc32(r.ids)) for r in got) == want
    nothing = scratch(spark, "tokens")
    T.write_tokens(empty(df), nothing, shards=2)
    assert T.read_tokens(spark, nothing).count() == 0 and T.starts(spark, nothing).count() == 0


def remaining(payload):
    """How often the most frequent pair occurs in the sequence of a block."""
    s = T.Block(payload).sequence
    return int(np.unique((s[:-1] << 32) + s[1:], return_counts=True)[1].max(initial=0))


def test_rounds_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    for ids in (np.minimum(rng.zipf(1.3, 100_000), 30_000), rng.integers(0, 40, 30_000), np.full(100_000, 7),
                np.tile(rng.integers(0, 50_000, 400), 3000)):
        payload = T.compress(ids.astype(np.uint32), 50257)
        assert remaining(payload) < T.OFTEN
        assert (T.Block(payload).read(0, len(ids)) == ids).all()
    # equal documents again and again leave little more than their rules
    assert len(T.Block(payload).sequence) < 50 and len(payload) < 8000


def test_pairs_that_share_a_slot_are_all_counted():
    rng = np.random.default_rng(4)
    for kind in (np.uint32, np.uint64):
        pair = rng.permutation(np.repeat(rng.integers(0, 1 << 32, 60_000), rng.integers(1, 40, 60_000))).astype(kind)
        chosen, rank = T._frequent(pair)
        values, counts = np.unique(pair, return_counts=True)
        assert set(chosen.tolist()) == set(values[counts >= T.OFTEN].tolist())
        assert (np.bincount(rank, minlength=len(chosen) + 1)[:-1] == np.sort(counts[counts >= T.OFTEN])[::-1]).all()
        assert (chosen[rank[rank < len(chosen)]] == pair[rank < len(chosen)]).all()


def test_rules_beyond_two_bytes():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 50_000, (20_000, 2))
    ids = words[rng.permutation(np.repeat(np.arange(20_000), 20))].ravel().astype(np.uint32)
    payload = T.compress(ids, 50257)
    block = T.Block(payload)
    assert len(block.table) > (1 << 16) - 50257 and remaining(payload) < T.OFTEN
    assert (block.read(0, len(ids)) == ids).all() and (block.read(777, 3333) == ids[777:3333]).all()


def test_added_tokens_are_found_in_texts(spark):
    default = Tokenizer.from_file(T.VOCABULARY)
    own = T.encoder(T.VOCABULARY)
    texts = [*ODD, "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> \n<|endoftext|><|endoftext|>x", "<|endoftext|", "é<|endoftext|>日本"]
    want = [default.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[ODD.index("<|endoftext|> x")]
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode_added(texts)] == want
    path = scratch(spark, "tokens")
    T.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, shards=2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in T.read_tokens(spark, path).collect()}
    assert got == {i: [*ids, 0] for i, ids in enumerate(want)}
