import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from data import edge_docs, empty, kept_columns
from tidemark.llm import bpe as B
from tidemark.llm import pretokens
from test_tokens import ODD


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    own = B.loaded(public_tokenizers.path(request.param))
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks,
                                  special_tokens={})


def test_ids_are_exact(both):
    own, library = both
    rnd = random.Random(3)
    bits = ["a", "the", "er", " ", "\n", "é", "1", "'s", "!", "\xa0", "tion", "  ", "日", "\t", "zq", "Q", ",", "—"]
    texts = ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    texts += ["ab" * 2000, "thethethe" * 300, "".join(chr(rnd.randint(33, 1000)) for _ in range(3000))]
    for text in texts:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), text[:80]
        assert own.decode(packed).decode() == text


def test_a_small_vocabulary_where_the_longest_match_is_wrong():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258, b"cd": 259, b"bcd": 260}
    own = B.BytePairs(ranks)
    for text in ("abc", "abcd", "bcd", "abcdabc", "cdabbc", "dcba", "bcdcd"):
        out = [bytes([c]) for c in text.encode()]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(out, out[1:])) if a + b in ranks),
                       default=None)
            if best is None:
                break
            out[best[1]:best[1] + 2] = [out[best[1]] + out[best[1] + 1]]
        # a whole piece that is a token is that token, as the library has it
        want = [ranks[text.encode()]] if text.encode() in ranks else [ranks[t] for t in out]
        assert own.piece(text.encode()) == want, text


def test_awkward_documents(spark):
    df = edge_docs(spark)
    out = B.decode_ids(B.encode_texts(df))
    kept_columns(df, out, ["_ids"])
    rows = out.collect()
    assert len(rows) == df.count()
    assert all(bytes(r._bytes).decode() == (r.text or "") for r in rows)
    report = B.digests(df).where("doc_id = 2").first()
    assert report.n_tokens == 0 and report.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert B.digests(empty(df)).count() == 0


def test_agreement_of_neighbours_is_what_the_merges_make():
    encoder, rnd = B.loaded(B.RANKS), random.Random(10)
    tokens = [*encoder.split, *(r for t, r in encoder.ranks.items() if len(t) == 1)]
    seen = Counter()
    for _ in range(4000):
        a, b = rnd.choice(tokens[:300] + tokens), rnd.choice(tokens[:300])
        left, right = encoder.bytes_of[a], encoder.bytes_of[b]
        want = encoder._merged(left + right) == [left, right]
        assert encoder._apart(a, b) == want
        seen[want] += 1
    assert min(seen.values()) > 20


@pytest.mark.parametrize("unit", ["a", "ab3é", "日本"])
def test_a_long_unbroken_piece_takes_time_in_proportion(unit):
    encoder = B.loaded(B.RANKS)

    def seconds(size):
        data = (unit * size).encode()[:size]
        times = []
        for _ in range(3):
            start = time.process_time()
            ids = encoder.piece(data)
            times.append(time.process_time() - start)
            assert b"".join(encoder.bytes_of[i] for i in ids) == data
        return min(times)
    assert seconds(1_000_000) < 2.8 * seconds(500_000) + 0.05


def test_what_is_remembered_is_bounded_in_bytes():
    made = []

    def make(part):
        made.append(part)
        return part.encode()
    memo = pretokens.Memo(make, 40_000)
    for turn in range(2):
        for k in range(1000):
            assert memo[f"part {k}"] == f"part {k}".encode()
    held = sum(memo.EACH + len(k) + len(v) for d in (memo, memo.young) for k, v in d.items())
    assert held <= 40_000 and memo["part 0"] == b"part 0" and len(made) < 2000
    assert memo["x" * 10_000] == b"x" * 10_000 and "x" * 10_000 not in memo.young
    memo.clear()
    assert not memo and not memo.young and memo["part 0"] == b"part 0"


def test_texts_in_batches_are_encoded_as_one_by_one(both):
    own, library = both
    rnd = random.Random(12)
    texts = [*ODD, *(" ".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 6))) for _ in range(200)), "", "a"]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
    assert got == [library.encode_ordinary(t) for t in texts] and own.encode_all([]) == []


def test_slices_by_size():
    import pyarrow as pa
    from tidemark.llm.common import by_size
    texts = ["x" * n for n in (0, 3, 50, 1, 1, 1, 200, 0)] + [None, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["i", "t"])
    parts = [p.column(1).to_pylist() for p in by_size(batch, 1, rows=4, size=55)]
    assert sum(parts, []) == texts and [len(p) for p in parts] == [4, 2, 1, 3]
    assert list(by_size(batch.slice(0, 0), 1)) == []
