"""Byte-level BPE by longest matches and backtracking, in linear time, and back.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds at once every token that ends
at each place of a piece. From each place the longest match is tried first; it stands if the token
before it and it are what the merges make of their joint bytes. That is found by undoing the merges
on either side of the border, the later one first, until one would have been made across it sooner,
and is remembered for each pair.
If none stands, the token before gives way to its next shorter match. A sequence whose neighbours
all agree is exactly what the merges make of the whole piece, and each place is given up at most
once, and looks no further ahead than the longest token, so the work is linear in the piece's length,
however long a text goes on without a break.

Defined results: a null text is empty; an empty text has no ids. Rows that repeat are encoded each.
Very long texts are encoded whole, piece by piece, and ties do not arise. What is remembered is bounded
in bytes and given up at the end of a task. An empty table gives an empty table. All columns of the input stay; those named like the results are
replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Sequence

import ahocorasick
import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_column
from tidemark.llm.pretokens import PATTERN, Memo, encode_all, pieces

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, of a file with one base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairs:
    """Encoder and decoder for one vocabulary. Everything remembered is bounded."""

    #: Pairs that are remembered, and bytes of pieces and chunks: some 70 MB in all.
    PAIRS, PIECES, CHUNKS = 150_000, 16 << 20, 40 << 20

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.agreed: dict[int, bool] = {}  # by left << 32 | right
        self.size = [len(token) for token in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        # a token that the merges do not make can only be a whole piece
        made, self.split = {}, {}
        for token, rank in ranks.items():
            last = self._merged(token, 2)
            if len(last) <= 2:  # two parts whose bytes are a token are joined
                made[token] = rank
            if len(last) == 2:
                self.split[rank] = tuple(ranks[t] for t in last)
        self.joined = {a << 32 | b: rank for rank, (a, b) in self.split.items()}
        self.longest = max(map(len, made))
        for token, rank in made.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        #: for each token, the next shorter one that begins as it does
        self.shorter = {r: next(made[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in made)
                        for t, r in made.items() if len(t) > 1}
        self.pieces = Memo(self._piece, self.PIECES)
        self.memo = Memo(self._part, self.CHUNKS)

    def _piece(self, piece: str) -> bytes:
        ids = self.piece(piece.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        if part.isalpha():  # a piece by itself, remembered as a chunk
            return self._piece(" " + part)
        return b"".join(map(self.pieces.__getitem__, pieces(part)))

    def forget(self) -> None:
        for memo in (self.pieces, self.memo, self.agreed):
            memo.clear()

    def _merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges as defined: join the neighbours of the lowest rank until none can be, or until
        ``least`` parts are left."""
        out, ranks = [data[i:i + 1] for i in range(len(data))], self.ranks
        while len(out) > least:
            best, at = min(((ranks.get(out[i] + out[i + 1], len(self.bytes_of)), i)
                            for i in range(len(out) - 1)))
            if best == len(self.bytes_of):
                break
            out[at:at + 2] = [out[at] + out[at + 1]]
        return out

    def agree(self, left: int, right: int) -> bool:
        """Whether the merges make just these two tokens of their joint bytes."""
        if len(self.agreed) >= self.PAIRS:
            self.agreed.clear()
        return self.agreed.setdefault(left << 32 | right, self._apart(left, right))

    def _apart(self, left: int, right: int) -> bool:
        """Undo the merges at the border, the later one first: the tokens stand if no two parts that
        met there could be joined before the merge that was undone last."""
        joined, split, limit = self.joined, self.split, len(self.bytes_of)
        while True:
            if joined.get(left << 32 | right, limit) < limit:
                return False
            a, b = left if left in split else -1, right if right in split else -1
            if a > b:
                left, limit = split[left][1], a
            elif b >= 0:
                # of equal ranks the left one is joined first
                right, limit = split[right][0], b + 1
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        find, far, shorter, size = self.automaton.iter_long, self.longest, self.shorter, self.size
        agreed, agree = self.agreed, self.agree
        text, n = data.decode("latin-1"), len(data)
        out: list[int] = []
        dead: set[int] = set()
        at, rank = 0, next(find(text[:far]))[1]
        while True:
            end = at + size[rank]
            stands = end not in dead
            if stands and out:
                stands = agreed.get(out[-1] << 32 | rank)
                if stands is None:
                    stands = agree(out[-1], rank)
            if stands:
                out.append(rank)
                if end == n:
                    return out
                at, rank = end, next(find(text[end:end + far]))[1]
                continue
            step = shorter.get(rank)
            while step is None:
                # nothing stands here after the token before; no other way to this place will do
                dead.add(at)
                rank = out.pop()
                at -= size[rank]
                step = shorter.get(rank)
            rank = step

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PATTERN.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        return encode_all(texts, self.packed, self.packed, self.memo.__getitem__, np.dtype("<u4"))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_LOADED: dict[str, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    """This worker's encoder; the vocabulary is read once for each process."""
    if path not in _LOADED:
        _LOADED[path] = BytePairs(read_ranks(path))
    return _LOADED[path]


def encode_texts(docs: DataFrame, text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``docs`` with ``_ids``, packed, none for null or empty text."""
    return with_column(docs, lambda texts: [loaded(ranks).encode_all([x or "" for x in texts])],
                       {"_ids": "binary"}, text_col, 1024, lambda: loaded(ranks).forget(), 3 << 20)


def decode_ids(encoded: DataFrame, ids_col: str = "_ids", ranks: str = RANKS) -> DataFrame:
    """``encoded`` with ``_bytes`` made from its packed ids alone; a null has none."""
    return with_column(encoded, lambda ids: [[x and loaded(ranks).decode(x) for x in ids]],
                       {"_bytes": "binary"}, ids_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS
            ) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    out = decode_ids(encode_texts(docs.select(id_col, text_col), text_col, ranks), "_ids", ranks)
    return out.select(
        id_col, (F.length("_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"))
