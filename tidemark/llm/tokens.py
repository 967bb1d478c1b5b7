"""Token ids in Re-Pair compressed files, with random access.

Documents are range-partitioned by id, and each range is one shard. A task encodes its documents in
order, ends each with the end id, and packs runs of documents into blocks of bounded size. In each
block the frequent pairs of neighbouring ids become nonterminals, round after round until no pair is
frequent; a block stores its rules, the length that each rule expands to, and the remaining sequence. From the lengths the
place of any token in the sequence follows, so a document is decoded by itself.

Files are Parquet, written by Spark: one row for each block with its shard and number, the ids and
token counts of its documents, and the payload:

    "RPG1" | u32 rules | u32 sequence | u32 first nonterminal | u32 width of a symbol in bytes
    rules x 2 symbols | rules x u32 expansion length | sequence x symbol

Ids are those of the library's ``encode(text, add_special_tokens=False)``: a text that holds the string
of one of the vocabulary's added tokens, such as the one that ends a text, has that token's id there.

Defined results: a null text is empty; an empty text has the end id alone. Rows that repeat are
stored each; equal ids keep the order of their texts' hashes, and null ids come first. A very long text
is encoded whole and closes its block. What a worker remembers is bounded in bytes. An empty table gives files without blocks. Other columns are not stored.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import by_size
from tidemark.llm.pretokens import PATTERN, Memo, encode_all, pieces

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 0
#: Tokens after which a block is closed; one document is never split.
BLOCK = 1 << 20
#: How often a pair must occur in a block to be replaced: a documented bound on the grammar. Rarer pairs
#: stay as they are; a rule for one would save at most a few bytes and cost as many in the table.
OFTEN = 16

MAGIC = b"RPG1"
FILES = "shard int, block int, doc_ids array<long>, n_tokens array<long>, payload binary"


# --- grammar -----------------------------------------------------------------------------------

def compress(ids: np.ndarray, first: int, rounds: int | None = None) -> bytes:
    """A block's payload; ``first`` is above all ids and becomes the first nonterminal. Rounds go on
    until no pair occurs ``OFTEN`` times, unless ``rounds`` ends them before."""
    seq, rules, made = ids.astype(np.uint32), [], 0
    # the places to look at: from the second round on those next to a new symbol or with a pair that
    # was frequent, as no other pair's count grows
    live = np.arange(max(0, len(seq) - 1))
    while len(live) and (rounds is None or len(rules) < rounds):
        # while symbols fit in two bytes, so do pairs in four
        kind, bits = (np.uint32, 16) if first + made <= 1 << 16 else (np.uint64, 32)
        pair = (seq[live].astype(kind) << kind(bits)) | seq[live + 1]
        chosen, rank = _frequent(pair)
        if not len(chosen):
            break
        some = np.flatnonzero(rank < len(chosen))
        live, rank = live[some], rank[some]
        # of overlapping pairs the more frequent one stays, of a run of equal ones every second
        near, step = np.diff(live) == 1, np.diff(rank)
        free = np.ones(len(live), bool)
        free[:-1] &= ~(near & (step < 0))
        free[1:] &= ~(near & (step > 0))
        if len(run := np.flatnonzero(near & (step == 0))):
            begin = np.maximum.accumulate(np.where(np.diff(run, prepend=-2) > 1, run, 0))
            free[run[(run - begin) % 2 == 0] + 1] = False
        take = np.flatnonzero(free)
        # the most frequent pair loses no place to others, so every round has a rule
        used = np.bincount(rank[take], minlength=len(chosen))
        good = np.flatnonzero(used >= OFTEN // 2)
        name = np.zeros(len(chosen), np.uint32)
        name[good] = first + made + np.arange(len(good), dtype=np.uint32)
        take = take[name[rank[take]] > 0]
        at = live[take]
        rules.append(np.stack([chosen[good] >> kind(bits), chosen[good] & kind((1 << bits) - 1)], 1))
        made += len(good)
        seq[at] = name[rank[take]]
        stay, look = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        stay[at + 1] = False
        look[live] = True
        seq, look = seq[stay], look[stay]
        at -= np.arange(len(at))
        look[at] = look[np.maximum(at, 1) - 1] = True
        live = np.flatnonzero(look[:-1])
    table = np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32)
    kind = np.dtype("<u2") if first + made <= 1 << 16 else np.dtype("<u4")
    head = np.array([len(table), len(seq), first, kind.itemsize], "<u4")
    return b"".join([MAGIC, head.tobytes(), table.astype(kind).tobytes(),
                     _lengths(table, first).astype("<u4").tobytes(), seq.astype(kind).tobytes()])


def _frequent(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frequent pairs, most frequent first, and each place's pair among them, or their number.

    Pairs are counted exactly, in a table by hash: where pairs share a slot one of them is counted,
    and the others go on to a table by another hash, until too few are left to be frequent."""
    bits = max(8, min(18, len(pair).bit_length() + 1))  # a table that stays in the cache
    kind = pair.dtype.type
    spread, odd = (0x9E3779B1, 0x85EBCA6B) if kind is np.uint32 else (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    group = np.full(len(pair), -1, np.int32)
    owner, pairs, counts, made = np.zeros(1 << bits, kind), [], [], 0
    rest, left = slice(None), pair
    while len(left) >= OFTEN:
        place = ((left * kind(spread)) >> kind(8 * pair.dtype.itemsize - bits)).astype(np.int64)
        owner[place] = left
        own = owner[place] == left
        count = np.bincount(place[own], minlength=1 << bits)
        often = np.flatnonzero(count >= OFTEN)
        number = np.full(1 << bits, -1, np.int32)
        number[often] = made + np.arange(len(often))
        group[rest] = np.where(own, number[place], -1)
        pairs.append(owner[often])
        counts.append(count[often])
        made += len(often)
        other = np.flatnonzero(~own)
        place = place[other]
        other = other[(np.bincount(place, minlength=1 << bits) >= OFTEN)[place]]
        rest = other if isinstance(rest, slice) else rest[other]
        left = left[other]
        spread = spread * odd % (1 << 8 * pair.dtype.itemsize)
    if not made:
        return pair[:0], np.zeros(len(pair), np.int32)
    order = np.argsort(-np.concatenate(counts), kind="stable")
    rank = np.full(made + 1, made, np.int32)  # the last is that of group -1
    rank[order] = np.arange(made)
    return np.concatenate(pairs)[order], rank[group]


def _lengths(table: np.ndarray, first: int) -> np.ndarray:
    """Tokens that each rule expands to. A round's rules use only what came before the round."""
    out = np.zeros(len(table), np.int64)
    while len(todo := np.flatnonzero(out == 0)):
        size = [np.where(s < first, 1, out[np.where(s < first, 0, s.astype(np.int64) - first)])
                for s in table[todo].T]
        ready = (size[0] > 0) & (size[1] > 0)
        out[todo[ready]] = (size[0] + size[1])[ready]
    return out


class Block:
    """A payload that can be read from any token on."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        rules, sequence, self.first, width = np.frombuffer(payload, "<u4", 4, 4).tolist()
        kind, at = np.dtype(f"<u{width}"), 20
        self.table = np.frombuffer(payload, kind, 2 * rules, at).reshape(-1, 2).astype(np.int64)
        at += 2 * rules * width
        self.length = np.frombuffer(payload, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.sequence = np.frombuffer(payload, kind, sequence, at).astype(np.int64)
        self.left = self._size(self.table[:, 0])
        size = self._size(self.sequence)
        self.upto = np.concatenate([[0], np.cumsum(size)])

    def _size(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        high = symbols >= self.first
        out[high] = self.length[symbols[high] - self.first]
        return out

    def read(self, start: int, stop: int) -> np.ndarray:
        """Tokens from ``start`` up to ``stop``; only the symbols that cover them are expanded."""
        lo = max(0, int(np.searchsorted(self.upto, start, "right")) - 1)
        hi = int(np.searchsorted(self.upto, stop))
        symbols, at = self.sequence[lo:hi], self.upto[lo:hi] - self.upto[lo]
        out = np.empty(int(self.upto[hi] - self.upto[lo]), np.int64)
        while len(symbols):
            out[at] = symbols
            high = np.flatnonzero(symbols >= self.first)
            rule, at = symbols[high] - self.first, at[high]
            symbols = self.table[rule].T.ravel()
            at = np.concatenate([at, at + self.left[rule]])
        return out[start - self.upto[lo]:stop - self.upto[lo]].astype("<u4")


# --- encoding ----------------------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen,
    else the next letter from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """The library's ids of whole texts. Texts are split into pieces as the vocabulary's own
    pre-tokenizer does; what pieces and chunks become is remembered, within bounds."""

    LETTERS = _byte_letters()
    #: Bytes that remembered pieces and parts may take.
    PIECES, PARTS = 32 << 20, 300 << 20

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.size = tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._code = "H" if self.kind.itemsize == 2 else "I"
        self.pieces = Memo(self._piece, self.PIECES)
        self.parts = Memo(self._part, self.PARTS)
        self._blank = self.LETTERS[32]
        self._pack = [struct.Struct(f"<{n}{self._code}").pack for n in range(32)]

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode("utf-8", "replace").decode("latin-1").translate(self.LETTERS)
        return self._packed([t.id for t in self.model.tokenize(letters)])

    def _packed(self, ids: list[int]) -> bytes:
        if len(ids) < len(self._pack):
            return self._pack[len(ids)](*ids)
        return struct.pack(f"<{len(ids)}{self._code}", *ids)

    def _part(self, part: str) -> bytes:
        if part.isalpha():  # a piece by itself, remembered as a part; ASCII letters stand for themselves
            if part.isascii():
                return self._packed([t.id for t in self.model.tokenize(self._blank + part)])
            return self._piece(" " + part)
        return b"".join(map(self.pieces.__getitem__, pieces(part)))

    def _first(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PATTERN.findall(text)))

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids of texts; special tokens' strings in them are ordinary text."""
        return encode_all(texts, self._first, self._first, self.parts.__getitem__, self.kind)

    def encode_added(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids of texts in which the strings of added tokens are these tokens, as the library
        takes them unless told otherwise. Such texts are rare, and the library's own."""
        out = [b""] * len(texts)
        own = [i for i, text in enumerate(texts) if not any(token in text for token in self.added)]
        for i in set(range(len(texts))) - set(own):
            out[i] = self._packed(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        for i, ids in zip(own, self.encode_all([texts[i] for i in own]), strict=True):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY, end: int = END, shards: int | None = None) -> None:
    """Encode every document and write the files of all shards, in ascending order of id."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = encoder(vocabulary), 0
        shard = TaskContext.get().partitionId()
        ids, held, tokens = [], [], 0

        def close() -> pa.RecordBatch:
            sizes = [len(h) // own.kind.itemsize for h in held]
            payload = compress(np.frombuffer(b"".join(held), own.kind), own.size)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([payload], pa.binary())], names=["shard", "block", "doc_ids", "n_tokens", "payload"])

        last = np.array([end], own.kind).tobytes()
        for batch in batches:
            for part in by_size(batch, 1):
                keys, texts = (c.to_pylist() for c in part.columns)
                for key, packed in zip(keys, own.encode_added([t or "" for t in texts]), strict=True):
                    ids.append(key)
                    held.append(packed + last)
                    tokens += len(held[-1]) // own.kind.itemsize
                    if tokens >= BLOCK:
                        yield close()
                        ids, held, tokens, block = [], [], 0, block + 1
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("h"))
    rows.repartitionByRange(shards, "id", "h").sortWithinPartitions("id", "h").select(
        "id", "text").mapInArrow(run, FILES).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, nth, doc_id, offset, n_tokens, ids) of every document in the files: ``ids`` as
    little-endian unsigned 32-bit integers, ``offset`` in the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = Block(row["payload"])
                sizes = np.array(row["n_tokens"], np.int64)
                offsets = np.cumsum(sizes) - sizes
                for at in range(0, len(sizes), 256):
                    some = slice(at, at + 256)
                    start, stop = int(offsets[at]), int(offsets[some][-1] + sizes[some][-1])
                    raw = tokens.read(start, stop).tobytes()
                    n = len(sizes[some])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                        pa.array(np.arange(at, at + n), pa.int32()),
                        pa.array(row["doc_ids"][some], pa.int64()), pa.array(offsets[some]),
                        pa.array(sizes[some]),
                        pa.array([raw[4 * (o - start):4 * (o - start + s)]
                                  for o, s in zip(offsets[some].tolist(), sizes[some].tolist())], pa.binary())],
                        names=["shard", "block", "nth", "doc_id", "offset", "n_tokens", "ids"])

    files = spark.read.schema(FILES).parquet(path)
    return files.mapInArrow(run, "shard int, block int, nth int, doc_id long, offset long, "
                                 "n_tokens long, ids binary")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, start): tokens of all blocks before. Blocks are summed within shards, and
    only the shards' totals are ordered as a whole."""
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)
    blocks = spark.read.schema(FILES).parquet(path).select("shard", "block", total.alias("n"))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("all")).select(
        "shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    return blocks.withColumn("inside", inside).join(shards, "shard").select(
        "shard", "block", (F.col("before") + F.col("inside")).alias("start"))


