"""N-gram Jaccard join: a grouped prefix join that finds which texts belong together.

1. Every text becomes its set of shingle hashes. Rare shingles come first in one order for all
   texts, by hash; those that tasks saw often come last, by how often (at most ``FREQUENT`` of them
   are told apart; the order decides the work and never the result). Two sets that are similar
   enough share at least k shingles among the first n - ceil(threshold n) + k, their prefixes;
   k grows with the size up to ``NEED``, so that chance meetings of long texts are no candidates.
2. Texts with equal sets are one. Sets with equal prefix and size are one group; groups meet at the
   shingles of their prefixes.
3. Where groups meet, all members of like size are first verified against one hub, so that a group
   of copies, however large, costs one comparison each. What lies in one component then needs no
   more comparing, whichever pairs were looked at.
4. Meetings that still join several components are looked at across components. Where few members
   meet, pairs are counted, and those that share enough are compared. So they are where many do, if
   those share little else, as long texts meet by chance in a large corpus. Members that meet many
   others at most of their prefixes are compared in full, in blocks of bounded size, each pair of
   blocks one task. A pair that meets in no block shares all it must where it is counted.

Every pair that may link is verified on whole texts or lies in one component already, so the
components are exact. Links are verified on 64-bit hashes of shingles.

Defined results: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer words than a shingle is one shingle. Rows that repeat an id share their
component; a null id links with nothing. Ties in the order of shingles go by hash and decide the work
only. Very long texts are compared whole; one at a time is held beside a hub. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Forest, components, stored

#: Frequent shingles that are told apart, and how often a batch must see one to report it.
FREQUENT = 1 << 17
SEEN = 2
#: Members of a meeting that are always counted as pairs; rows of a block where they are not.
FEW = 32
BLOCK = 512
#: Share of their prefixes at which members meet many others, from which on they are compared in blocks.
DENSE = 0.5
#: Shingles that the prefixes of long texts must share.
NEED = 8

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, as signed 64-bit integers."""
    # bytes lower A-Z only, and split at just the white space of the contract
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    out = each[:len(each) - width + 1].copy()
    for k in range(1, width):
        out ^= out >> np.uint64(29)
        out = out * _A + each[k:len(each) - width + 1 + k]
    out = (out ^ (out >> np.uint64(31))) * _B
    return np.unique((out ^ (out >> np.uint64(30))).view(np.int64))


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, list[str | None]]:
    return batch.column(0), batch.column(1).to_pylist()


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _often(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles that several different texts of some rows have, with their number."""
        for batch in _slices(batches, 2048):
            sets = {}
            for text in _columns(batch)[1]:
                found = shingle_set(text, words)
                sets[xxhash.xxh3_64_intdigest(found.tobytes())] = found
            values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            some = counts >= SEEN
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[some]), pa.array(counts[some].astype(np.int64))], names=["s", "n"])
    return run


def _prefixes(words: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, size, two halves of the set's hash, prefix)."""
        values, ranks = frequent.value
        for batch in _slices(batches):
            ids, texts = _columns(batch)
            sizes, first, second, prefix = [], [], [], []
            for text in texts:
                found = shingle_set(text, words)
                n = len(found)
                high = xxhash.xxh3_128_digest(found.tobytes())
                if len(values) and n:
                    at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                    rank = np.where(values[at] == found, ranks[at], 0)
                    found = found[np.argsort(rank, kind="stable")]
                sizes.append(n)
                first.append(int.from_bytes(high[:8], "little", signed=True))
                second.append(int.from_bytes(high[8:], "little", signed=True))
                apart = n + (-percent * n) // 100  # how many the other set may lack
                prefix.append(found[:apart + min(NEED, 1 + apart // 4)] if n else found)
            offsets = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()),
                 pa.ListArray.from_arrays(offsets, np.concatenate(prefix).astype(np.int64))],
                names=["id", "n", "h1", "h2", "prefix"])
    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, text of a, text of b) that link; a hub's set is kept while it repeats."""
        hub, known = None, None
        for batch in _slices(batches):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            good = []
            for x, y in zip(ta, tb, strict=True):
                if hub is None or hub != y:
                    hub, known = y, shingle_set(y, words)
                good.append(_linked(shingle_set(x, words), known, percent))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)],
                names=["a", "b"])
    return run


def _across(words: int, percent: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Links between components in one pair of blocks, as many as join what they join."""
        sides = [frame[frame.side == s] for s in (0, 1)]
        left, right = sides[0], sides[1] if len(sides[1]) else sides[0]
        sets = [[shingle_set(t, words) for t in side.text] for side in (left, right)]
        of = np.repeat(np.arange(len(right)), [len(s) for s in sets[1]])
        every = np.concatenate([*sets[1], np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        size = np.array([len(s) for s in sets[1]])
        ids, comp = right.id.to_numpy(), right.comp.to_numpy()
        forest, out = Forest(), []
        for own, root, found in zip(left.id, left.comp, sets[0], strict=True):
            lo, hi = np.searchsorted(every, found), np.searchsorted(every, found, "right")
            some = hi > lo
            at = np.concatenate([np.arange(x, y) for x, y in zip(lo[some], hi[some])]
                                or [np.zeros(0, np.int64)])
            both = np.bincount(of[at], minlength=len(right))
            hit = (100 * both >= percent * (len(found) + size - both)) & (comp != root) & (both > 0)
            out += [(own, ids[j]) for j in np.flatnonzero(hit) if forest.union(int(root), int(comp[j]))]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _need(size: Column, percent: int) -> Column:
    """Shingles that a set's prefix must share with another's; as in :func:`_prefixes`."""
    apart = size - F.ceil(percent * size / 100)
    return F.least(F.lit(NEED), 1 + F.floor(apart / 4))


def _sorted(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, at any size."""
    return side.hint("merge")


def _like_sizes(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def near_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
              percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) of every row; links where 100 |both| >= percent |either|."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    often = rows.mapInArrow(_often(words), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = often.orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas().sort_values("s")
    frequent = spark.sparkContext.broadcast(
        (top.s.to_numpy(np.int64), top.n.to_numpy(np.int64)))
    sets = stored(rows.mapInArrow(_prefixes(words, percent, frequent),
                                  "id long, n long, h1 long, h2 long, prefix array<long>"), "sets")

    # sets and groups are told apart by 128-bit hashes; prefixes themselves move only to be met
    filled = sets.where("n > 0 AND id IS NOT NULL")
    reps = filled.select("id", "n", "h1", "h2", F.xxhash64("prefix").alias("p1"),
                         F.xxhash64(F.lit(1), "prefix").alias("p2"))
    reps = reps.groupBy("n", "h1", "h2", "p1", "p2").agg(F.min("id").alias("rep"))
    groups = reps.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    reps = stored(reps.join(_sorted(groups), ["n", "p1", "p2"]).select(
        "rep", "gid", "n", "h1", "h2", "members"), "reps")
    others = filled.select("id").distinct().join(
        reps.select(F.col("gid").alias("id")), "id", "left_anti")
    tokens = filled.join(_sorted(others), "id", "left_anti").select(
        F.col("id").alias("gid"), F.explode("prefix").alias("s"))
    several = reps.where("members > 1").select("gid").distinct()
    shared = tokens.union(tokens.join(several, "gid")).groupBy("s").agg(F.count("*").alias("k")).where(
        "k > 1").select("s")
    met = stored(tokens.join(_sorted(shared), "s").distinct(), "meetings")

    # the members of groups that meet others often enough, or have several
    size = reps.groupBy("gid").agg(F.min("n").alias("n"), F.max("members").alias("members"))
    enough = met.groupBy("gid").agg(F.count("*").alias("k")).join(size, "gid").where(
        (F.col("k") >= _need(F.col("n"), percent)) | (F.col("members") > 1)).select("gid")
    member = stored(reps.select("rep", "gid", "n").join(_sorted(enough), "gid", "left_semi").distinct(), "members")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    banded = met.join(_sorted(member.select("gid", band.alias("band")).distinct()), "gid")
    hubs = banded.groupBy("s", "band").agg(F.min("gid").alias("hub"))
    star = banded.join(_sorted(hubs), ["s", "band"]).select("gid", "hub")
    # neighbouring bands of sizes meet by their hubs
    next_band = hubs.select("s", (F.col("band") - 1).alias("band"), F.col("hub").alias("next"))
    steps = hubs.join(_sorted(next_band), ["s", "band"]).select(F.col("hub").alias("gid"), F.col("next").alias("hub"))
    size = member.groupBy(F.col("gid").alias("hub")).agg(F.min("n").alias("nb"))
    pairs = star.union(steps).groupBy("gid", "hub").agg(F.count("*").alias("k")).join(
        _sorted(size), "hub")
    pairs = member.join(_sorted(pairs), "gid").where(
        (F.col("rep") != F.col("hub")) & _like_sizes("n", "nb", percent)
        & (F.col("k") >= _need(F.least("n", "nb"), percent)))
    pairs = stored(pairs.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select("a").union(pairs.select("b")).distinct()
        texts = rows.join(_sorted(ids), rows.id == ids.a, "left_semi").distinct()
        a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return stored(pairs.join(_sorted(a), "a").join(_sorted(b), "b").select("a", "b", "ta", "tb").mapInArrow(
            _verify(words, percent), "a long, b long"), name)

    links = verified(pairs, "links")

    # what still joins several components
    comp = components(links)
    placed = member.join(_sorted(comp), member.rep == comp.node, "left").select(
        "rep", "gid", "n", F.coalesce("component", "rep").alias("comp"))
    placed = stored(placed, "placed")
    meeting = met.select("s", "gid").join(_sorted(placed), "gid").select("s", "rep", "n", "comp")
    open_ = meeting.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                     F.count("*").alias("k")).where("low <> high").select("s", "k")
    meeting = stored(meeting.join(_sorted(open_), "s"), "open")
    # a pair that meets at no dense shingle shares all it must at the others; any other is compared in blocks
    few, many = meeting.where(F.col("k") <= FEW), meeting.where(F.col("k") > FEW)
    dense = stored(_dense(many, percent), "dense")
    few = few.union(many.join(dense, "s", "left_anti").select(few.columns))
    many = many.join(dense, "s", "left_semi")
    left = few.select("s", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    right = few.select("s", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    rest = left.join(_sorted(right), "s").where("a < b AND ca <> cb").where(
        _like_sizes("na", "nb", percent)).groupBy("a", "b").agg(
        F.count("*").alias("k"), F.min(F.least("na", "nb")).alias("n")).where(
        F.col("k") >= _need(F.col("n"), percent)).select("a", "b")
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(_sorted(done), ["a", "b"], "left_anti"), "rest")
    links = links.union(verified(rest, "more"))
    if dense.head(1):
        links = links.union(_blocks(rows, many, words, percent))

    edges = links.union(filled.join(_sorted(reps), ["n", "h1", "h2"]).where("id <> rep").select("id", "rep"))
    group = components(edges)
    return sets.join(_sorted(group), sets.id == group.node, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"))


def _dense(many: DataFrame, percent: int) -> DataFrame:
    """Shingles whose members meet many others at most of what they have: at ``DENSE`` of their prefixes."""
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + _need(F.col("n"), percent)
    own = many.groupBy("rep").agg(F.count("*").alias("met"), F.min(length).alias("length"))
    return many.select("s", "rep").join(_sorted(own), "rep").groupBy("s").agg(
        F.sum("met").alias("met"), F.sum("length").alias("length")).where(
        F.col("met") >= DENSE * F.col("length")).select("s")


def _blocks(rows: DataFrame, many: DataFrame, words: int, percent: int) -> DataFrame:
    """Links across components where many members meet; blocks of one component skip each other."""
    firsts = many.groupBy("s").agg(F.min("rep").alias("first"))
    whole = components(many.join(firsts, "s").select("rep", "first"))
    member = many.select("rep", "comp").distinct().join(whole, F.col("rep") == F.col("node")).select(
        "rep", "comp", F.col("component").alias("part"))
    size = member.groupBy("part", "comp").agg(F.count("*").alias("k"))
    small = size.where(F.col("k") < BLOCK).groupBy("part").agg(F.sum("k").alias("small"))
    member = member.join(size, ["part", "comp"]).join(small, "part", "left")
    own = F.col("k") >= BLOCK
    blocks = F.ceil(F.when(own, F.col("k")).otherwise(F.col("small")) / BLOCK)
    member = stored(member.select(
        "part", F.col("rep").alias("id"), "comp", F.concat_ws(
            "/", F.when(own, F.col("comp").cast("string")).otherwise(F.lit("some")),
            F.pmod(F.xxhash64("rep"), blocks).cast("string")).alias("block"),
        F.when(own, F.col("comp")).alias("whole")), "blocks")
    listed = member.select("part", "block", "whole").distinct()
    other = listed.select("part", F.col("block").alias("second"), F.col("whole").alias("whole2"))
    met = listed.withColumnRenamed("block", "first").join(other, "part").where(
        "first <= second AND NOT coalesce(whole = whole2, false)").select("part", "first", "second")
    sent = met.select("part", "first", "second", F.explode(F.when(
        F.col("first") == F.col("second"), F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("block"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("block")),
                           F.struct(F.lit(1).alias("side"), F.col("second").alias("block"))))).alias("x"))
    sent = sent.select("part", "first", "second", "x.side", "x.block")
    texts = rows.join(member, "id").select("part", "block", "id", "comp", "text")
    return stored(texts.join(sent, ["part", "block"]).groupBy("part", "first", "second").applyInPandas(
        _across(words, percent), "a long, b long"), "across")
