"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors of a label fall into blocks by a hash of their values; each pair of blocks is one tile.
Within a tile the quantised vectors are multiplied at once, and from the bound of each vector's
quantisation error a pair is surely below the threshold, surely above, or recomputed in double
precision. Equal vectors of a label travel once, with their number.

Defined results: a vector that is null, empty, zero or has a null or non-finite component, and any
vector without label, links with nothing and is its own component. Vectors of unequal length do
not link. Rows that repeat an id count as one vector for each row when links are counted; a null
id links with nothing. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, stored

#: Rows of a block; a tile's product has the square of it.
BLOCK = 2048
#: Rounding of the double-precision sums the bounds are made of, for up to a million dimensions.
SLACK = 1e-9
#: Sums of this many products of two int8 values are exact in single precision.
EXACT = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit rows, their int8 codes (as float32), scales, lengths of what the codes stand for, and
    lengths of the errors."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    error = unit - codes * scale[:, None]
    length = np.sqrt(np.einsum("ij,ij->i", codes, codes)) * scale
    return unit, codes.astype(np.float32), scale, length, np.sqrt(np.einsum("ij,ij->i", error, error))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, rows: int = 256
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into ``a``, into ``b``) with cosine >= threshold, strip by strip of ``a``.

    With u = s q + e for each unit vector, u.v = s_u s_v (q_u.q_v) + (s_u q_u).e_v + e_u.v, so the
    product of the codes is off by at most |s_u q_u| |e_v| + |e_u|.
    """
    ua, qa, sa, la, ea = quantise(a)
    ub, qb, sb, _, eb = quantise(b)
    for at in range(0, len(a), rows):
        part = slice(at, at + rows)
        product = np.zeros((len(qa[part]), len(qb)))
        for d in range(0, a.shape[1], EXACT):
            product += qa[part, d:d + EXACT] @ qb[:, d:d + EXACT].T
        product *= sa[part, None]
        product *= sb
        bound = la[part, None] * eb + (ea[part, None] + SLACK)
        i, j = np.nonzero(product + bound >= threshold)
        unsure = product[i, j] - bound[i, j] < threshold
        keep = ~unsure
        for k in range(0, len(at_ := np.flatnonzero(unsure)), 65536):
            some = at_[k:k + 65536]
            x, y = a[i[some] + at], b[j[some]]
            dot = np.einsum("ij,ij->i", x, y)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))
            keep[some] = dot / norm >= threshold
        yield i[keep] + at, j[keep]


def _tile(threshold: float):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Of one tile: for each vector with links, how many and one edge towards its root."""
        _, first, second = key
        frame = frame.sort_values("id", kind="stable")
        left = frame[frame.block == first]
        right = frame[frame.block == second]
        same = first == second
        parts = [left] if same else [left, right]
        ids = np.concatenate([p.id for p in parts])
        copies = np.concatenate([p.copies for p in parts])
        shift = 0 if same else len(left)
        links, root = np.zeros(len(ids), np.int64), np.argsort(np.argsort(ids, kind="stable"))
        if len(left) and len(right):
            x = np.array(left.x.tolist(), np.float64)
            y = x if same else np.array(right.x.tolist(), np.float64)
            for i, j in tile_links(x, y, threshold):
                j = j + shift
                if same:
                    i, j = i[i != j], j[i != j]
                else:
                    np.add.at(links, j, copies[i])
                np.add.at(links, i, copies[j])
                _join(root, i, j)
        hit = np.flatnonzero(links)
        by_rank = np.sort(ids)
        return pd.DataFrame({"id": ids[hit], "links": links[hit], "root": by_rank[root[hit]]})
    return run


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Let the members of linked pairs share the smallest root; a row of links at a time."""
    cuts = np.flatnonzero(np.diff(i)) + 1
    for p, q in zip(i[np.r_[0, cuts]] if len(i) else (), np.split(j, cuts), strict=False):
        met = root[q]
        if (met != root[p]).any():
            met = np.unique(np.append(met, root[p]))
            root[np.isin(root, met)] = met[0]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK
                 ) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; see the module's text."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("x"))
    good = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
            & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists("x", lambda v: v != 0))
    # -0.0 and 0.0 are one value to a comparison, but not to a hash
    valid = rows.where(good).withColumn("x", F.transform("x", lambda v: v + F.lit(0.0)))
    valid = valid.withColumn("label", F.concat("label", F.lit("/"), F.size("x").cast("string")))
    distinct = stored(valid.groupBy("label", "x").agg(F.min("id").alias("id"),
                                                      F.count("*").alias("copies")), "vectors")
    count = distinct.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = distinct.join(count, "label").withColumn(
        "block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    sent = placed.select("id", "copies", "x", "block", "label", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "id", "copies", "x", "block", "label", F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"))
    found = stored(sent.groupBy("label", "first", "second").applyInPandas(
        _tile(threshold), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # copies hang on the smallest id of their vector
    twins = valid.join(distinct.where("copies > 1").select(
        "label", "x", F.col("id").alias("rep"), "copies"), ["label", "x"])
    twins = twins.select("id", "rep", "copies")
    edges = found.select("id", "root").union(twins.select("id", "rep"))
    group = components(edges)
    own = twins.select("id", "rep", (F.col("copies") - 1).alias("same")).join(
        links.withColumnRenamed("id", "rep"), "rep", "left").select(
        "id", (F.col("same") + F.coalesce("links", F.lit(0))).alias("n"))
    single = links.join(twins.select("id").distinct(), "id", "left_anti").select(
        "id", F.col("links").alias("n"))
    total = own.union(single).groupBy("id").agg(F.max("n").alias("n_links"))
    out = rows.select("id").join(total, "id", "left").join(
        group.select(F.col("node").alias("id"), "component"), "id", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component", "id")).alias("kept"))
