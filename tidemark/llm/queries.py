"""The registered queries of this subpackage and their SQL counterparts.

Each query applies one operator, with production parameters, to a whole table, and derives the
columns of its result from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    collocations,
    decontamination,
    embeddings,
    fingerprints,
    jaccard,
    languages,
    licenses,
    lines,
    mixing,
    spelling,
    tokens,
    toxicity,
)
from tidemark.llm.common import crc_mod, table
from tidemark.session import scratch


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_sets(table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "llm-token-files")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path)
    # the digest is taken before the join, which then moves no ids
    read = tokens.read_tokens(spark, path).select(
        "shard", "block", "doc_id", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(tokens.starts(spark, path), ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.learn(docs.where(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("_toxic").alias("score"),
        (F.col("_toxic") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = languages.learn(docs.where(~held_out))
    return languages.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"),
        F.col("_sure").alias("score"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("repeats") * F.col("size")).alias("taken"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_token_files": op4_token_files,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(CAST(embedding AS DOUBLE[]),
                                lambda e: e IS NULL OR NOT isfinite(e))) = 0
            AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda e: e <> 0)) > 0),
        e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
              ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
              AND list_cosine_similarity(a.x, b.x) >= 0.98),
        r(u, w) AS (SELECT vec_id, vec_id FROM embeddings
                    UNION SELECT r.u, e.w FROM r JOIN e ON r.w = e.u),
        c AS (SELECT u, MIN(w) AS component_id FROM r GROUP BY u),
        n AS (SELECT u, COUNT(*) AS k FROM e GROUP BY u)
        SELECT m.vec_id, COALESCE(n.k, 0) AS n_links, c.component_id,
               m.vec_id = c.component_id AS kept
        FROM embeddings m JOIN c ON c.u = m.vec_id LEFT JOIN n ON n.u = m.vec_id""",
    "op2_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
          FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS parts FROM documents)),
        k AS (SELECT doc_id, i, line, translate(
                regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        often AS (SELECT key FROM k WHERE length(key) >= 1
                  GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 10),
        f AS (SELECT k.*, o.key IS NOT NULL AS gone FROM k LEFT JOIN often o ON o.key = k.key)
        SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_dropped,
               sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), ''))
                 AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op8_source_mixing": r"""
        WITH d AS (
          SELECT doc_id, source,
                 len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 CAST('0x' || left(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 12) AS BIGINT) AS k
          FROM documents),
        s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1
                             AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS lim FROM s),
        l AS (SELECT *, ((SELECT CAST(SUM(source_size) AS DOUBLE) FROM s) - COALESCE(SUM(lim) OVER (
                  ORDER BY source_size / weight, encode(source) NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / SUM(weight) OVER (ORDER BY source_size / weight, encode(source) NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
        a AS (SELECT arg_min(lev, source_size / weight) AS lev FROM l WHERE lev * weight <= lim),
        t AS (SELECT l.source, source_size, least(lim, weight * a.lev) AS target FROM l, a),
        u AS (SELECT d.doc_id, d.source, d.k, d.size, t.source_size, t.target, SUM(d.size) OVER (
                PARTITION BY d.source ORDER BY d.k) AS upto
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT u.*, r.r, CASE WHEN target > 0
                THEN CAST(upto + r.r * source_size AS DOUBLE) / target ELSE r.r END AS finish
              FROM u, (SELECT unnest([0, 1, 2]) AS r) r),
        c AS (SELECT *, SUM(size) OVER (ORDER BY finish, encode(source) NULLS LAST, k, r) AS total
              FROM q)
        SELECT doc_id, size, source_size, target,
               CAST(SUM(CASE WHEN total <= (SELECT SUM(size) FROM d) THEN size ELSE 0 END) AS BIGINT)
                 AS taken
        FROM c GROUP BY doc_id, size, source_size, target""",
    "op12_phrase_collocations": r"""
        WITH pieces AS (
          SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(translate(COALESCE(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
              FROM pieces),
        g AS (SELECT lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase, COUNT(*) AS f
              FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s
                    FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
        sizes AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS p FROM g WHERE k > 1 AND f >= 10),
        cuts AS (SELECT c.*, cut, array_to_string(list_slice(p, 1, cut), ' ') AS x,
                        array_to_string(list_slice(p, cut + 1, k), ' ') AS y
                 FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
        scored AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.p, cuts.f AS a, cut, l.f AS l, r.f AS r,
                     CAST((CAST(1000000 AS HUGEINT) * cuts.f * cuts.f) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT)
                       AS score
                   FROM cuts JOIN g l ON l.lang = cuts.lang AND l.phrase = cuts.x
                             JOIN g r ON r.lang = cuts.lang AND r.phrase = cuts.y),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
        inner_ AS (SELECT lang, array_to_string(list_slice(p, s, s + 1), ' ') AS phrase, MAX(f) AS longer
                   FROM c, (SELECT unnest([1, 2]) AS s) WHERE k = 3 GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
                 WHERE nth = 1 AND NOT COALESCE(100 * longer >= 50 * a, FALSE)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
                     AS rank FROM kept)
        SELECT ranked.lang, rank, phrase, a, l, r, n, score
        FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""",
    "op13_benchmark_decontamination": r"""
        WITH d AS (
          SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        i AS (
          SELECT item_id, list_filter(string_split_regex(translate(COALESCE(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS part
               FROM (SELECT *, least(10, len(w)) AS size,
                            unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s
                     FROM i WHERE len(w) > 0)),
        hit AS (SELECT doc_id, s, size, part FROM (
                  SELECT doc_id, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS part
                  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s
                        FROM d, (SELECT DISTINCT size FROM iw)))
                WHERE part IN (SELECT part FROM iw)),
        n AS (SELECT doc_id, COUNT(DISTINCT place) AS n_hit
              FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS place FROM hit) GROUP BY doc_id),
        m AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, string_agg(
                DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
              FROM hit JOIN iw ON iw.part = hit.part GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit,
               COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256,
               COALESCE(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""",
}
