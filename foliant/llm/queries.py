"""The registered queries of this subpackage, each with its production parameters, and their SQL."""

from __future__ import annotations

import os
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, exact_dedup, html_extract, licenses, line_dedup, near_dedup, pii, quality, resample, secrets, spiece, toxicity, whitening
from foliant.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_table(table(spark, sf_dir, "documents"))


#: The SentencePiece model whose pieces the queries use; a parameter of the operator.
PIECES = os.environ.get("FOLIANT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digest(spiece.encode(table(spark, sf_dir, "documents"), PIECES, decoded=True))


#: The key of the pseudonyms. Without one of the user's, each process draws its own: values stay linked within a run only.
KEY = os.environ.get("FOLIANT_PSEUDONYM_KEY") or token_hex(32)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pseudonymise(table(spark, sf_dir, "documents"), KEY))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, secrets.fit(docs)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_decontamination": op5_decontamination,
    "op6_main_text": op6_main_text,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_licenses": op13_licenses,
}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
                     max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                     count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
              FROM documents)""",
    "op7_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        marked AS (
            SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op5_decontamination": r"""
        WITH tokens AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS size, w[s : s + least(10, len(w)) - 1] AS run
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0)),
        places AS (
            SELECT doc_id, size, s, w[s : s + size - 1] AS run
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
                  FROM tokens, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
        hits AS (SELECT p.doc_id, p.s, p.size, x.item_id FROM places p JOIN windows x ON p.size = x.size AND p.run = x.run),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
                    FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
        SELECT t.doc_id, len(t.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM tokens t LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    # DuckDB has no crc32: a table of its 256 remainders, then a byte at a time over each distinct word.
    "op12_resampling": r"""
        WITH remainders AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
            FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
        words AS (
            SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
            UNION ALL
            SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
        bytes AS (
            SELECT w, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS bs
            FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM words)),
        buckets AS (
            SELECT w, xor(list_reduce(bs, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
            FROM bytes, remainders),
        counted AS (
            SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN buckets USING (w) GROUP BY 1),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (bs + 10000) / (CAST(s + 1 AS DOUBLE) * (bt + 10000)))) AS BIGINT) AS gain
            FROM counted, (SELECT CAST(sum(s) AS DOUBLE) AS bs, CAST(sum(t) AS DOUBLE) AS bt FROM counted)),
        weights AS (
            SELECT id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
        scored AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM documents LEFT JOIN weights ON doc_id = id),
        ordered AS (
            SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS nth, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN nth <= drawn THEN nth END AS rank FROM ordered""",
}
