"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, jaccard_join, language_id, lm_score, near_dedup, packing, periodic_runs, pieces, quality, sharding, substring_dedup, whitening

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).drop("in_history")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language_id.classify(docs, language_id.learn(docs.where(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), RANKS, PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = documents(spark, sf_dir)
    found = lm_score.scores(docs.select("doc_id", "text"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), words=3, similarity=0.85).drop("rid")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digested(documents(spark, sf_dir), PIECES)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(documents(spark, sf_dir), rewrite=True, texts=False)


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir), words=5, similarity=0.8).drop("rid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_html_extract": op3_html_extract,
    "op4_extendible_sharding": op4_extendible_sharding,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_score": op7_lm_score,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

ORACLE = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op4_extendible_sharding": """
        WITH t AS (SELECT row_number() OVER () AS k, doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                   CAST('0x' || substr(md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS UBIGINT) AS h FROM documents),
             p AS (SELECT k, doc_id, n_bytes, h, CAST(d AS INT) AS depth, CAST(sum(n_bytes) OVER (PARTITION BY d, h >> CAST(60 - d AS UBIGINT)) AS BIGINT) AS shard_bytes FROM t, range(0, 61) AS r(d)),
             q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY depth) AS nth FROM p WHERE shard_bytes <= 1048576)
        SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(h >> CAST(60 - depth AS UBIGINT)), depth, '0') END AS shard_id, depth, shard_bytes, false AS oversize
        FROM q WHERE nth = 1""",
    "op8_minhash_dedup": """
        WITH RECURSIVE t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT k, md5(array_to_string(w[i : i + 2], ' ')) AS h FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)),
             n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
             p AS (SELECT a.k AS a, b.k AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.k < b.k GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n na ON na.k = a JOIN n nb ON nb.k = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT k, k AS o FROM t UNION SELECT r.k, e.b FROM r JOIN e ON r.o = e.a),
             c AS (SELECT r.k, min(t.doc_id) AS component_id FROM r JOIN t ON t.k = r.o GROUP BY r.k)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM t JOIN c USING (k) LEFT JOIN n USING (k)""",
    "op10_substring_dedup": """
        WITH t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             v AS (SELECT k, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
             m AS (SELECT h, min(doc_id) AS low FROM v GROUP BY h),
             x AS (SELECT DISTINCT k, unnest(range(i, i + 50)) AS j FROM v JOIN m USING (h) WHERE low < doc_id),
             u AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM t),
             g AS (SELECT u.k, count(*) AS n_words, count(x.j) AS n_removed, string_agg(word, ' ' ORDER BY u.j) FILTER (x.j IS NULL) AS kept FROM u LEFT JOIN x ON u.k = x.k AND u.j = x.j GROUP BY u.k)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN g USING (k)""",
    "op12_periodic_runs": """
        WITH b AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS o,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) AS h FROM documents),
             t AS (SELECT *, len(o) AS n, (h // 10) % len(o) AS a, 1 + (len(o) - (h // 10) % len(o)) // (3 + (h // 10) % 8) AS p FROM b WHERE len(o) > 0),
             u AS (SELECT k, i, o[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM t)),
             m AS (SELECT x.k, y.i - x.i AS q, y.i FROM u AS x JOIN u AS y ON x.k = y.k AND x.word = y.word AND x.i < y.i),
             s AS (SELECT k, q, min(i) - q AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS stretch FROM m) GROUP BY k, q, stretch),
             r AS (SELECT k, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY k, start, length),
             g AS (SELECT k, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS said FROM r GROUP BY k),
             f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS nth FROM r) WHERE nth = 1),
             d AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r),
             c AS (SELECT u.k, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN d ON u.k = d.k AND u.i = d.i WHERE d.i IS NULL GROUP BY u.k)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM b LEFT JOIN g USING (k) LEFT JOIN f USING (k) LEFT JOIN c USING (k)""",
    "op13_ngram_jaccard_join": """
        WITH RECURSIVE t AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT k, md5(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
             n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
             p AS (SELECT a.k AS a, b.k AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.k < b.k GROUP BY ALL),
             l AS (SELECT a, b FROM p JOIN n na ON na.k = a JOIN n nb ON nb.k = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT k, k AS o FROM t UNION SELECT r.k, e.b FROM r JOIN e ON r.o = e.a),
             c AS (SELECT r.k, min(t.doc_id) AS component_id FROM r JOIN t ON t.k = r.o GROUP BY r.k)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM t JOIN c USING (k) LEFT JOIN n USING (k)""",
}
