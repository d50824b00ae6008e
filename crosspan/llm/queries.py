"""The registered queries of this subpackage, and their SQL where SQL can express them.

The others have results that SQL can't give: learned scores, XXH64, tokenizers, media formats, rule sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspan.llm import arc, decontam, dialogue, exact, licenses, media, negatives, packing, ppm, repeats, secrets, simhash, toxicity
from crosspan.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, labels))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(read(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.archived(read(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents"))


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_digests(read(spark, sf_dir, "conversations"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are wrong on purpose, and each hundredth row is an anchor."""
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_ppm, op3_decontam, op4_repeats, op5_packing, op6_warc, op7_media, op8_licenses, op9_secrets, op10_simhash, op11_exact, op12_dialogue, op13_negatives)
}
SQL: dict[str, str] = {
    # Each start of 200 bytes, in hexadecimal digits; bytes under a start that occurs elsewhere too go.
    "op4_repeats": """
        WITH source AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        texts AS (SELECT r, doc_id, hex(encode(t)) AS h, octet_length(encode(t)) AS n FROM source),
        starts AS (SELECT r, unnest(range(n - 199)) AS place, h FROM texts WHERE n >= 200),
        named AS (SELECT r, place, substr(h, 2 * place + 1, 400) AS s FROM starts),
        many AS (SELECT s FROM named GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT r, place, place - lag(place, 1, -1000) OVER (PARTITION BY r ORDER BY place) > 200 AS opens FROM named JOIN many USING (s)),
        runs AS (SELECT r, place, sum(opens::INT) OVER (PARTITION BY r ORDER BY place) AS run FROM gone),
        spans AS (SELECT r, run, min(place) AS a, max(place) + 200 AS b FROM runs GROUP BY r, run),
        edges AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS kept_from FROM spans),
        kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS k
                 FROM edges JOIN texts USING (r) GROUP BY r)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(k || substr(h, 2 * tail + 1), h))) AS kept_sha256
        FROM texts LEFT JOIN kept USING (r)
    """,
    # A digest's 160 bits in groups of five, from the nibbles that hold them.
    "op6_warc": """
        WITH source AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        digests AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM source),
        parts AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
                      (instr('0123456789abcdef', substr(h, ((5 * i) // 4 + 1)::INT, 1)) - 1) * 16
                      + instr('0123456789abcdef', substr(h, ((5 * i) // 4 + 2)::INT, 1)) - 1) >> (3 - (5 * i) % 4)::INT) & 31)::INT, 1)) AS letters FROM digests)
        SELECT page_id, n AS payload_bytes, array_to_string(letters, '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM parts
    """,
    "op11_exact": r"""
        WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM texts WINDOW w AS (PARTITION BY t)
    """,
    # All anchors against all rows.
    "op13_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ),
        positives AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, p.other_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) QUALIFY rank <= 5
    """,
}
