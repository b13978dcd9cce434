"""The corpus operators as registered queries: each reads its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlytics.llm import byte_bpe, centroids, corpus_sql, exact_dedup, jaccard_join, kd_search, licences, lm_score, merkle, mixing, packing, pii, toxicity, warc
from convlytics.llm.ranks import met

#: The key of the registered queries; a real run passes its own secret.
PSEUDONYM_KEY = "convlytics-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.backoff_scores(_table(spark, sf_dir, "documents"))
    # Sums of floats depend on their order in the last digits.
    return scores.select("doc_id", "n_words", *[F.round(c, 4).alias(c) for c in ("log_score", "mean_log_score")])


def op1_lm_score_order5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores with n-grams of up to five words; `op1_lm_score` and its SQL have three."""
    scores = lm_score.backoff_scores(_table(spark, sf_dir, "documents"), order=5)
    return scores.select("doc_id", "n_words", *[F.round(c, 4).alias(c) for c in ("log_score", "mean_log_score")])


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_matches(_table(spark, sf_dir, "documents"))


def op2_licence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices and whole licences anywhere in a text, also wrapped or inside a longer line."""
    return licences.licence_passages(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its personal values replaced: ``doc_id, text, n_replaced``."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_texts(_table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archived(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added_tokens=True)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trips(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows; a fifth of the rows claims a text in lower case, which its proof must refuse."""
    docs = _table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    checked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(checked, merkle.leaf_of(*(lowered if c == "text" else F.col(c) for c in merkle.COLUMNS)))
    proofs = merkle.manifest(docs, also={"claimed": claimed})
    digests = proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.coalesce("claimed", "leaf"), F.col("proof")).alias("folded_root"))
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, quotas = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"))
    rows = taken.withColumn("source", F.col("sources")[0])
    return met(rows, quotas, ["source"]).select("doc_id", "size", "source_size", "target", "taken")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, found = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    digests = centroids.per_cluster([centroids.digest(c) for c in found] or [""])
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digests.alias("centroid_sha256"))


QUERIES = {fn.__name__: fn for fn in (op1_lm_score, op1_lm_score_order5, op2_licences, op2_licence_passages, op3_pii, op4_exact_dedup, op5_jaccard_join, op6_warc, op7_toxicity, op8_kd_search, op9_packing, op10_byte_bpe, op11_merkle, op12_mixing, op13_centroids)}


def _licence_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, licences.bigrams(licences.normal_words(text))))}])" for name, text in licences.TEMPLATES.items())
    return rf"""
        WITH templates(licence, known) AS (VALUES {known}), units AS (
            SELECT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS unit
            FROM documents
        ), words AS (
            SELECT doc_id, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:[.\-][a-z0-9]+)*') AS w
            FROM units WHERE length(unit) > 2
        ), grams AS (
            SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM words WHERE len(w) > 1
        ), pairs AS (
            SELECT doc_id, licence, len(list_intersect(g, known)) AS shared, len(g) + len(known) AS united
            FROM grams JOIN templates ON len(g) * 3 >= len(known) * 2 AND len(g) * 2 <= len(known) * 3
        )
        SELECT doc_id, licence, arg_max(shared, shared / united - united * 1e-9) AS shared, arg_max(united, shared / united - united * 1e-9) AS united, count(*) AS units
        FROM pairs WHERE shared * 200 >= united * {licences.PERCENT} GROUP BY doc_id, licence
    """


_WORDS = r"""
    words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    )"""

ORACLES: dict[str, str] = {
    "op1_lm_score": rf"""
        WITH {_WORDS}, places AS (
            SELECT doc_id, unnest(w) AS z, unnest(range(1, len(w) + 1)) AS i FROM words
        ), threes AS (
            SELECT doc_id, z, lag(z) OVER (PARTITION BY doc_id ORDER BY i) AS y, lag(z, 2) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM places
        ), own_one AS (SELECT doc_id, z, count(*) AS n FROM threes GROUP BY ALL),
        own_two AS (SELECT doc_id, y, z, count(*) AS n FROM threes WHERE y IS NOT NULL GROUP BY ALL),
        own_three AS (SELECT doc_id, x, y, z, count(*) AS n FROM threes GROUP BY ALL),
        one AS (SELECT *, sum(n) OVER (PARTITION BY z) - n AS others_hold FROM own_one),
        two AS (SELECT *, sum(n) OVER (PARTITION BY y, z) - n AS others_hold FROM own_two),
        three AS (SELECT *, sum(n) OVER (PARTITION BY x, y, z) - n AS others_hold FROM own_three),
        sized AS (SELECT doc_id, len(w) AS n_words, greatest((SELECT sum(len(w)) FROM words) - len(w), 1) AS others FROM words),
        scored AS (
            SELECT t.doc_id, t.n * CASE
                WHEN t.x IS NOT NULL AND t.others_hold > 0 THEN ln(t.others_hold / xy.others_hold)
                WHEN t.y IS NOT NULL AND yz.others_hold > 0 THEN ln(yz.others_hold / y1.others_hold) + CASE WHEN t.x IS NULL THEN 0 ELSE ln(0.4) END
                ELSE ln(greatest(z1.others_hold, 1) / others)
                    + ln(0.4) * (CASE WHEN t.y IS NULL THEN 0 WHEN t.x IS NULL THEN 1 ELSE 2 END + CASE WHEN z1.others_hold = 0 THEN 1 ELSE 0 END) END AS s
            FROM three t JOIN sized d ON d.doc_id = t.doc_id
                JOIN one z1 ON z1.doc_id = t.doc_id AND z1.z = t.z LEFT JOIN one y1 ON y1.doc_id = t.doc_id AND y1.z = t.y
                LEFT JOIN two yz ON yz.doc_id = t.doc_id AND yz.y = t.y AND yz.z = t.z LEFT JOIN two xy ON xy.doc_id = t.doc_id AND xy.y = t.x AND xy.z = t.y
        ), summed AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
        SELECT d.doc_id, n_words, round(coalesce(s, 0), 4) AS log_score, CASE WHEN n_words > 0 THEN round(s / n_words, 4) END AS mean_log_score
        FROM sized d LEFT JOIN summed u ON u.doc_id = d.doc_id
    """,
    "op5_jaccard_join": rf"""
        WITH RECURSIVE {_WORDS}, sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS g
            FROM words
        ), grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM sets UNION SELECT doc_id, b FROM reach JOIN links ON a = other
        )
        SELECT s.doc_id, len(g) AS n_shingles, least_id AS component_id
        FROM sets s JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
    """,
    "op6_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        firsts AS (SELECT h AS same, min(page_id) AS first FROM payloads WHERE strlen(h) >= 100 GROUP BY h)
        SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
            CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
        FROM payloads LEFT JOIN firsts ON same = h
    """,
    "op8_kd_search": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), places AS (SELECT vec_id, len(e) AS dim, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM whole),
        scores AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(sum(q.x * v.x) AS BIGINT) AS score
            FROM places q JOIN places v ON v.i = q.i AND v.dim = q.dim AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, v.vec_id
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op2_licences": _licence_sql(),
    "op4_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        ), ranked AS (
            SELECT doc_id, body,
                first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY body) AS group_size
            FROM normal
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM ranked
    """,
    "op11_merkle": corpus_sql.manifest_sql(),
    "op12_mixing": corpus_sql.mix_sql(),
    "op13_centroids": corpus_sql.clusters_sql(),
}
