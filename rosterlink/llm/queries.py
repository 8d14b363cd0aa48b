"""The registered queries of the corpus operators and, where SQL can express them, their SQL.

Each applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink.llm import language, lblm, merkle, minmax, mixing, packing, passages, pii, quality, resampling, simple8b, topk, whitening
from rosterlink.llm.text import documents, prepared


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 and so on, 150 % of all words."""
    mixed = mixing.mix(documents(prepared(spark), sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.personal_data(documents(prepared(spark), sf_dir))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as Simple-8b and read back."""
    return simple8b.read(spark, simple8b.write(documents(prepared(spark), sf_dir)))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents."""
    return minmax.near_duplicates(documents(prepared(spark), sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut and packed into sequences of 2048 tokens."""
    return packing.pack(documents(prepared(spark), sf_dir))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    return topk.top_k(prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by rules that vote."""
    judged = quality.judge(documents(prepared(spark), sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return language.identified(documents(prepared(spark), sf_dir))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-bilinear scores of every text."""
    return lblm.scores(documents(prepared(spark), sf_dir))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents."""
    return passages.repeated_passages(documents(prepared(spark), sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle trees of every text, of its edited text and their likeness."""
    return merkle.fingerprints(documents(prepared(spark), sf_dir))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words."""
    docs = documents(prepared(spark), sf_dir)
    return resampling.resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 whitened components of every vector."""
    return whitening.whitened(prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_pii, op3_token_ids, op4_near_duplicates, op5_packing, op6_topk, op7_quality, op8_language, op9_lm_scores,
        op10_passages, op11_merkle, op12_resampling, op13_whitening, pipeline,
    )
}

ORACLES = {
    "op1_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '') || ':' || sha256(coalesce(text, ''))) AS name
            FROM documents
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, source, name) AS number FROM d
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight FROM d GROUP BY source
        ), turns AS (
            SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS turn FROM sources
        ), levels AS (
            SELECT turn, (1.5::DOUBLE * (SELECT sum(source_size) FROM turns) - coalesce(sum(most) OVER before, 0))
                / ((SELECT sum(weight) FROM turns) - coalesce(sum(weight) OVER before, 0)) AS level
            FROM turns WINDOW before AS (ORDER BY turn, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), plan AS (
            SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, turn) FROM levels WHERE level < turn) * weight, most)) AS target FROM turns
        ), drawn AS (
            SELECT n.doc_id, n.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
                list_reduce(list_transform(range(13), lambda i: CAST(strpos('0123456789abcdef', substr(sha256('7:' || n.name || ':' || n.number), CAST(i + 1 AS BIGINT), 1)) - 1 AS BIGINT)),
                    lambda a, b: a * 16 + b) / 4503599627370496::DOUBLE AS draw
            FROM numbered n JOIN plan p ON n.source IS NOT DISTINCT FROM p.source
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
            CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM drawn
    """,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.ints AS DOUBLE[]), CAST(v.ints AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_merkle": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS place FROM documents
        ), beside AS (
            SELECT *, coalesce(lead(text) OVER (ORDER BY place), first_value(text) OVER (ORDER BY place)) AS following FROM d
        ), halves AS (
            SELECT *, CAST(length(text) AS BIGINT) AS n_chars,
                left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS edited
            FROM beside
        ), trees AS (
            SELECT place, which, list_transform(string_split(t, chr(10) || chr(10)), lambda s:
                list_transform(string_split(s, chr(10)), lambda p: regexp_extract_all(p, '{merkle.PATTERN}'))) AS tree
            FROM (SELECT place, 'own' AS which, text AS t FROM halves UNION ALL SELECT place, 'edited', edited FROM halves)
        ), hashed AS (
            SELECT place, which, list_transform(tree, lambda s: list_transform(s, lambda p: struct_pack(
                digest := sha256(array_to_string(list_transform(p, lambda x: sha256(x)), '')),
                shown := array_to_string(list_transform(p, lambda x: left(sha256(x), 8) || '.' || length(x)), ',')))) AS tree
            FROM trees
        ), sections AS (
            SELECT place, which, list_transform(tree, lambda s: struct_pack(
                digest := sha256(array_to_string(list_transform(s, lambda p: p.digest), '')),
                shown := array_to_string(list_transform(s, lambda p: left(p.digest, 16) || ':' || p.shown), ';'))) AS tree
            FROM hashed
        ), prints AS (
            SELECT place, which, sha256(array_to_string(list_transform(tree, lambda s: s.digest), '')) || '|'
                || array_to_string(list_transform(tree, lambda s: left(s.digest, 16) || '(' || s.shown || ')'), '|') AS tree
            FROM sections
        ), pieces AS (
            SELECT place, which, piece, count(*) AS n, CAST(split_part(piece, '.', 2) AS BIGINT) AS size
            FROM (SELECT place, which, unnest(regexp_extract_all(tree, '[0-9a-f]{{8}}\.[0-9]+')) AS piece FROM prints) GROUP BY ALL
        ), sizes AS (
            SELECT place, which, sum(n * size) AS size FROM pieces GROUP BY ALL
        ), pairs AS (
            SELECT place, 'edited' AS which, place AS other FROM d
            UNION ALL SELECT place, 'own', coalesce(lead(place) OVER (ORDER BY place), 1) FROM d
        ), common AS (
            SELECT p.place, p.which, sum(least(a.n, b.n) * a.size) AS size FROM pairs p
            JOIN pieces a ON a.place = p.place AND a.which = 'own'
            JOIN pieces b ON b.place = p.other AND b.which = p.which AND b.piece = a.piece GROUP BY ALL
        ), near AS (
            SELECT p.place, p.which, CASE WHEN split_part(x.tree, '|', 1) = split_part(y.tree, '|', 1) THEN 1.0
                ELSE coalesce(2 * c.size / (coalesce(s.size, 0) + coalesce(t.size, 0))::DOUBLE, 0) END AS near
            FROM pairs p JOIN prints x ON x.place = p.place AND x.which = 'own' JOIN prints y ON y.place = p.other AND y.which = p.which
            LEFT JOIN sizes s ON s.place = p.place AND s.which = 'own' LEFT JOIN sizes t ON t.place = p.other AND t.which = p.which
            LEFT JOIN common c ON c.place = p.place AND c.which = p.which
        )
        SELECT b.doc_id, b.n_chars, sha256(b.edited) AS edited_sha256, o.tree AS fingerprint, e.tree AS edited_fingerprint,
            CAST(m.near AS DOUBLE) AS near_edited, CAST(n.near AS DOUBLE) AS near_next
        FROM halves b JOIN prints o ON o.place = b.place AND o.which = 'own' JOIN prints e ON e.place = b.place AND e.which = 'edited'
        JOIN near m ON m.place = b.place AND m.which = 'edited' JOIN near n ON n.place = b.place AND n.which = 'own'
    """,
    "op12_resampling": r"""
        WITH RECURSIVE crc_steps AS (
            SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
            UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
        ), crc_table AS (
            SELECT list(c ORDER BY byte) AS t FROM crc_steps WHERE k = 8
        ), words AS (
            SELECT 'd' AS origin, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
            UNION ALL
            SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
        ), counted AS (
            SELECT origin, doc_id, word, count(*) AS n FROM words GROUP BY ALL
        ), coded AS (
            SELECT word, list_transform(range(CAST(length(hex(word)) // 2 AS BIGINT)), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(hex(word), CAST(2 * i + 1 AS BIGINT), 1)) - 1)
                + strpos('0123456789ABCDEF', substr(hex(word), CAST(2 * i + 2 AS BIGINT), 1)) - 1 AS BIGINT)) AS bytes
            FROM (SELECT DISTINCT word FROM words)
        ), features AS (
            SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
            FROM coded, crc_table
        ), counts AS (
            SELECT bucket, coalesce(sum(n) FILTER (origin = 'd'), 0) AS s, coalesce(sum(n) FILTER (origin = 'b'), 0) AS t FROM counted JOIN features USING (word) GROUP BY bucket
        ), totals AS (
            SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM counts
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, totals
        ), weighed AS (
            SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN features USING (word) JOIN gains USING (bucket) WHERE origin = 'd' GROUP BY doc_id
        ), noisy AS (
            SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                list_reduce(list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), CAST(i + 1 AS BIGINT), 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b) AS h
            FROM documents LEFT JOIN weighed USING (doc_id)
        ), scored AS (
            SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM noisy
        ), placed AS (
            SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, s.n_features, s.weight, s.score,
            CASE WHEN place <= (SELECT count(*) FROM placed) * 10 // 100 THEN CAST(place AS BIGINT) END AS rank
        FROM scored s LEFT JOIN placed USING (doc_id)
    """,
}
