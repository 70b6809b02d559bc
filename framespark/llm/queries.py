"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embdedup, exact, filteraudit, langid, minhash, packing, phrases, quality, secrets, tokenfile, warc
from .storage import new_path, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER, end_id=2)
    read = tokenfile.with_crc32(tokenfile.read_token_files(spark, path))
    return read.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")


def op5_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.resolved_records(warc.read_warc(spark, path))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0, capacity=2048)


def _held_out() -> F.Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~_held_out()))
    return langid.predict(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    digests = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    decoded = bpe.decode(digests, RANKS)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(*filteraudit.document_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(phrases.count_phrases(table(spark, sf_dir, "documents"), least=100, longest=5), top=2000)
    return found.withColumnRenamed("part", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_adaptive_scan": op1_adaptive_scan,
    "op2_secret_forest": op2_secret_forest,
    "op3_superminhash": op3_superminhash,
    "op4_token_files": op4_token_files,
    "op5_pigeonhole_join": op5_pigeonhole_join,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_quotient_dedup": op11_quotient_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_collocations": op13_collocations,
}

#: The digests of op6 are those of the pages themselves. SQL has no tokenizer or model for the others, and op1 is
#: approximate: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_superminhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle
            FROM (SELECT *, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        links AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
            ) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)
        ), reach(doc_id, other) AS (
            SELECT a, a FROM links UNION SELECT links.b, other FROM reach JOIN links ON links.a = reach.doc_id
        ), c AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY 1)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op5_pigeonhole_join": """
        WITH RECURSIVE e AS (
            SELECT vec_id, "label", embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
            FROM embeddings WHERE embedding IS NOT NULL AND "label" IS NOT NULL
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x."label" = y."label" AND x.vec_id <> y.vec_id
            WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93
        ), reach(vec_id, other) AS (
            SELECT a, a FROM links UNION SELECT links.b, other FROM reach JOIN links ON links.a = reach.vec_id
        ), c AS (SELECT vec_id, min(other) AS component FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
    """,
    "op6_warc_revisits": """
        WITH p AS (
            SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes
            FROM pages
        ), q AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
        FROM q
    """,
    "op11_quotient_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_filter_audit": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS e
            FROM documents LEFT JOIN labels USING (doc_id)
        ), f AS (
            SELECT part, good, toxic, {
                'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
                'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': e
            } AS fails FROM d
        ), x AS (
            SELECT part, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic,
                   (CASE WHEN fails.A THEN 'A' ELSE '' END) || (CASE WHEN fails.B THEN 'B' ELSE '' END) || (CASE WHEN fails.C THEN 'C' ELSE '' END)
                   || (CASE WHEN fails.D THEN 'D' ELSE '' END) || (CASE WHEN fails.E THEN 'E' ELSE '' END) AS failed
            FROM f GROUP BY part, failed
        ), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), orders AS (
            SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM letter p, letter q, letter r, letter s, letter t
            WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5
        ), steps AS (
            SELECT filter_order, step, filter_order[1 : step - 1] AS before, filter_order[step] AS own
            FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)
        ), y AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (translate(failed, before || own, '') = failed), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (contains(failed, own) AND translate(failed, before, '') = failed), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (contains(failed, own) AND translate(failed, before, '') <> failed), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (contains(failed, own) AND translate(failed, before, '') = failed), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (contains(failed, own) AND translate(failed, before, '') = failed), 0)::BIGINT AS toxic_lost
            FROM x, steps GROUP BY ALL
        )
        SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y
    """,
    "op13_collocations": r"""
        WITH p AS (
            SELECT lang, row_number() OVER () AS piece_id, words FROM (
                SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
                FROM documents
            )
        ), f AS (
            SELECT lang, k, list_aggregate(words[i : i + k - 1], 'string_agg', ' ') AS phrase, count(*) AS n
            FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k))
            GROUP BY ALL
        ), total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY 1),
        c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2 AND n >= 100),
        free AS (
            SELECT * FROM c WHERE NOT EXISTS (
                SELECT 1 FROM c longer WHERE longer.lang = c.lang AND longer.k > c.k AND 100 * longer.a >= 100 * c.a AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ')
            )
        ), cuts AS (
            SELECT free.lang, free.phrase, free.a, cut, x.n AS l, y.n AS r, total.n AS n,
                   (1000::HUGEINT * free.a * total.n) // (x.n::HUGEINT * y.n) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM free) free
            JOIN f x ON x.lang = free.lang AND x.k = cut AND x.phrase = array_to_string(words[1 : cut], ' ')
            JOIN f y ON y.lang = free.lang AND y.k = free.k - cut AND y.phrase = array_to_string(words[cut + 1 :], ' ')
            JOIN total ON total.lang = free.lang
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
               r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM best QUALIFY rank <= 2000
    """,
}
