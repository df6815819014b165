"""The registered queries of this package over the test tables, and their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import language_id
from .exact_dedup import exact_dedup
from .html_extraction import extract_text
from .line_dedup import dedup_lines
from .lm_scoring import score_documents
from .mixing import fair_queue
from .packing import pack_documents
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeats
from .topk_search import top_k


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fm_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_deleted_interpolation(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op3_content_sort_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_curve_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out()
    model = language_id.train(docs, ~held)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_balltree_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_simhash_bktree(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_fair_mixing(spark, sf_dir):
    return fair_queue(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_differencing(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_fm_substring_dedup, op2_deleted_interpolation, op3_content_sort_dedup, op4_line_dedup, op5_curve_packing, op6_language_id, op7_balltree_topk, op8_simhash_bktree, op9_fair_mixing, op10_url_differencing)}

WORD = r"[^\x20\x09-\x0D]+"
SQL = {
    "op7_balltree_topk": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p)
        SELECT * FROM r WHERE rank <= 20""",
    "op3_content_sort_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (t)""",
    "op4_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, f.last IS NOT NULL AND f.last <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op9_fair_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS spot FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
        x AS (SELECT *, most / weight AS dry_at, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM w),
        y AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY dry_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY dry_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM x),
        z AS (SELECT *, least(most, coalesce((SELECT arg_min(t, dry_at) FROM y WHERE t <= dry_at) * weight, most))::DOUBLE AS target FROM y),
        q AS (SELECT d.*, z.source_size, z.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.spot, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source)
        SELECT doc_id, size, source_size, target, (greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - start - source_size)))::BIGINT AS taken FROM q""",
}
