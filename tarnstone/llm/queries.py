"""The queries of this subpackage: thin forms of the operators over the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, lang_id, mixing, oracles, packing, quality, runs, secrets, simhash, suffix_dedup, target_resampling, token_files, topk, url_reputation
from .common import clean, fresh_path, owned, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.choose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "kept")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages")).withColumns({c: F.round(c, 6) for c in ("block_rate", "bound")})


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.learn(docs.where(~lang_id.held_out(F.col("doc_id"))))
    return lang_id.predict(docs, model).select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"), damaged=True)


def _tidy(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """What a query wrote on its way goes, but for the tables that its result reads."""

    @functools.wraps(run)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        with owned() as paths:
            out = run(spark, sf_dir)
            clean(spark, paths, out)
        return out

    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    tidied = (op1_mixing, op2_quality, op3_secrets, op4_topk, op5_packing, op6_url_reputation, op7_lang_id, op8_exact_dedup, op10_simhash, op11_target_resampling, op12_suffix_dedup, op13_periodic_runs)
    return {f.__name__: _tidy(f) for f in tidied} | {"op9_token_files": op9_token_files}  # op9 reads files that Spark doesn't list


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                       WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
                 s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
                       FROM q JOIN v c ON c.vec_id <> q.vec_id)
            SELECT query_id, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
            FROM s QUALIFY rank <= 10""",
        "op3_secrets": oracles.op3_secrets(),
        "op11_target_resampling": oracles.op11_target_resampling(),
        "op12_suffix_dedup": oracles.op12_suffix_dedup(),
        "op13_periodic_runs": oracles.op13_periodic_runs(),
        "op6_url_reputation": oracles.op6_url_reputation(),
        "op8_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    }
