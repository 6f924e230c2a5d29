"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import tokenize
from .common import table
from .html import extract
from .language import predict_languages
from .lines import line_report
from .mixing import mix_sources
from .perplexity import classify
from .repetition import repetition_rules
from .simhash import simhash_components
from .topk import top_k
from .warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: Words of a text in DuckDB's SQL.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op8_top_k"] = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0), "
    "s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, cast(list_inner_product(q.w, c.w) AS bigint) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) "
    "SELECT query_id, cast(place AS int) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 20"
)
#: What SQL can say of op2, op9 and op10, as queries of their own.
ORACLES["archive_kinds"] = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT page_id, cast(strlen(html) AS bigint) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first FROM p) "
    "SELECT page_id, payload_bytes, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"
)
ORACLES["mix_sizes"] = f"WITH d AS (SELECT doc_id, source, cast(len({WORDS}) AS bigint) AS size FROM documents) SELECT doc_id, size, cast(sum(size) OVER (PARTITION BY source) AS bigint) AS source_size FROM d"
ORACLES["base_counts"] = (
    f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents), "
    "t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3), "
    "g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM t), "
    "x AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r), "
    "l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d), "
    r"y AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r) "
    "SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS bigint) AS word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, "
    "coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r)"
)


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return classify(table(spark, sf_dir, "documents"), trusted)


@query
def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep_ids=False)


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "times", "taken")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_spans_words", "longest_repeat")


@query
def archive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of op2_warc without digests."""
    return op2_warc(spark, sf_dir).drop("payload_digest")


@query
def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents and sources as op9_mix_sources counts them."""
    return op9_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size")


@query
def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_quality_rules counts before its method decides."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
