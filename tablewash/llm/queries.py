"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import mark_repeated_chunks
from .conversations import damage_and_repair
from .decontamination import find_contamination
from .divergence import source_divergence
from .extraction import extract_text, learn_weights
from .licenses import scan_licenses
from .lines import drop_repeated_lines
from .minhash import near_duplicates
from .pieces import encode_texts
from .quality import quality
from .suffix import remove_repeats
from .toxicity import score_toxicity, train
from .warc import archive_and_deduplicate

MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    """The path of the public model; looked up when it is used, so that no other query needs it."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_repeated`` counts the bytes in repeats of 272 bytes or more (50 words are about 310), removed or not."""
    out = remove_repeats(table(spark, sf_dir, "documents"), passage=272)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), "kept_sha256", "n_repeated")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_and_deduplicate(table(spark, sf_dir, "pages"))
    return out.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, learn_weights(pages))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it; clean documents have none."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), model or piece_model()).select(
        "doc_id", "n_pieces", "scores", F.get("digests", F.lit(0)).alias("ids_sha256"), "digests", "decoded_equal")


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeated_chunks(table(spark, sf_dir, "documents")).drop("spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_toxicity_scores": op3_toxicity_scores,
    "op4_main_text": op4_main_text,
    "op5_minhash_near_duplicates": op5_minhash_near_duplicates,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_sentence_pieces": op7_sentence_pieces,
    "op8_quality_outliers": op8_quality_outliers,
    "op9_chunk_dedup": op9_chunk_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_line_dedup": op13_line_dedup,
}

# White space at both ends of a line, as DuckDB's regular expressions spell it.
_ENDS = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PRICE = "1 + (CAST(1000000000 AS HUGEINT) * ({n} + 5)) // ({total} + 5 * v)"

ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
        w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
        l AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, any_value(total_lang) AS total_lang, coalesce(sum(n), 0) AS total
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_PRICE.format(n="coalesce(c.n, 0)", total="total")} AS p,
            {_PRICE.format(n="n_lang", total="total_lang")} AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM s WHERE part = 'pair' OR rank <= 50""",
    "op13_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, {_LOWER.format(f"regexp_replace(line, '{_ENDS}', '', 'g')")} AS key FROM l),
        r AS (SELECT key, max(doc_id) AS lead FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lead <> doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (lead IS NULL OR lead = doc_id), '')) AS kept_sha256
        FROM k LEFT JOIN r USING (key) GROUP BY doc_id""",
}
