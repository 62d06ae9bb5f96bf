"""The query of each operator over its whole table, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab.llm import (
    alignment, decontaminate, line_dedup, mixing, packing, quality_llr, quotes, simhash, substring_dedup, toxicity, vector_codes,
    warc, weak_quality,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_B32 = " || ".join(
    f"substr('{warc._ALPHABET}', ((('0x' || substr(h, {i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)"
    for i in range(0, 40, 5) for s in (15, 10, 5, 0))


@query("op2_warc", f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
         f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
    SELECT page_id, payload_bytes, {_B32} AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM p JOIN f USING (h)""")
def op2(spark, sf_dir):
    return warc.page_round_trip(table(spark, sf_dir, "pages"))


@query("op3_quotes")
def op3(spark, sf_dir):
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


@query("op4_packing")
def op4(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), encode_special_tokens=False)


@query("op5_line_dedup")
def op5(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_weak_quality")
def op6(spark, sf_dir):
    return weak_quality.weak_quality(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7(spark, sf_dir):
    return decontaminate.contamination_and_near(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_simhash")
def op8(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup")
def op9(spark, sf_dir):
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_quality_llr")
def op10(spark, sf_dir):
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@query("op11_mixing", r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k
        FROM documents),
    s AS (
        SELECT source, sum(size)::HUGEINT AS n,
               [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w
        FROM d GROUP BY source),
    f AS (  -- full: all sources together, filled to this one's level, hold no more than the mix
        SELECT a.source, a.n, a.w, 2 * sum(least(2 * b.n * a.w, 2 * a.n * b.w)) <= 3 * sum(b.n) * a.w AS is_full
        FROM s a CROSS JOIN s b GROUP BY a.source, a.n, a.w),
    t AS (
        SELECT source, n, CASE WHEN is_full THEN 4 * n ELSE w * (3 * sum(n) OVER () - 4 * coalesce(sum(n) FILTER (is_full) OVER (), 0)) END AS up,
               CASE WHEN is_full THEN 2 ELSE 2 * sum(w) FILTER (NOT is_full) OVER () END AS down
        FROM f),
    r AS (
        SELECT doc_id, size, n, up, down, up // down AS budget,
               coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, n::BIGINT AS source_size, up::DOUBLE / down::DOUBLE AS target,
           CASE WHEN n = 0 THEN 0 ELSE (budget // n) * size + greatest(0, least(size, budget % n - earlier)) END::BIGINT AS taken
    FROM r""")
def op11(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every round spelled out, every part compared with every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    a{r} AS MATERIALIZED (
        SELECT rn, part, any_value(x) AS x, min((list_inner_product(x, x) - 2 * list_inner_product(x, y)
               + list_inner_product(y, y))::HUGEINT * {entries} + e) AS k
        FROM p JOIN b{r} USING (part) GROUP BY rn, part)""")
        if r < rounds:
            steps.append(f"""
    m{r} AS (
        SELECT part, e, list(mean ORDER BY i) AS mean FROM (
            SELECT part, k % {entries} AS e, i, floor(sum(x[i]) / count(*)) AS mean
            FROM (SELECT part, k, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL)
        GROUP BY ALL),
    b{r + 1} AS MATERIALIZED (
        SELECT part, e, coalesce(mean, y) AS y FROM b{r} LEFT JOIN m{r} USING (part, e))""")
    return f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS rn, vec_id, label,
               list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)) AS c
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (
        SELECT rn, vec_id, part, c[part * (len(c) // {parts}) + 1:(part + 1) * (len(c) // {parts})] AS x
        FROM v CROSS JOIN range({parts}) t(part)),
    b0 AS MATERIALIZED (
        SELECT part, x AS y, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST) - 1 AS e FROM p
        QUALIFY e < {entries}),{",".join(steps)},
    o AS (
        SELECT rn, string_agg(printf('%02x', (k % {entries})::INT), '' ORDER BY part) AS code,
               sum(k // {entries})::BIGINT AS error
        FROM a{rounds} GROUP BY rn)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(w::BIGINT, ',' ORDER BY part, e, i))
            FROM (SELECT part, e, unnest(y) AS w, unnest(range(len(y))) AS i FROM b{rounds})) AS codebooks_sha256
    FROM o JOIN v USING (rn)"""


@query("op12_vector_codes", _codes_sql())
def op12(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_alignment")
def op13(spark, sf_dir):
    return alignment.align(
        table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
