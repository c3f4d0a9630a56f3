"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperline.llm import decontam, divergence, htmltext, language, linededup, lmscore, packing, quality, resample, substring, suffix, superminhash, tokenbin


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(_table(spark, sf_dir, "documents"), lone=True)
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"), "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_stream(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2)


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return lmscore.cross_entropy_difference(_table(spark, sf_dir, "documents"), target)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_superminhash": op2_superminhash,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_decontamination": op5_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_cross_entropy": op10_cross_entropy,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_language_id": op12_language_id,
    "op13_source_divergence": op13_source_divergence,
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {
    "op8_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), k AS (
            SELECT doc_id, pos, line, translate(trim(line, {_BLANK}), {_UP}, {_LOW}) AS key FROM l
        ), g AS (
            SELECT key, max(doc_id) AS winner FROM k WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), f AS (
            SELECT k.doc_id, k.pos, k.line, (g.key IS NOT NULL AND k.doc_id <> g.winner) AS gone
            FROM k LEFT JOIN g ON k.key = g.key
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op11_importance_resampling": rf"""
        WITH RECURSIVE bits AS (
            SELECT CAST(range AS UBIGINT) AS byte, CAST(range AS UBIGINT) AS crc, 0 AS step FROM range(256)
            UNION ALL
            SELECT byte, CASE WHEN crc % 2 = 1 THEN xor(crc >> 1, CAST(3988292384 AS UBIGINT)) ELSE crc >> 1 END, step + 1 FROM bits WHERE step < 8
        ), one AS (SELECT byte, crc FROM bits WHERE step = 8),
        w AS (
            SELECT src, id, row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (
                SELECT src, id, row, regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM (
                    SELECT 0 AS src, doc_id AS id, row_number() OVER () AS row, text FROM documents
                    UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark))
        ), runs AS (
            SELECT src, row, unnest([word, word || ' ' || lead(word) OVER o, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o]) AS feature
            FROM w WINDOW o AS (PARTITION BY src, row ORDER BY pos)
        ), f AS (SELECT src, row, feature FROM runs WHERE feature IS NOT NULL),
        d AS (SELECT feature, hex(encode(feature)) AS h FROM f GROUP BY feature),
        b AS (
            SELECT feature, length(h) // 2 - i AS far, CAST(('0x' || substr(h, 2 * i - 1, 2)) AS UBIGINT) AS byte
            FROM d, unnest(range(1, length(h) // 2 + 1)) AS u(i)
        ), far AS (
            SELECT 0 AS far, byte, crc FROM one
            UNION ALL
            SELECT far.far + 1, far.byte, xor(far.crc >> 8, one.crc) FROM far JOIN one ON one.byte = far.crc % 256 WHERE far.far < (SELECT max(far) + 4 FROM b)
        ), started AS (
            SELECT feature, far, byte FROM b
            UNION ALL SELECT feature, length(h) // 2 - 1 - k, 255 FROM d, unnest(range(4)) AS u(k) WHERE k < length(h) // 2
        ), tails AS (
            SELECT feature, bit_xor(crc) AS x, any_value(length(h) // 2) AS n FROM started JOIN far USING (far, byte) JOIN d USING (feature) GROUP BY feature
        ), hashed AS (
            SELECT feature, xor(xor(x, CASE WHEN n = 1 THEN 16777215 WHEN n = 2 THEN 65535 WHEN n = 3 THEN 255 ELSE 0 END), 4294967295) % 10000 AS bucket FROM tails
        ), n AS (
            SELECT bucket, count(*) FILTER (WHERE src = 0) AS s, count(*) FILTER (WHERE src = 1) AS t FROM f JOIN hashed USING (feature) GROUP BY bucket
        ), total AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM n),
        gains AS (
            SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS gain FROM n, total
        ), weighed AS (
            SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE src = 0 GROUP BY row
        ), sized AS (SELECT row, count(*) AS n_words FROM w WHERE src = 0 GROUP BY row),
        own AS (SELECT doc_id, row_number() OVER () AS row FROM documents),
        scored AS (
            SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM own LEFT JOIN weighed USING (row) LEFT JOIN sized USING (row)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed""",
    "op13_source_divergence": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), o AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT lang, source, coalesce(any_value(t.total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t USING (lang, source) GROUP BY lang, source),
        l AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total::HUGEINT + 5 * v.v) AS p
            FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, 0 AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            UNION ALL
            SELECT a.lang, a.source, b.source, abs(a.p - b.p) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        ), terms AS (
            SELECT p.lang, p.source, p.term AS item, p.p - (1 + (1000000000::HUGEINT * (l.n + 5)::HUGEINT) // (l.total::HUGEINT + 5 * v.v)) AS value
            FROM p JOIN l ON l.lang = p.lang AND l.term = p.term JOIN v ON v.lang = p.lang WHERE p.n > 0
        ), every AS (
            SELECT lang, source, 'pair' AS part, item, CAST(sum(value) AS BIGINT) AS value FROM pairs GROUP BY lang, source, item
            UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM terms WHERE value > 0
        )
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM every QUALIFY part = 'pair' OR rank <= 50""",
}
