"""The operators as registered queries over the whole tables, beside the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import leaks
from .dialogue import repair_conversations
from .html import extract_pages
from .licenses import CANONICAL, KNOWN, license_scan
from .packing import pack_documents
from .phrases import without_later
from .quality import quality_rules
from .runs import periodic_runs
from .scoring import score
from .simhash import simhash_groups
from .suffixes import without_repeats
from .toxicity import toxicity
from .urls import BLOCKED_WORDS, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(function):
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), width=3, radius=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_quality_rules", sql=r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
l2 AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
    FROM w LEFT JOIN r USING (rid) LEFT JOIN l2 USING (rid)),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (10 * n_upper > 4 * n_letters)::BIGINT
    + 32 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_HOST_SQL = r"CASE WHEN url LIKE '%://%' THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*') ELSE '' END"
_LOW_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op5_url_filters", sql=rf"""
WITH p AS (SELECT page_id, url, {_HOST_SQL} AS h FROM pages),
q AS (SELECT page_id, {_LOW_SQL.format('h')} AS host, CASE WHEN url LIKE '%://%' THEN regexp_extract(url[strpos(url, '://') + 3 + length(h):], '^[^?#]*') ELSE '' END AS path FROM p),
rules AS (SELECT unnest(['block', 'allow', 'block', 'allow']) AS verdict, unnest(['net/', 'example.net/en/', 'example.com/de/', 'org/fr/']) AS rule),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM q, rules
    WHERE ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, rule[strpos(rule, '/'):]) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), [{', '.join(f"'{w}'" for w in BLOCKED_WORDS)}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN f USING (page_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _canonical_sql(line: str) -> str:
    line = f"lower({line})"
    for pattern, by in CANONICAL:
        pattern = pattern.replace("(?>", "(?:")  # RE2 has no such groups and needs none
        line = f"regexp_replace({line}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"trim({line})"


def _lines_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split(replace(coalesce({text}, ''), chr(13), chr(10)), chr(10)), lambda x: {_canonical_sql('x')}), lambda x: x <> '')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)


@query("op7_license_scans", sql=rf"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256(array_to_string({_lines_sql('text')}, ' ')) AS digest FROM (VALUES {_KNOWN_SQL}) k(license, text)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_lines_sql('text')} AS lines FROM documents),
w AS (SELECT rid, doc_id, sha256(array_to_string(lines, ' ')) AS text_digest FROM d),
l AS (SELECT rid, license FROM (SELECT rid, sha256(unnest(lines)) AS digest FROM d) JOIN known USING (digest)),
g AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS found FROM l GROUP BY rid)
SELECT doc_id, text_digest, license, coalesce(n, 0) AS n_license_lines, coalesce(found, '') AS line_licenses
FROM w LEFT JOIN known ON digest = text_digest LEFT JOIN g USING (rid)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_later(table(spark, sf_dir, "documents"))


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), order=3)


@query("op11_periodic_run_detection")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), seed=F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_conversation_structure_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return repair_conversations(table(spark, sf_dir, "conversations"), damage=F.crc32(key.cast("binary")) % 20)
