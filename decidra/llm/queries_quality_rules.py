"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality_rules import FENCES, LEAST_TEXTS, PERCENTS, judged

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(COLUMNS)


def _sql() -> str:
    spaces = "[\\x20\\x09-\\x0D]"
    bucket = lambda v: f"CASE WHEN {v} < 64 THEN {v} ELSE (length(bin({v})) - 6) * 64 + ({v} >> (length(bin({v})) - 6)) END"
    long = " UNION ALL ".join(f"SELECT lang, source, '{f.name}' AS measure, {bucket(f.name)} AS bucket FROM m" for f in FENCES)
    value = "CASE WHEN bucket < 64 THEN bucket ELSE (bucket % 64) << (bucket // 64) END"

    def quart(name: str, by: str) -> str:
        keys = f"{by}, measure" if by else "measure"
        at = ", ".join(f"min({value}) FILTER (100 * upto >= {p} * total) AS q{p}" for p in PERCENTS)
        return f"{name}_c AS (SELECT {keys}, bucket, sum(count(*)) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(count(*)) OVER (PARTITION BY {keys}) AS total FROM long GROUP BY {keys}, bucket), {name} AS (SELECT {keys}, max(total) AS n, {at} FROM {name}_c GROUP BY {keys})"

    pick = lambda c: f"CASE WHEN s.n >= {LEAST_TEXTS} THEN s.{c} WHEN l.n >= {LEAST_TEXTS} THEN l.{c} ELSE w.{c} END"
    bounds = ", ".join(f"max(CASE WHEN measure = '{f.name}' THEN q{100 - f.tail} - {f.times} * greatest(q50 - q{100 - f.tail}, {f.least}) END) AS {f.name}_low, max(CASE WHEN measure = '{f.name}' THEN q{f.tail} + {f.times} * greatest(q{f.tail} - q50, {f.least}) END) AS {f.name}_high" for f in FENCES)
    picked = ", ".join(f"{pick(f'q{p}')} AS q{p}" for p in PERCENTS)
    inside = " AND ".join(x for f in FENCES for x in ([f"{f.name} >= {f.name}_low"] if f.low else []) + ([f"{f.name} <= {f.name}_high"] if f.high else []))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, [x for x in string_split_regex(text, '{spaces}+') if x <> ''] AS words, [x for x in string_split(text, chr(10)) if regexp_replace(x, '{spaces}+', '', 'g') <> ''] AS lines FROM d),
g AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM t)),
dup AS (SELECT rid, s FROM g GROUP BY rid, s HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT rid, i, unnest(range(5)) AS k FROM g JOIN dup USING (rid, s)) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '{spaces}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, len(lines) AS n_lines FROM t LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines, CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END AS capitals FROM c),
long AS ({long}),
{quart("s", "lang, source")}, {quart("l", "lang")}, {quart("w", "")},
f AS (SELECT lang, source, {bounds} FROM (SELECT s.lang, s.source, s.measure, {picked} FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.measure = l.measure JOIN w ON s.measure = w.measure) GROUP BY lang, source)
SELECT m.doc_id, m.n_words::BIGINT AS n_words, m.word_chars::BIGINT AS word_chars, m.n_symbols::BIGINT AS n_symbols, m.n_dup_lines::BIGINT AS n_dup_lines, m.n_repeat_words::BIGINT AS n_repeat_words, m.base_failed, NOT m.base_failed AND ({inside}) AS kept
FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE = {"op8_quality_rules": _sql()}
