"""Query of the URL filter.  A page's outcome is the label of its id: bad if of low quality or toxic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .url_filter import DEVIATIONS, LEAST_WEIGHT, LIMIT, MOST_WEIGHT, SUFFIXES, Rule, judged

RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judged(table(spark, sf_dir, "pages"), outcomes, RULES).drop("bound")


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered) + f" WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END"
    long = "(" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"
    weight = lambda t: f"(SELECT CASE WHEN k < 2 OR n = k OR rho IS NULL OR rho <= 1.0 / ({MOST_WEIGHT} + 1) THEN {MOST_WEIGHT} ELSE greatest({LEAST_WEIGHT}::DOUBLE, 1 / rho - 1) END FROM (SELECT k, n, CASE WHEN n - squares / n - (k - 1) > 0 THEN (spread - (k - 1)) / (n - squares / n - (k - 1)) ELSE 0 END AS rho FROM (SELECT sum(n * pow(bad / n - parent, 2) / (parent * (1 - parent))) AS spread, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS squares, count(*) AS k FROM {t} WHERE n > 0 AND parent > 0 AND parent < 1)))"
    drawn = lambda t: f"SELECT *, {weight(t)} AS weight, (bad + {weight(t)} * parent) / (n + {weight(t)}) AS rate FROM {t}"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM u),
two AS (SELECT *, array_to_string(l[-2:], '.') AS last2 FROM b),
p AS (SELECT page_id, host, path, CASE WHEN last2 IN {long} THEN array_to_string(l[-3:], '.') ELSE last2 END AS domain, CASE WHEN last2 IN {long} THEN last2 ELSE l[-1] END AS suffix FROM two),
o AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad FROM p LEFT JOIN o ON p.page_id = o.page_id GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.1 END FROM h) AS parent FROM h GROUP BY suffix), s AS ({drawn("s0")}),
d0 AS (SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, max(s.rate) AS parent FROM h JOIN s ON h.suffix = s.suffix GROUP BY h.domain, h.suffix), d AS ({drawn("d0")}),
h0 AS (SELECT h.host, h.n, h.bad, d.rate AS parent FROM h JOIN d ON h.domain = d.domain AND h.suffix = d.suffix), hh AS ({drawn("h0")}),
r AS (SELECT host, rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (n + weight + 1)) AS bound FROM hh)
SELECT page_id, p.host AS host, path, {rule.replace("host", "p.host")} AS rule, {verdict.replace("host", "p.host")} AS verdict FROM p LEFT JOIN r ON p.host = r.host"""


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLE = {"op3_url_filter": _sql()}
