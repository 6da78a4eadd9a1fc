"""Query of the WARC operator: all pages are written as an archive, which is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .common import scratch, table


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, "urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")
    return warc.read(spark, path).where("entry = 'record'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def _sql() -> str:
    digits = " || ".join(f"substr('{warc.BASE32}', ((v{k} >> {35 - 5 * j}) & 31)::INT + 1, 1)" for k in range(4) for j in range(8))
    parts = ", ".join(f"('0x' || substr(sha1(h), {1 + 10 * k}, 10))::BIGINT AS v{k}" for k in range(4))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top, {parts} FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {digits} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d"""


QUERIES = {"op2_warc": op2_warc}
ORACLE = {"op2_warc": _sql()}
