"""All queries of this subpackage with their SQL."""

from __future__ import annotations

from . import queries_decontamination, queries_fim, queries_jaccard_join, queries_packing, queries_pii, queries_quality_classifier, queries_quality_rules, queries_secrets_scan, queries_sharding, queries_toxicity, queries_url_filter, queries_warc, queries_whitening

MODULES = [queries_decontamination, queries_warc, queries_url_filter, queries_quality_classifier, queries_pii, queries_secrets_scan, queries_jaccard_join, queries_quality_rules, queries_packing, queries_toxicity, queries_whitening, queries_fim, queries_sharding]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
