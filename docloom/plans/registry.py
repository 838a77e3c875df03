"""All registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import asks, documents, drafts, inputs, intervals, json_docs, lookups, records, revisions, rules, syncs, texts, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = documents.QUERIES | records.QUERIES | texts.QUERIES | rules.QUERIES | versions.QUERIES | drafts.QUERIES | syncs.QUERIES | asks.QUERIES | intervals.QUERIES | inputs.QUERIES | lookups.QUERIES | revisions.QUERIES | json_docs.QUERIES
ORACLE_SQL: dict[str, str] = documents.ORACLE_SQL | records.ORACLE_SQL | texts.ORACLE_SQL | rules.ORACLE_SQL | versions.ORACLE_SQL | drafts.ORACLE_SQL | syncs.ORACLE_SQL | asks.ORACLE_SQL | intervals.ORACLE_SQL | inputs.ORACLE_SQL | lookups.ORACLE_SQL | revisions.ORACLE_SQL | json_docs.ORACLE_SQL
