"""Registered queries of the analytics operators and their SQL.

A query is SQL that Catalyst plans; where Spark and DuckDB name a function differently the second text is DuckDB's. Names begin
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from basalt.operators import association, geometry, matching, records, shelves, stats, vectors
from basalt.plans import audit_sql, choice_sql, label_sql, rule_sql, shelf_sql
from basalt.sources import tables
from basalt.streaming import runs

FLAGSHIP = "a9_share_of_shelf"
TEXTS = shelf_sql.QUERIES | label_sql.QUERIES | choice_sql.QUERIES | audit_sql.QUERIES | rule_sql.QUERIES


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Plan text over the tables that it names. Names are bound while the text is analysed only: the caller's views of these names are put back."""
    names = [n for n in tables.NAMES if re.search(rf"\b{n}\b", text)]
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    held = {n: spark.table(n) for n in names if n in temporary}
    try:
        for n in names:
            tables.load(spark, sf_dir, n).createOrReplaceTempView(n)
        return spark.sql(text)
    finally:
        for n in names:
            spark.catalog.dropTempView(n)
        for n, view in held.items():
            view.createOrReplaceTempView(n)


MODULES = (association, geometry, matching, shelves, vectors, records, stats, runs)


def queries() -> dict:
    out = {name: (lambda spark, d, s=spark_text: run_sql(spark, d, s)) for name, (spark_text, _) in TEXTS.items()}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: oracle or spark_text for name, (spark_text, oracle) in TEXTS.items()}
    for module in MODULES:
        out |= module.ORACLES
    return out
