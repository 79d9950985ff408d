"""Every registered query of the engine and its SQL, by family. Each applies an operator to whole tables of the driver's data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairoscope.queries import analytics, edges, files, graphs, questions, studies, texts

FAMILIES = (edges, graphs, analytics, texts, questions, files, studies)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLE = {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each relation: edges, temporal coverage, mean credibility and the five best edges."""
    return edges.summary(spark, sf_dir)
