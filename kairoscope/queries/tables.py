"""The driver's tables as the engine's records: line items are edges, parts carry gold ranges, customers are diseases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.model import look_up

RELATION = {"R": "indication", "A": "contraindication", "N": "disease_phenotype_positive"}
#: The same in SQL.
RELATION_SQL = "CASE l_returnflag WHEN 'R' THEN 'indication' WHEN 'A' THEN 'contraindication' ELSE 'disease_phenotype_positive' END"
AS_OF = "1998-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(flag: Column) -> Column:
    return look_up(RELATION, flag)


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw triples: everything is text, some of it junk."""
    li = table(spark, sf_dir, "lineitem")
    text = lambda c: c.cast("string")
    context = F.struct(
        F.when(F.col("l_linenumber") == 7, "unknown").otherwise(text(F.col("l_quantity") - 2)).alias("onset_age_min"), text(F.col("l_quantity") + 100 * F.col("l_tax") - 3).alias("onset_age_max"),
        F.col("l_linestatus").alias("progression_stage"), F.lit("").alias("duration"), F.lit(None).cast("string").alias("milestone"), F.lit("none").alias("temporal_qualifier"),
        F.lit(None).cast("string").alias("treatment_start_age"), text(F.year("l_shipdate")).alias("discovery_year"),
    )
    return li.select(
        text(F.col("l_partkey")).alias("subject"), F.lit("drug").alias("subject_type"), F.lit(None).cast("string").alias("subject_id"), relation(F.col("l_returnflag")).alias("relation"), text(F.col("l_suppkey")).alias("object"),
        F.lit("Disease").alias("object_type"), F.lit(None).cast("string").alias("object_id"), context.alias("temporal_context"),
        F.lit(None).cast("struct<age_group: string, genetic_subtype: string, disease_stage: string, population: string, treatment_line: string, sex: string, biological_context: string, cell_type: string, tissue_type: string, experimental_model: string, species: string>").alias("conditions"),
        F.lit("").alias("evidence_text"), F.concat(F.lit("PMID:"), text(F.col("l_orderkey"))).alias("source_id"), text(F.col("l_suppkey")).alias("extraction_model"), text(F.col("l_discount") * 10).alias("confidence"),
        text(F.col("l_partkey")).alias("disease_profile_id"), ord_().alias("ord"),
    )


#: WRAP is the last multiple of 100 in a long, LINE what one line counts in the number of a line item; WRAP is LINES of them and REST.
WRAP, LINE = 9_223_372_036_854_775_800, 510_000_000_000
LINES, REST = divmod(WRAP, LINE)


def ord_() -> Column:
    """A number for each line item: order and line alone aren't unique in these tables.

    It is ORD_SQL where that fits a long, and beyond (from order 1,808,504 on) ORD_SQL modulo WRAP, by steps that don't
    overflow. Two numbers are equal only if they are whole WRAPs apart; within a span of WRAP their order is ORD_SQL's, and
    remainders by divisors of 100 stay.
    """
    line = F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")
    rest = (F.col("l_partkey").cast("long") * 10_000 + F.col("l_suppkey")) * 51 + F.col("l_quantity").cast("long")
    fits = line.between(2 - LINES, LINES - 2) & rest.between(-2 * LINE, 2 * LINE)
    near = F.pmod(F.pmod(line, F.lit(LINES)) * LINE - WRAP + rest, F.lit(WRAP))
    taken = F.pmod(F.floor(line / LINES) * REST, F.lit(WRAP))  # LINES * LINE is -REST modulo WRAP
    return F.when(fits, line * LINE + rest).otherwise(F.pmod(near - taken, F.lit(WRAP)))


def place() -> Column:
    """ORD_SQL of any size, as a decimal: what line items are ordered by, where ord_() only tells them apart."""
    line = F.col("l_orderkey").cast("decimal(19,0)") * 10 + F.col("l_linenumber")
    return line * F.lit(LINE) + ((F.col("l_partkey").cast("long") * 10_000 + F.col("l_suppkey")) * 51 + F.col("l_quantity").cast("long"))


def edge_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))


#: The same in SQL, and the id of a line item's edge.
ORD_SQL = "(((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey) * 51 + l_quantity::BIGINT"
ID_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT)"


def edges(spark: SparkSession, sf_dir: str, number: Callable[[], Column] = ord_) -> DataFrame:
    """Line items as edges (with ord: ord_(), or place() where it orders edges)."""
    return as_edges(table(spark, sf_dir, "lineitem"), number)


def as_edges(li: DataFrame, number: Callable[[], Column] = ord_, *more: Column | str) -> DataFrame:
    date = F.col("l_shipdate").cast("date")
    none = lambda t: F.lit(None).cast(t)
    temporal = F.struct(
        date.alias("discovery_date"), none("date").alias("validity_start"), none("date").alias("validity_end"), none("string").alias("superseded_by"), F.lit("exact_date").alias("temporal_resolution"),
        F.col("l_quantity").alias("onset_age_min"), (F.col("l_quantity") + 100 * F.col("l_tax")).alias("onset_age_max"), F.when(F.col("l_linestatus") == "O", "open").alias("progression_stage"),
        none("string").alias("duration"), none("string").alias("milestone"), none("string").alias("temporal_qualifier"), none("double").alias("treatment_start_age"),
    )
    evidence = F.struct(
        F.lit(2).alias("tier"), F.array(F.col("l_orderkey").cast("string")).alias("source_ids"), F.col("l_discount").alias("credibility_score"), F.lit("other").alias("study_type"), (1 - F.col("l_tax")).alias("consensus_confidence"),
        F.array(F.col("l_suppkey").cast("string")).alias("extraction_models"), F.lit("table").alias("extraction_method"), none("int").alias("citation_count"), F.lit(False).alias("is_retracted"), F.lit("").alias("evidence_text"),
    )
    return li.select(
        edge_key().alias("edge_id"), F.col("l_partkey").cast("string").alias("source_id"), F.lit("drug").alias("source_type"), F.concat(F.lit("part "), "l_partkey").alias("source_name"),
        relation(F.col("l_returnflag")).alias("relation"), F.col("l_suppkey").cast("string").alias("target_id"), F.lit("disease").alias("target_type"), F.concat(F.lit("supplier "), "l_suppkey").alias("target_name"),
        temporal.alias("temporal"), evidence.alias("evidence"), F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("quality_grade"), F.col("l_partkey").cast("string").alias("disease_profile_id"), number().alias("ord"), *more,
    )


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the gold range of their part: [p_size, p_size + 10]."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    both = li.join(part, li["l_partkey"] == part["p_partkey"])
    return both.select(
        F.col("l_partkey").alias("disease_id"), F.col("l_quantity").alias("onset_min"), (F.col("l_quantity") + 100 * F.col("l_tax")).alias("onset_max"), F.col("p_size").cast("double").alias("ref_min"), (F.col("p_size") + 10.0).alias("ref_max"),
        relation(F.col("l_returnflag")).alias("relation"), F.col("l_discount").alias("credibility"), ord_().alias("ord"), F.array(F.concat(F.lit("PMID:"), (F.col("l_orderkey") * 1000).cast("string"))).alias("source_ids"), (F.col("l_linenumber") % 3 + 1).alias("n_models"),
    )


MATCHED_SQL = f"""
SELECT l_partkey AS disease_id, l_quantity AS a, l_quantity + 100 * l_tax AS b, p_size::DOUBLE AS x, p_size + 10.0::DOUBLE AS y,
       {RELATION_SQL} AS relation, l_discount AS credibility, {ORD_SQL} AS ord, l_orderkey, l_linenumber % 3 + 1 AS n_models
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def static_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of orders as a static graph: names are the keys, so that some pairs occur reversed."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    s = lambda c: F.col(c).cast("string")
    return li.select(relation(F.col("l_returnflag")).alias("relation"), F.lit("").alias("display_relation"), s("l_partkey").alias("x_id"), F.lit("drug").alias("x_type"), s("l_partkey").alias("x_name"), F.lit("t").alias("x_source"), s("l_suppkey").alias("y_id"), F.lit("disease").alias("y_type"), s("l_suppkey").alias("y_name"), F.lit("t").alias("y_source"))


def gold_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as diseases with onset windows."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("disease_id"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("double").alias("min_age"), (F.col("p_size") + 10.0).alias("max_age"))
