"""Sinks: validated tables with rejects, exports of edges, property graphs, buckets and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.model import NODE_TYPES, RELATIONS

CSV_COLUMNS = ("relation", "display_relation", "x_id", "x_type", "x_name", "x_source", "y_id", "y_type", "y_name", "y_source")


def write_quality(valid: DataFrame, rejects: DataFrame, report: DataFrame, root: str, fmt: str = "json") -> None:
    """Edges by profile, rejects by reason, and the report."""
    valid.write.partitionBy("disease_profile_id").mode("overwrite").format(fmt).save(f"{root}/validated")
    rejects.write.partitionBy("reject_reason").mode("overwrite").format(fmt).save(f"{root}/rejected")
    report.write.mode("overwrite").json(f"{root}/report")


def as_json(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(*edges.columns)).alias("value"))


def static_rows(edges: DataFrame) -> DataFrame:
    """Edges in the static graph's ten columns and their time and evidence: lists as JSON, nulls as empty text."""
    t, e = F.col("temporal"), F.col("evidence")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = F.lit("kairoscope")
    base = dict(zip(CSV_COLUMNS, (F.col("relation"), F.col("relation"), F.col("source_id"), F.col("source_type"), F.col("source_name"), own, F.col("target_id"), F.col("target_type"), F.col("target_name"), own), strict=True))
    time = {n: t[n] for n in ("discovery_date", "validity_start", "validity_end", "superseded_by", "temporal_resolution", "onset_age_min", "onset_age_max", "progression_stage", "duration", "milestone", "temporal_qualifier", "treatment_start_age")}
    more = {"credibility_score": e["credibility_score"], "study_type": e["study_type"], "consensus_confidence": e["consensus_confidence"], "source_ids": F.to_json(e["source_ids"]), "extraction_models": F.to_json(e["extraction_models"])}
    return edges.select(*[text(c).alias(n) for n, c in (base | time | more).items()])


def evidence_nodes(edges: DataFrame) -> DataFrame:
    """Each edge as three nodes (source, evidence, target) and two virtual edges through the evidence."""
    node = lambda i, k, n: F.struct(i.cast("string").alias("id"), k.alias("type"), n.alias("name"))
    ev = F.concat(F.lit("EV:"), F.col("edge_id"))
    nodes = F.array(node(F.col("source_id"), F.col("source_type"), F.col("source_name")), node(ev, F.lit("evidence"), F.array_join("evidence.source_ids", "|")), node(F.col("target_id"), F.col("target_type"), F.col("target_name")))
    links = F.array(F.struct(F.col("source_id").alias("from"), F.lit("has_evidence").alias("type"), ev.alias("to")), F.struct(ev.alias("from"), F.col("relation").alias("type"), F.col("target_id").alias("to")))
    return edges.select("edge_id", nodes.alias("nodes"), links.alias("links"), "temporal", "evidence")


def flat(edges: DataFrame) -> DataFrame:
    """Fifteen columns for a prompt or a page; the first source stands for all, evidence text is left out."""
    t, e = F.col("temporal"), F.col("evidence")
    return edges.select("edge_id", "source_name", "source_type", "relation", "target_name", "target_type", t["discovery_date"].alias("discovery_date"), t["onset_age_min"].alias("onset_age_min"), t["onset_age_max"].alias("onset_age_max"), t["progression_stage"].alias("progression_stage"), t["milestone"].alias("milestone"), F.get(e["source_ids"], F.lit(0)).alias("pmid"), e["credibility_score"].alias("credibility_score"), e["consensus_confidence"].alias("consensus_confidence"), F.lit("").alias("evidence_text"))


def property_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes once for each label and name, edges once for each id; unknown labels and relations have a common one, null properties go."""
    label = lambda c: F.when(F.col(c).isin(*NODE_TYPES), F.initcap(F.regexp_replace(c, "[/_]", " "))).otherwise("Entity")
    kind = F.when(F.col("relation").isin(*RELATIONS), F.upper(F.regexp_replace("relation", "[^A-Za-z0-9]", "_"))).otherwise("OTHER")
    whole = edges.filter("coalesce(source_name, '') <> '' AND coalesce(target_name, '') <> ''").withColumns({"source_label": F.regexp_replace(label("source_type"), " ", ""), "target_label": F.regexp_replace(label("target_type"), " ", ""), "type": kind})
    ends = whole.select(F.explode(F.array(F.struct(F.col("source_label").alias("label"), F.col("source_name").alias("name"), F.col("source_id").alias("id")), F.struct(F.col("target_label").alias("label"), F.col("target_name").alias("name"), F.col("target_id").alias("id")))).alias("n")).select("n.*")
    properties = F.from_json(F.to_json(F.struct("temporal.*", F.col("evidence.credibility_score").alias("credibility_score"), F.array_join("evidence.source_ids", "|").alias("pmids"))), "map<string,string>")
    nodes = ends.groupBy("label", "name").agg(F.min("id").alias("id"))
    links = whole.withColumn("properties", F.map_filter(properties, lambda k, v: v.isNotNull() & (v != ""))).select("edge_id", "type", "source_label", "source_name", "target_label", "target_name", "properties").dropDuplicates(["edge_id"])
    return nodes, links


def write_index(kg: DataFrame, table: str, buckets: int = 64) -> None:
    """A static graph as a table bucketed by name, so that lookups by name need no shuffle of it."""
    kg.write.bucketBy(buckets, "x_name").sortBy("x_name").mode("overwrite").saveAsTable(table)


def write_vectors(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def finished(spark: SparkSession, manifest: str) -> DataFrame:
    """The manifest's keys; empty where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    schema = "disease_id string, validated boolean, n_consensus long"
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(manifest) if there else spark.createDataFrame([], schema)


def mark_finished(done: DataFrame, manifest: str) -> None:
    done.write.mode("append").parquet(manifest)
