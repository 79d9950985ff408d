"""The engine's pipelines, end to end: quality control, answering, gold validation, chunk corpus, extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import parse, scores
from kairoscope.operators import chunks, consensus, gold, graph, matching, quality, temporal, vectors
from kairoscope.storage import stored


def quality_control(raw: DataFrame, metadata: DataFrame, as_of: Column, kg: DataFrame | None = None) -> dict[str, DataFrame]:
    """Raw triples (with ord and disease_profile_id) to merged, reasoned, graded edges; with rejects, conflicts, events, issues, coverage and a report.

    Edges merge within their profile only. Grade A is an edge that the static graph confirms, B one with two sources, else C.
    """
    judged = stored(quality.validated(raw), "judged")
    valid, rejects = judged.filter("reject_reason IS NULL"), judged.filter("reject_reason IS NOT NULL")
    made = quality.to_edges(quality.with_evidence(valid, metadata))
    merged = stored(consensus.merge_sources(made, "disease_profile_id"), "merged")
    done, events, issues = temporal.reason(merged, as_of)
    graded = done.withColumn("quality_grade", F.when(F.col("n_members") > 1, "B").otherwise("C"))
    if kg is not None:
        triples = merged.select("ord", F.col("source_name").alias("subject"), "relation", F.col("target_name").alias("object"))
        found = matching.confirmed(triples, kg).select("ord", "match_type")
        graded = graded.join(found, "ord", "left").withColumn("quality_grade", F.when(F.col("match_type").isNotNull(), "A").otherwise(F.col("quality_grade")))
    return {
        "edges": graded, "rejects": rejects, "conflicts": quality.conflicts(merged), "events": events, "issues": issues,
        "coverage": quality.coverage(done, "disease_profile_id"), "report": quality.report(judged.drop("reject_reason"), merged, "disease_profile_id"),
    }


def extraction(outputs: DataFrame, models: int = 2) -> DataFrame:
    """Model outputs (source_id, extraction_model, output) to the triples of a document on which `models` agree."""
    records = outputs.select("source_id", "extraction_model", F.posexplode(parse.json_records("output")).alias("pos", "record"))
    fields = quality.parsed_record(F.from_json("record", "map<string,string>"), F.col("source_id"), F.col("extraction_model"))
    triples = records.withColumn("t", fields).filter("t IS NOT NULL").select("t.*").withColumn("ord", F.monotonically_increasing_id())
    return consensus.consensus(stored(triples, "extracted"), "source_id", least=models)


def answer(questions: DataFrame, edges: DataFrame, chunked: DataFrame | None = None, model: Callable | None = None, depth: int = 2, most: int = 20, top_chunks: int = 5) -> DataFrame:
    """question_id -> context of ranked triples and, if chunks with embeddings are given, of the nearest chunks; answered by a
    pluggable function of (question, context), else by the best triple."""
    found = graph.retrieve(questions, edges, depth, most).filter("NOT insufficient_evidence").select("question_id", "rank", "source_name", "relation", "target_name")
    if chunked is not None:
        asked = vectors.encoded(questions.select(F.col("question_id").alias("vec_id"), F.col("question").alias("text")))
        near = vectors.nearest(asked, chunked.withColumnRenamed("chunk_id", "vec_id"), top_chunks, exclude_self=False)
        hits = near.join(chunked.select(F.col("chunk_id").alias("vec_id"), "source_name", "text"), "vec_id").select(F.col("query_id").alias("question_id"), "rank", "source_name", "text")
    else:
        hits = questions.select("question_id", F.lit(0).alias("rank"), F.lit("").alias("source_name"), F.lit("").alias("text")).limit(0)
    context = questions.join(vectors.context(hits, found), "question_id", "left")
    best = found.filter("rank = 1").select("question_id", F.concat_ws(" ", "source_name", "relation", "target_name").alias("best"))
    joined = context.join(best, "question_id", "left")
    if model is None:
        return joined.withColumn("answer", F.coalesce("best", F.lit("insufficient evidence"))).drop("best")
    return joined.withColumn("answer", F.pandas_udf(model, "string")("question", F.coalesce("context", F.lit("")))).drop("best")


def gold_validation(edges: DataFrame, crosswalk: DataFrame, reference: DataFrame) -> dict[str, DataFrame]:
    """Onset windows of edges (disease_id, onset_min, onset_max, relation, credibility, ord) against gold ranges found by crosswalk."""
    ranges = reference.select("gold_id", F.col("min_age").alias("ref_min"), F.col("max_age").alias("ref_max"))
    matched = stored(matching.first_listed(edges, crosswalk, ranges), "matched")
    classes = gold.taxonomy(matched, "disease_id")
    return {"strategies": gold.strategies(matched, "disease_id"), "taxonomy": gold.taxonomy_summary(classes), "quartiles": gold.by_quartile(matched), "relations": gold.by_relation(matched)}


def chunk_corpus(docs: DataFrame, questions: DataFrame | None = None, model: Callable | None = None) -> DataFrame:
    """Documents (name, text) and the snippets of questions as chunks with embeddings."""
    found = chunks.chunked(docs)
    if questions is not None:
        found = found.unionByName(chunks.snippets(questions))
    return vectors.encoded(found, model)


def disease_summary(edges: DataFrame, most: int = 5) -> DataFrame:
    """For each profile: edges, temporal coverage, mean credibility and its best edges."""
    e = F.col("evidence")
    score = scores.rerank(e["credibility_score"], e["consensus_confidence"], F.col("quality_grade"))
    rank = F.row_number().over(Window.partitionBy("disease_profile_id").orderBy(F.desc("score"), "edge_id"))
    best = edges.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= most).groupBy("disease_profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "edge_id"))), lambda x: x["edge_id"]).alias("best"))
    return quality.coverage(edges, "disease_profile_id").join(edges.groupBy("disease_profile_id").agg(F.avg("evidence.credibility_score").alias("mean_credibility")), "disease_profile_id").join(best, "disease_profile_id")
