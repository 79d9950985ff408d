"""From raw triples to edges: validation, projection, legality, conflicts, coverage and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.functions import ages, scores, text
from kairoscope.model import CONDITION_FIELDS, CONFLICTS, LEGAL_ONE_WAY, LEGAL_TYPES, RECLASSIFIED, edge_id, look_up

LEAST_CONFIDENCE = 0.3


def reject_reason(subject: Column, relation: Column, obj: Column, confidence: Column, age_min: Column, age_max: Column) -> Column:
    """The first rule that a triple breaks; null if it is valid. Ages count only where both are set."""
    empty = F.lit(False)
    for c in (subject, relation, obj):
        empty |= F.coalesce(c, F.lit("")) == ""
    return (
        F.when(empty, "missing_fields")
        .when((F.length(subject) < 2) | (F.length(obj) < 2), "entity_too_short")
        .when(F.coalesce(confidence, F.lit(0.0)) < LEAST_CONFIDENCE, "low_confidence")
        .when(age_min > age_max, "temporal_age_inverted")
        .when((age_max.isNotNull() & (age_min < 0)) | (age_min.isNotNull() & (age_max > ages.OLDEST)), "temporal_age_implausible")
        .when(F.lower(subject) == F.lower(obj), "self_referencing")
    )


def validated(raw: DataFrame) -> DataFrame:
    """Raw triples with reject_reason (null: valid)."""
    t = F.col("temporal_context")
    low, high = ages.number(t["onset_age_min"]), ages.number(t["onset_age_max"])
    return raw.withColumn("reject_reason", reject_reason(F.col("subject"), F.col("relation"), F.col("object"), ages.number(F.col("confidence")), low, high))


def _text(value: Column) -> Column:
    return F.when(text.present(value), value)


def evidence_scores(docs: DataFrame) -> DataFrame:
    """source_id -> (score, study_type); the last document of a source wins (by ord, if there is one)."""
    order = F.col("ord") if "ord" in docs.columns else F.col("credibility_score")
    return docs.groupBy("source_id").agg(F.max_by(F.struct("credibility_score", "study_type"), order).alias("x")).select("source_id", F.col("x.credibility_score").alias("score"), "x.study_type")


def with_evidence(triples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Triples with score and study_type of their source, found by its whole id, else by the part before a bar."""
    whole = metadata.select(F.col("source_id").alias("whole_id"), F.col("score").alias("whole_score"), F.col("study_type").alias("whole_type"))
    base = metadata.select(F.col("source_id").alias("base_id"), F.col("score").alias("base_score"), F.col("study_type").alias("base_type"))
    own = F.coalesce(F.col("source_id"), F.lit(""))
    joined = triples.join(whole, own == F.col("whole_id"), "left").join(base, F.substring_index(own, "|", 1) == F.col("base_id"), "left")
    found = F.col("whole_id").isNotNull()
    return joined.withColumns({"score": F.when(found, F.col("whole_score")).otherwise(F.col("base_score")), "study_type": F.when(found, F.col("whole_type")).otherwise(F.col("base_type"))}).drop("whole_id", "whole_score", "whole_type", "base_id", "base_score", "base_type")


def to_edges(triples: DataFrame) -> DataFrame:
    """Valid triples as edges; score and study_type as with_evidence() adds them, the score computed where it is missing."""
    t, c = F.col("temporal_context"), F.col("conditions")
    confidence = ages.number(F.col("confidence"))
    study = F.coalesce("study_type", F.lit("other"))
    score = F.when(F.coalesce("score", F.lit(0.0)) == 0, scores.credibility(study, confidence)).otherwise(F.col("score"))
    year = ages.number(t["discovery_year"]).cast("int")
    discovered = F.when(year.between(1, 9999), F.make_date(year, F.lit(1), F.lit(1)))
    source, target = (F.coalesce(F.nullif(F.col(i), F.lit("")), F.col(n)) for i, n in (("subject_id", "subject"), ("object_id", "object")))
    relation = text.graph_relation(F.col("relation"))
    temporal = F.struct(
        discovered.alias("discovery_date"),
        F.lit(None).cast("date").alias("validity_start"),
        F.lit(None).cast("date").alias("validity_end"),
        F.lit(None).cast("string").alias("superseded_by"),
        F.when(discovered.isNotNull(), "year").otherwise("unknown").alias("temporal_resolution"),
        ages.number(t["onset_age_min"]).alias("onset_age_min"),
        ages.number(t["onset_age_max"]).alias("onset_age_max"),
        *[_text(t[n]).alias(n) for n in ("progression_stage", "duration", "milestone", "temporal_qualifier")],
        ages.number(t["treatment_start_age"]).alias("treatment_start_age"),
    )
    listed = [F.array_compact(F.array(_text(F.col(n)))).alias(a) for n, a in (("source_id", "source_ids"), ("extraction_model", "extraction_models"))]
    evidence = F.struct(
        F.lit(2).alias("tier"), listed[0], score.alias("credibility_score"), study.alias("study_type"), confidence.alias("consensus_confidence"), listed[1],
        F.lit("tier2_llm_consensus").alias("extraction_method"), F.lit(None).cast("int").alias("citation_count"), F.lit(False).alias("is_retracted"), F.col("evidence_text"),
    )
    stated = F.struct(*[_text(c[n]).alias(n) for n in CONDITION_FIELDS])
    conditions = F.when(F.coalesce(*[_text(c[n]) for n in CONDITION_FIELDS]).isNotNull(), stated)
    kept = [n for n in ("disease_profile_id", "ord") if n in triples.columns]
    return triples.select(
        edge_id(source, relation, target).alias("edge_id"), source.alias("source_id"), text.node_type(F.col("subject_type")).alias("source_type"), F.col("subject").alias("source_name"), relation.alias("relation"),
        target.alias("target_id"), text.node_type(F.col("object_type")).alias("target_type"), F.col("object").alias("target_name"), temporal.alias("temporal"), evidence.alias("evidence"), conditions.alias("conditions"), *kept,
    )


def parsed_record(record: Column, source_id: Column, model: Column) -> Column:
    """A model's record (a map of strings) as a triple's fields; null without subject, relation or object."""
    field = lambda n: F.trim(F.try_element_at(record, F.lit(n)))
    level = F.lower(field("confidence"))
    confidence = F.coalesce(F.when(level == "high", 0.9).when(level == "medium", 0.7).when(level == "low", 0.4), F.lit(0.5))
    whole = text.present(field("subject")) & text.present(field("relation")) & text.present(field("object"))
    return F.when(whole, F.struct(field("subject").alias("subject"), field("relation").alias("relation"), field("object").alias("object"), confidence.alias("confidence"), F.left(field("evidence_text"), F.lit(300)).alias("evidence_text"), source_id.alias("source_id"), model.alias("extraction_model")))


def legal_types(source_type: Column, relation: Column, target_type: Column) -> Column:
    """Whether the relation may join these types; most may in either order."""
    allowed = {f"{r}|{a}|{b}" for r, pairs in LEGAL_TYPES.items() for x, y in pairs for a, b in ((x, y), (y, x))} | {"|".join((r, a, b)) for r, a, b in LEGAL_ONE_WAY}
    return F.concat_ws("|", relation, source_type, target_type).isin(*sorted(allowed))


def repaired(edges: DataFrame) -> DataFrame:
    """Edges with action: valid, reclassified (another relation), swapped (ends exchanged) or tagged_unresolved."""
    s, r, t = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("source_type", "relation", "target_type"))
    better = look_up({"|".join(k): v for k, v in RECLASSIFIED.items()}, F.concat_ws("|", s, r, t))
    swap = (s == "disease") & (r == "indication") & (t == "drug")
    action = F.when(legal_types(s, r, t), "valid").when(better.isNotNull(), "reclassified").when(swap, "swapped").otherwise("tagged_unresolved")
    judged = edges.withColumns({"action": action, "better": better})
    ends = {}
    for part in ("id", "name", "type"):
        a, b = f"source_{part}", f"target_{part}"
        if a in edges.columns and b in edges.columns:
            ends |= {a: F.when(F.col("action") == "swapped", F.col(b)).otherwise(F.col(a)), b: F.when(F.col("action") == "swapped", F.col(a)).otherwise(F.col(b))}
    return judged.withColumns(ends | {"relation": F.when(F.col("action") == "reclassified", F.col("better")).otherwise(F.col("relation")), "type_mismatch_unresolved": F.col("action") == "tagged_unresolved"}).drop("better")


def conflicts(edges: DataFrame, kinds: tuple = CONFLICTS) -> DataFrame:
    """A row for each pair of names that has both relations of a conflicting kind."""
    grouped = edges.groupBy(F.lower("source_name").alias("source"), F.lower("target_name").alias("target")).agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    found = F.array_compact(F.array(*[F.when(F.array_contains("relations", a) & F.array_contains("relations", b), F.lit(kind)) for kind, a, b in kinds]))
    return grouped.withColumn("type", F.explode(found))


def coverage(edges: DataFrame, *by: str) -> DataFrame:
    """Shares of edges with each kind of temporal information; any_temporal leaves out the upper age and validity."""
    t = F.col("temporal")
    stated = {n: text.present(t[n]) for n in ("progression_stage", "duration", "milestone", "temporal_qualifier")}
    has = {n: t[n].isNotNull() for n in ("discovery_date", "validity_start", "validity_end", "treatment_start_age")} | stated
    has["onset_age"] = t["onset_age_min"].isNotNull() | t["onset_age_max"].isNotNull()
    anything = has["discovery_date"] | t["onset_age_min"].isNotNull() | has["treatment_start_age"]
    for c in stated.values():
        anything |= c
    return edges.groupBy(*by).agg(F.count("*").alias("total"), F.avg(anything.cast("int")).alias("coverage"), *[F.avg(c.cast("int")).alias(n) for n, c in has.items()])


def resolutions(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("temporal.temporal_resolution").alias("resolution")).count()


def report(raw: DataFrame, merged: DataFrame, *by: str) -> DataFrame:
    """Triples in and edges out for each key, mean credibility, and the grade of their ratio (merging lowers it) beside that of the valid ones."""
    counted = validated(raw).groupBy(*by).agg(F.count("*").alias("n_input"), F.count_if(F.col("reject_reason").isNull()).alias("n_valid"))
    out = merged.groupBy(*by).agg(F.count("*").alias("n_edges"), F.avg("evidence.credibility_score").alias("mean_credibility"))
    joined = counted.join(out, list(by), "left") if by else counted.crossJoin(F.broadcast(out))
    return joined.withColumns({"quality_grade": scores.grade(F.coalesce(F.col("n_edges") / F.col("n_input"), F.lit(0.0))), "valid_grade": scores.grade(F.col("n_valid") / F.col("n_input"))})


def consistency_issues(edges: DataFrame, as_of: Column) -> DataFrame:
    """(edge_id, issue_type, severity, description) of every temporal inconsistency."""
    t = F.col("temporal")

    def issue(when: Column, kind: str, severity: str, description: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), description.alias("description")))

    both = t["onset_age_min"].isNotNull() & t["onset_age_max"].isNotNull()
    found = F.array_compact(
        F.array(
            issue(t["discovery_date"] > as_of, "future_date", "error", F.concat(F.lit("discovered after "), as_of.cast("string"))),
            issue(both & (t["onset_age_min"] > t["onset_age_max"]), "age_implausible", "error", F.lit("the lower age exceeds the upper")),
            issue(both & (t["onset_age_max"] > ages.OLDEST), "age_implausible", "warning", F.lit("the upper age exceeds 120 years")),
            issue(t["validity_end"] < t["validity_start"], "date_ordering", "error", F.lit("validity ends before it starts")),
            issue(F.year(t["discovery_date"]) < 1900, "date_ordering", "warning", F.lit("discovered before 1900")),
        )
    )
    return edges.select("edge_id", F.explode(found).alias("i")).select("edge_id", "i.*")


