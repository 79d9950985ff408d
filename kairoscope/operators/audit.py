"""Audit of a static graph against own triples: verdicts, staleness and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import ages, text

# Own relations that confirm a static one, and relations that contradict each other.
FAMILIES = {
    "disease_phenotype_positive": ("disease_phenotype_positive", "manifests_as", "associated_with", "characterized_by", "presents_with", "clinical_feature", "clinical_manifestation", "sign_of", "has_symptom", "phenotype_of", "symptom_of", "associated_with_phenotype"),
    "disease_phenotype_negative": ("disease_phenotype_negative", "absent_in", "not_associated_with", "absent_phenotype"),
    "disease_protein": ("disease_protein", "caused_by", "gene_disease", "associated_gene", "caused_by_mutation_in", "gene_variant", "genetic_basis", "mutation_in", "pathogenic_variant"),
    "disease_disease": ("disease_disease", "differentiates", "progresses_to", "comorbidity", "differential_diagnosis", "associated_disease", "co_occurs_with", "misdiagnosed_as", "overlaps_with"),
    "indication": ("treats", "indication", "treatment_for", "used_to_treat", "therapeutic_for", "managed_by", "managed_with", "therapy_for", "first_line_treatment", "second_line_treatment", "standard_of_care"),
    "contraindication": ("contraindication", "contraindicated_for", "avoid_in", "not_recommended"),
    "off-label use": ("treats", "off_label"),
    "exposure_disease": ("caused_by", "exposure_disease", "risk_factor", "risk_factor_for", "environmental_cause", "trigger", "precipitant"),
}
NEGATIONS = {"disease_phenotype_positive": "disease_phenotype_negative", "disease_phenotype_negative": "disease_phenotype_positive", "indication": "contraindication", "contraindication": "indication"}
COUNTED = 5
NOW = 2026


def relation_pairs(families: dict = FAMILIES, negations: dict = NEGATIONS) -> dict[str, str]:
    """'static|own' -> confirm or contradict; confirming wins."""
    out = {f"{s}|{o}": "contradict" for s, n in negations.items() for o in families.get(n, (n,))}
    return out | {f"{s}|{o}": "confirm" for s, own in families.items() for o in own}


def matches(static: DataFrame, triples: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """(edge_no, ord, match_type, score): own triples of the same disease whose relation confirms or contradicts a static
    edge (edge_no, disease_id, relation, x_name, y_name) and whose names match both ends, in the better orientation."""
    spark = static.sparkSession
    kinds = [(*k.split("|"), v) for k, v in (pairs or relation_pairs()).items()]
    known = F.broadcast(spark.createDataFrame(kinds, "relation string, own_relation string, match_type string"))  # a fixed table of a few rows
    s = static.join(known, "relation").withColumns({"x": text.audit_name(F.col("x_name")), "y": text.audit_name(F.col("y_name"))}).alias("s")
    t = triples.withColumns({"a": text.audit_name(F.col("subject")), "b": text.audit_name(F.col("object")), "own_relation": F.col("relation")}).drop("relation").alias("t")
    met = s.join(t, ["disease_id", "own_relation"])

    def oriented(x: str, y: str) -> Column:
        m, n = text.audit_match(F.col("x"), F.col(x)), text.audit_match(F.col("y"), F.col(y))
        return F.when(m["matched"] & n["matched"], (m["score"] + n["score"]) / 2).otherwise(0.0)

    return met.withColumn("score", F.greatest(oriented("a", "b"), oriented("b", "a"))).filter("score > 0").select("edge_no", F.col("t.ord").alias("ord"), "match_type", "score")


def verdicts(static: DataFrame, triples: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """A verdict for each static edge: CONFIRMED or CONTRADICTED by its best match, UNASSESSED without one.

    Evidence years come from the five best matches: the documents' own years, else those of their identifiers; an edge that
    is contradicted ends in its newest evidence's year.
    """
    found = matches(static, triples).join(triples.select("ord", "source_id", F.col("relation").alias("own_relation"), "confidence"), "ord")
    year = ages.identifier_year(F.col("source_id"))
    if years is not None:
        found = found.join(years.select(F.concat(F.lit("PMID:"), "pmid").alias("source_id"), F.col("year").alias("known_year")), "source_id", "left")
        year = F.coalesce("known_year", year)
    rank = F.row_number().over(Window.partitionBy("edge_no").orderBy(F.desc("score"), "ord"))
    best_few = found.withColumn("year", year).withColumn("rank", rank).filter(F.col("rank") <= COUNTED)  # before they are gathered
    top = best_few.groupBy("edge_no").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "ord", "match_type", "source_id", "year", "own_relation", "confidence"))).alias("top"))
    best, seen = F.col("top")[0], F.array_compact(F.transform("top", lambda x: x["year"]))
    joined = static.join(top, "edge_no", "left").join(triples.select("disease_id").distinct().withColumn("known", F.lit(True)), "disease_id", "left")
    verdict = F.when(best["match_type"] == "contradict", "CONTRADICTED").when(best["match_type"] == "confirm", "CONFIRMED").otherwise("UNASSESSED")
    newest = F.array_max(seen)
    return joined.select(
        *static.columns, verdict.alias("verdict"), F.when(best.isNotNull(), -best["order"]).when(F.col("known"), 0.3).otherwise(0.0).alias("confidence"), best["own_relation"].alias("own_relation"),
        F.transform("top", lambda x: x["source_id"]).alias("evidence"), newest.alias("newest_year"), F.array_min(seen).alias("oldest_year"), (F.lit(NOW) - newest).alias("evidence_age"),
        F.when((best["match_type"] == "contradict") & newest.isNotNull(), F.make_date(newest, F.lit(1), F.lit(1))).alias("validity_end"),
    )


def marked(judged: DataFrame, years: int = 10) -> DataFrame:
    """Verdicts with stale: confirmed edges whose newest evidence is `years` old or older."""
    return judged.withColumn("stale", F.coalesce((F.col("verdict") == "CONFIRMED") & (F.col("evidence_age") >= years), F.lit(False)))


def summary(judged: DataFrame, *by: str) -> DataFrame:
    """Counts by verdict, confirmed edges by age of evidence, and its mean."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    age = F.when((F.col("verdict") == "CONFIRMED") & (F.col("evidence_age") > 0), F.col("evidence_age"))
    old = [F.count_if(age >= n).alias(f"stale_{n}") for n in (5, 10, 15)]
    return judged.groupBy(*by).agg(F.count("*").alias("total"), is_("CONFIRMED").alias("confirmed"), is_("CONTRADICTED").alias("contradicted"), is_("UNASSESSED").alias("unassessed"), *old, F.bround(F.avg(age), 1).alias("mean_evidence_age"))
