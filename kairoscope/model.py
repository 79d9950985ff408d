"""The data model: vocabularies, record schemas and the keys derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node types, relations, carrier relations, study weights and synonyms, as the records hold them.
NODE_TYPES = ("disease", "gene/protein", "drug", "biological_process", "molecular_function", "cellular_component", "anatomy", "pathway", "phenotype", "exposure", "clinical_finding")
RELATIONS = (
    "disease_protein", "drug_protein", "indication", "contraindication", "off-label use", "phenotype_protein", "disease_phenotype_positive", "disease_phenotype_negative",
    "drug_effect", "protein_protein", "bioprocess_protein", "molfunc_protein", "cellcomp_protein", "exposure_disease", "exposure_protein", "exposure_bioprocess",
    "exposure_molfunc", "exposure_cellcomp", "pathway_protein", "anatomy_protein_expressed", "anatomy_protein_absent", "disease_disease",
    "differential_diagnosis", "first_line_treatment", "second_line_treatment", "risk_factor_for", "complication_of",
    "treats", "manifests_as", "caused_by", "biomarker_for", "progresses_to", "differentiates", "onset_at", "other",
)
CARRIERS = {
    "treats": "indication", "manifests_as": "disease_phenotype_positive", "caused_by": "disease_protein", "biomarker_for": "disease_protein",
    "progresses_to": "disease_disease", "differentiates": "disease_disease", "onset_at": "disease_phenotype_positive",
    "differential_diagnosis": "differential_diagnosis", "first_line_treatment": "first_line_treatment", "second_line_treatment": "second_line_treatment",
    "risk_factor_for": "risk_factor_for", "complication_of": "complication_of",
}
STUDY_WEIGHTS = {"meta-analysis": 1.0, "guideline": 0.95, "RCT": 0.9, "cohort": 0.7, "case-control": 0.6, "case-series": 0.4, "case-report": 0.3, "review": 0.5, "database": 0.85, "expert-opinion": 0.2, "other": 0.1}
TYPE_SYNONYMS = {
    "disease": "disease", "gene": "gene/protein", "protein": "gene/protein", "gene/protein": "gene/protein", "drug": "drug", "treatment": "drug",
    "phenotype": "phenotype", "effect/phenotype": "phenotype", "symptom": "clinical_finding", "clinical_finding": "clinical_finding", "anatomy": "anatomy",
    "pathway": "pathway", "biological_process": "biological_process", "molecular_function": "molecular_function", "cellular_component": "cellular_component", "exposure": "exposure",
}
RELATION_SYNONYMS = {
    "treats": ("treats", "treatment_for", "used_to_treat", "therapeutic_for", "indication", "managed_by", "managed_with", "therapy_for", "first_line_treatment", "second_line_treatment", "standard_of_care"),
    "disease_phenotype_positive": ("disease_phenotype_positive", "manifests_as", "presents_with", "associated_with_phenotype", "symptom_of", "clinical_feature", "characterized_by", "sign_of", "has_symptom", "phenotype_of", "clinical_manifestation"),
    "disease_phenotype_negative": ("disease_phenotype_negative", "absent_in", "not_associated_with", "absent_phenotype"),
    "caused_by": ("caused_by", "etiology", "pathogenesis", "results_from", "due_to", "attributed_to", "mechanism"),
    "biomarker_for": ("biomarker_for", "diagnostic_marker", "indicator_of", "diagnostic_test", "detected_by", "measured_by"),
    "progresses_to": ("progresses_to", "leads_to", "evolves_into", "develops_into", "complications", "sequela", "worsens_to"),
    "onset_at": ("onset_at", "onset_age", "age_of_onset", "typical_onset", "age_at_diagnosis", "presents_at_age"),
    "disease_protein": ("disease_protein", "gene_disease", "associated_gene", "caused_by_mutation_in", "gene_variant", "genetic_basis", "mutation_in", "pathogenic_variant"),
    "drug_effect": ("drug_effect", "side_effect", "adverse_effect", "adverse_reaction", "toxicity", "drug_interaction"),
    "disease_disease": ("disease_disease", "comorbidity", "differential_diagnosis", "differentiates", "associated_disease", "co_occurs_with", "misdiagnosed_as", "overlaps_with"),
    "contraindication": ("contraindication", "contraindicated_for", "avoid_in", "not_recommended"),
    "exposure_disease": ("exposure_disease", "risk_factor", "risk_factor_for", "environmental_cause", "trigger", "precipitant"),
    "protein_protein": ("protein_protein", "interacts_with", "binds_to", "activates", "ligand_of", "receptor_for", "binding_partner", "physically_interacts_with"),
    "anatomy_protein_expressed": ("expressed_in", "anatomy_protein_expressed", "produced_in", "secreted_by", "synthesized_in"),
    "anatomy_protein_absent": ("anatomy_protein_absent", "not_expressed_in", "absent_in_tissue"),
    "synonym_of": ("synonym_of", "also_known_as", "alternative_name", "named_after", "abbreviated_as"),
    "located_at": ("located_at", "found_at", "resides_in", "localizes_to", "subcellular_localization"),
    "has_property": ("has_property", "is_property_of", "characterized_by_property", "has_characteristic", "is_a_type_of"),
    "is_member_of": ("is_member_of", "belongs_to", "member_of", "part_of_family", "classified_as"),
    "encoded_by": ("encoded_by", "gene_product_of", "translated_from"),
    "regulates": ("regulates", "controls", "modulates", "upregulates", "downregulates", "inhibits", "activates_expression"),
}
#: Static-graph node type of a free-text type, for name lookups.
LOOKUP_TYPES = {"gene": "gene/protein", "protein": "gene/protein", "drug": "drug", "treatment": "drug", "phenotype": "effect/phenotype", "symptom": "effect/phenotype", "effect/phenotype": "effect/phenotype"}
#: Both endpoints' types, in either order, of each relation.
LEGAL_TYPES = {
    "disease_phenotype_positive": (("disease", "phenotype"),), "disease_phenotype_negative": (("disease", "phenotype"),), "disease_protein": (("disease", "gene/protein"),),
    "indication": (("drug", "disease"),), "contraindication": (("drug", "disease"),), "off-label use": (("drug", "disease"),),
    "drug_effect": (("drug", "phenotype"), ("drug", "biological_process")), "drug_protein": (("drug", "gene/protein"),), "disease_disease": (("disease", "disease"),),
    "protein_protein": (("gene/protein", "gene/protein"),), "bioprocess_protein": (("biological_process", "gene/protein"),), "molfunc_protein": (("molecular_function", "gene/protein"),),
    "cellcomp_protein": (("cellular_component", "gene/protein"),), "phenotype_protein": (("phenotype", "gene/protein"),), "pathway_protein": (("pathway", "gene/protein"),),
    "anatomy_protein_expressed": (("anatomy", "gene/protein"),), "anatomy_protein_absent": (("anatomy", "gene/protein"),), "exposure_disease": (("exposure", "disease"),),
    "exposure_protein": (("exposure", "gene/protein"),), "exposure_bioprocess": (("exposure", "biological_process"),), "exposure_molfunc": (("exposure", "molecular_function"),),
    "exposure_cellcomp": (("exposure", "cellular_component"),), "treats": (("drug", "disease"),), "manifests_as": (("disease", "phenotype"),), "caused_by": (("disease", "gene/protein"),),
    "biomarker_for": (("gene/protein", "disease"), ("phenotype", "disease")), "progresses_to": (("disease", "disease"),), "differentiates": (("disease", "disease"),), "onset_at": (("disease", "phenotype"),),
}
#: Legal in this order only.
LEGAL_ONE_WAY = (("differentiates", "phenotype", "disease"),)
#: (source type, relation, target type) -> the relation that it should be.
RECLASSIFIED = {
    ("disease", "disease_phenotype_positive", "disease"): "disease_disease",
    ("disease", "disease_phenotype_negative", "disease"): "disease_disease",
    ("disease", "manifests_as", "disease"): "disease_disease",
    ("disease", "disease_disease", "phenotype"): "disease_phenotype_positive",
    ("phenotype", "disease_disease", "disease"): "disease_phenotype_positive",
    ("gene/protein", "disease_phenotype_positive", "phenotype"): "phenotype_protein",
    ("phenotype", "disease_phenotype_positive", "gene/protein"): "phenotype_protein",
    ("drug", "indication", "phenotype"): "drug_effect",
    ("phenotype", "indication", "drug"): "drug_effect",
    ("gene/protein", "disease_phenotype_positive", "disease"): "disease_protein",
    ("disease", "disease_phenotype_positive", "gene/protein"): "disease_protein",
    ("disease", "disease_protein", "biological_process"): "bioprocess_protein",
    ("biological_process", "disease_protein", "disease"): "bioprocess_protein",
    ("biological_process", "disease_protein", "gene/protein"): "bioprocess_protein",
    ("gene/protein", "disease_protein", "biological_process"): "bioprocess_protein",
}
SUPERSEDABLE = ("indication", "contraindication", "treats", "off-label use", "first_line_treatment", "second_line_treatment")
CONTRADICTORY = (("indication", "contraindication"), ("disease_phenotype_positive", "disease_phenotype_negative"))
CONFLICTS = (
    ("indication_contraindication_conflict", "indication", "contraindication"),
    ("phenotype_positive_negative_conflict", "disease_phenotype_positive", "disease_phenotype_negative"),
    ("first_line_contraindication_conflict", "first_line_treatment", "contraindication"),
)
SUPERSESSION_PHRASES = ("replaced by", "no longer recommended", "superseded", "withdrawn", "discontinued", "obsolete", "preferred over")
MISSING = ("", "unknown", "null", "none")

CONTEXT_FIELDS = ("onset_age_min", "onset_age_max", "progression_stage", "duration", "milestone", "temporal_qualifier", "treatment_start_age", "discovery_year")
CONDITION_FIELDS = ("age_group", "genetic_subtype", "disease_stage", "population", "treatment_line", "sex", "biological_context", "cell_type", "tissue_type", "experimental_model", "species")


def _strings(names) -> str:
    return ", ".join(f"{n}: string" for n in names)


# Schemas, as DDL. Raw numbers arrive as text, numbers or junk: they are read as strings and cast defensively.
RAW_TRIPLES = (
    "subject string, subject_type string, subject_id string, relation string, object string, object_type string, object_id string, "
    f"temporal_context struct<{_strings(CONTEXT_FIELDS)}>, conditions struct<{_strings(CONDITION_FIELDS)}>, evidence_text string, source_id string, extraction_model string, confidence string"
)
TEMPORAL = (
    "struct<discovery_date: date, validity_start: date, validity_end: date, superseded_by: string, temporal_resolution: string, onset_age_min: double, onset_age_max: double, "
    "progression_stage: string, duration: string, milestone: string, temporal_qualifier: string, treatment_start_age: double>"
)
EVIDENCE = (
    "struct<tier: int, source_ids: array<string>, credibility_score: double, study_type: string, consensus_confidence: double, extraction_models: array<string>, "
    "extraction_method: string, citation_count: int, is_retracted: boolean, evidence_text: string>"
)
CONDITIONS = f"struct<{_strings(CONDITION_FIELDS)}>"
EDGES = (
    "edge_id string, source_id string, source_type string, source_name string, relation string, target_id string, target_type string, target_name string, "
    f"temporal {TEMPORAL}, evidence {EVIDENCE}, conditions {CONDITIONS}, extraction_date date, pipeline_version string, disease_profile_id string, quality_grade string"
)
DOCUMENTS = "source_id string, source_type string, tier int, title string, text string, sections map<string,string>, publication_date date, journal string, credibility_score double, study_type string, citation_count int, is_retracted boolean"
KG_EDGES = ", ".join(f"{n} string" for n in ("relation", "display_relation", "x_id", "x_type", "x_name", "x_source", "y_id", "y_type", "y_name", "y_source"))
CHUNKS = "chunk_id string, source_type string, source_name string, section_heading string, text string, char_start int, char_end int, embedding array<float>"


def mapping(values: dict) -> Column:
    """A literal map: a lookup that Catalyst folds, for dimensions of a few hundred entries."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def look_up(values: dict, key: Column) -> Column:
    return F.try_element_at(mapping(values), key)


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    """First twelve hex digits of the MD5 of source|relation|target; a null part counts as empty."""
    return F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (source, relation, target)])), 1, 12)


def key_of(text: Column) -> Column:
    """The form in which names are compared."""
    return F.lower(F.trim(text))
