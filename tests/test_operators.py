"""Operators on hand-made rows, where the driver's tables have no analogue."""

import datetime as dt
import gzip
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairoscope import model
from kairoscope.functions import ages, fuzzy, parse, scores, text
from kairoscope.operators import benchmark, blocks, chunks, components, consensus, diagnosis, evidence, gold, graph, matching, profiles, quality, studies, temporal, vectors
from kairoscope.plans import pipelines
from kairoscope.queries import tables
from kairoscope.sources import files, sinks
from kairoscope.streaming import quality as streams


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def raw(spark, rows):
    """Raw triples from dicts."""
    out = []
    for i, r in enumerate(rows):
        row = dict.fromkeys(("subject", "subject_type", "subject_id", "relation", "object", "object_type", "object_id", "evidence_text", "source_id", "extraction_model"))
        row |= {"subject_type": "disease", "object_type": "phenotype", "relation": "manifests_as", "confidence": "0.9", "source_id": f"PMID:{i}", "extraction_model": "m1"} | {k: v for k, v in r.items() if k not in model.CONTEXT_FIELDS}
        row["temporal_context"] = {k: r.get(k) for k in model.CONTEXT_FIELDS}
        row.setdefault("conditions", None)
        out.append(row | {"ord": i, "disease_profile_id": r.get("profile", "MONDO:1")})
    return spark.createDataFrame([{k: v for k, v in r.items() if k != "profile"} for r in out], f"{model.RAW_TRIPLES}, ord long, disease_profile_id string")


def edge_rows(spark, rows):
    """Edges from (source, type, relation, target, type, year, text, ids, credibility)."""
    t = raw(spark, [{"subject": s, "subject_type": st, "relation": r, "object": o, "object_type": ot, "discovery_year": y, "evidence_text": e} for s, st, r, o, ot, y, e, _, _ in rows])
    made = quality.to_edges(t.withColumns({"score": F.lit(0.5), "study_type": F.lit("other")}))
    extra = spark.createDataFrame([(i, ids, c) for i, (*_, ids, c) in enumerate(rows)], "ord long, ids array<string>, c double")
    return made.join(extra, "ord").withColumn("evidence", F.col("evidence").withField("source_ids", F.col("ids")).withField("credibility_score", F.col("c"))).drop("ids", "c").withColumn("quality_grade", F.lit("B"))


def test_validation_in_order(spark):
    rows = [
        ({"subject": "Ataxia", "object": "gait", "onset_age_min": "3"}, None), ({"subject": "", "object": "x"}, "missing_fields"), ({"subject": "A", "object": "gait"}, "entity_too_short"),
        ({"subject": "Ataxia", "object": "gait", "confidence": "0.3"}, None), ({"subject": "Ataxia", "object": "gait", "confidence": "0.29"}, "low_confidence"), ({"subject": "Ataxia", "object": "gait", "confidence": "junk"}, "low_confidence"),
        ({"subject": "Ataxia", "object": "gait", "onset_age_min": "9", "onset_age_max": "3"}, "temporal_age_inverted"), ({"subject": "Ataxia", "object": "gait", "onset_age_min": "-1", "onset_age_max": "3"}, "temporal_age_implausible"),
        ({"subject": "Ataxia", "object": "gait", "onset_age_min": "1", "onset_age_max": "121"}, "temporal_age_implausible"), ({"subject": "Ataxia", "object": "gait", "onset_age_min": "unknown", "onset_age_max": "130"}, None),
        ({"subject": "Ataxia", "object": "ATAXIA"}, "self_referencing"),
    ]
    found = [r["reject_reason"] for r in quality.validated(raw(spark, [r for r, _ in rows])).orderBy("ord").collect()]
    assert found == [w for _, w in rows]


def test_projection(spark):
    t = raw(spark, [{"subject": "Rett", "relation": " Treats ", "object": "x1", "subject_type": "Gene", "object_type": "widget", "discovery_year": "2001", "onset_age_max": "0.0", "progression_stage": "unknown"}, {"subject": "a1", "relation": "free text", "object": "b1", "discovery_year": "none"}])
    a, b = quality.to_edges(t.withColumns({"score": F.lit(0.0), "study_type": F.lit(None).cast("string")})).orderBy("ord").collect()
    assert (a["relation"], a["source_type"], a["target_type"], b["relation"]) == ("indication", "gene/protein", "phenotype", "free text")
    assert a["temporal"]["discovery_date"] == dt.date(2001, 1, 1) and a["temporal"]["onset_age_max"] == 0.0 and a["temporal"]["progression_stage"] is None and b["temporal"]["temporal_resolution"] == "unknown"
    assert a["evidence"]["credibility_score"] == round(0.15 * 0.3 + 0.25 * 0.1 + 0.15 * 0.5 + 0.15 + 0.15 * 0.9, 4) and a["conditions"] is None
    import hashlib

    assert a["edge_id"] == hashlib.md5(b"Rett|indication|x1").hexdigest()[:12]


def test_evidence_is_found_by_prefix(spark):
    metadata = spark.createDataFrame([("PMID:1", 0.7, "RCT"), ("PMID:2|PMC9", 0.2, "review")], "source_id string, score double, study_type string")
    t = raw(spark, [{"source_id": "PMID:1|PMC2"}, {"source_id": "PMID:2|PMC9"}, {"source_id": "PMID:2"}, {"source_id": None}])
    assert [(r["score"], r["study_type"]) for r in quality.with_evidence(t, metadata).orderBy("ord").collect()] == [(0.7, "RCT"), (0.2, "review"), (None, None), (None, None)]


def test_legality_and_repair(spark):
    rows = [("drug", "indication", "disease", "valid"), ("disease", "indication", "drug", "valid"), ("phenotype", "differentiates", "disease", "valid"), ("disease", "differentiates", "phenotype", "tagged_unresolved"), ("drug", "indication", "phenotype", "reclassified"), ("drug", "made up", "drug", "tagged_unresolved")]
    df = spark.createDataFrame([(s, r, t) for s, r, t, _ in rows], "source_type string, relation string, target_type string")
    assert [r["action"] for r in quality.repaired(df).collect()] == [w for *_, w in rows]


def test_names(spark):
    cases = {"Deflazacort 0.45 mg/kg/d": "deflazacort", "corticosteroid treatment": "corticosteroid", "prednisone/prednisolone": "prednisone prednisolone", "adeno-associated virus (AAV)": "adeno-associated virus", "p53 signaling pathway levels": "p53 signaling pathway", "x therapy": "x therapy", "100 µg dose per day": "dose"}
    for name, wanted in cases.items():
        assert value(spark, text.entity_name(F.lit(name))) == wanted, name
    assert value(spark, text.entity_name(F.lit(None).cast("string"))) == ""
    assert value(spark, text.canonical_relation(F.lit(" Managed_By "))) == "treats" and value(spark, text.canonical_relation(F.lit("odd"))) == "odd"
    assert value(spark, text.mentions(F.lit("What is the onset of Rett syndrome?")))[:2] == ["what is the onset", "is the onset of"]
    assert value(spark, text.padded_id(F.lit("MONDO_15920"))) == "MONDO:0015920" and value(spark, text.unpadded_id(F.lit("MONDO:0015920"))) == "MONDO:15920"
    assert value(spark, text.strip_tags(F.lit("<p>a &amp; b<script>x</script></p>"))) == "a & b"
    assert value(spark, text.is_abbreviation(F.lit("DMD"))) and not value(spark, text.is_abbreviation(F.lit("Dmd")))
    assert value(spark, text.split_ids(F.lit("b|a, b;c"))) == ["a", "b", "c"]


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_similarity(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 20))) for _ in range(60)]
    for a in words:
        for b in words:
            wanted = 100.0 if not a and not b else 200 * naive_lcs(a, b) / (len(a) + len(b))
            assert abs(fuzzy.similarity(a, b) - wanted) < 1e-9
    df = spark.createDataFrame([(a, b) for a in words[:30] for b in words[:30]], "a string, b string")
    assert df.filter(~fuzzy.possible(F.col("a"), F.col("b"), 80.0)).filter(fuzzy.alike(F.col("a"), F.col("b"), 80.0)).count() == 0
    pairs = [("corticosteroid", "corticosteroids", True), ("acid", "amino acid transport", False), ("muscle weakness", "weakness muscle", True), ("", "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert [r["m"] for r in df.select(fuzzy.same_entity(F.col("a"), F.col("b")).alias("m")).collect()] == [w for *_, w in pairs]


def test_components_any_order(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)]
    a = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    rng.shuffle(pairs)
    b = {r["node"]: r["root"] for r in components.components(spark.createDataFrame([(y, x) for x, y in pairs], "a long, b long").repartition(5)).collect()}
    assert a == b and all(n > r for n, r in a.items())


def test_consensus_merges_transitively(spark):
    rows = [("d1", "muscle weakness", "treats", "alpha one", "m1", 0.9), ("d1", "muscle weaknes", "indication", "alpha one", "m2", 0.8), ("d1", "muscle weakness", "treats", "alpha one", "m1", 0.7), ("d1", "zzzz yyyy", "treats", "qqqq", "m1", 0.9), ("d1", "zzzz yyyy", "treats", "qqqq", "m1", 0.8), ("d2", "muscle weakness", "treats", "alpha one", "m2", 0.9)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source_id string, subject string, relation string, object string, extraction_model string, confidence double, ord long")
    found = consensus.consensus(df, "source_id").collect()
    assert [(r["ord"], r["n_models"], r["confidence"]) for r in found] == [(0, 2, 1.0)]


def test_merge_policy(spark):
    rows = [
        ("Rett syndrome", "disease", "manifests_as", "seizures", "phenotype", None, None, ["1"], 0.5), ("rett syndrom", "disease", "manifests_as", "Seizures", "phenotype", None, None, ["2"], 0.7), ("Rett syndrome", "disease", "manifests_as", "seizures", "phenotype", None, None, ["1"], 0.7),
        ("Other", "disease", "manifests_as", "seizures", "phenotype", None, None, ["3"], 0.2), ("Same", "disease", "manifests_as", "thing", "phenotype", None, None, ["4"], 0.2), ("Same", "disease", "manifests_as", "thing", "phenotype", None, None, ["4"], 0.3),
    ]
    one = edge_rows(spark, rows)
    for edges in (one, one.withColumn("evidence", F.col("evidence").withField("source_ids", F.when(F.col("ord") == 3, F.array(F.lit("3"), F.lit("9"))).otherwise(F.col("evidence.source_ids"))))):
        found = {r["ord"]: r for r in consensus.merge_sources(edges, "disease_profile_id").collect()}
        assert sorted(found) == [1, 3, 4, 5] and found[1]["n_members"] == 3 and found[1]["evidence"]["source_ids"] == ["1", "2"]
        assert found[1]["evidence"]["consensus_confidence"] == pytest.approx(0.99) and found[1]["evidence"]["credibility_score"] == 0.7
        again = consensus.merge_sources(consensus.merge_sources(edges, "disease_profile_id").drop("n_members"), "disease_profile_id")
        assert again.count() == 4


def test_supersession(spark):
    rows = [
        ("drugA", "drug", "indication", "flu", "disease", "2000", None, ["1"], 0.5), ("drugA", "drug", "contraindication", "flu", "disease", "2010", None, ["2"], 0.5), ("drugB", "drug", "contraindication", "flu", "disease", "2000", None, ["3"], 0.5), ("drugB", "drug", "indication", "flu", "disease", "2010", None, ["4"], 0.5),
        ("drugC", "drug", "indication", "flu", "disease", "2015", "DrugB was replaced by drugC", ["5"], 0.5), ("drugD", "drug", "indication", "flu", "disease", None, "withdrawn drugA", ["6"], 0.5),
    ]
    done, events, issues = temporal.reason(edge_rows(spark, rows), F.lit("2012-01-01").cast("date"))
    assert sorted((r["reason"], r["old_discovery_date"].year, r["new_discovery_date"].year) for r in events.collect()) == [("contradictory", 2000, 2010), ("updated_treatment", 2000, 2015), ("updated_treatment", 2010, 2015)]
    ended = {r["ord"]: r["temporal"]["validity_end"] for r in done.collect()}
    assert {k for k, v in ended.items() if v} == {0, 2, 3} and ended[0] == dt.date(2010, 1, 1)
    assert [r["issue_type"] for r in issues.collect()] == ["future_date"]
    assert temporal.summary(done, events, issues).first()["validity_periods_inferred"] == 5


def test_confirmation_stages(spark):
    kg = spark.createDataFrame([("indication", "", "1", "drug", "Aspirin", "t", "2", "disease", "Headache", "t"), ("disease_disease", "", "3", "disease", "Migraine with aura", "t", "4", "disease", "Stroke", "t")], model.KG_EDGES)
    rows = [("aspirin", "indication", "headache"), ("headache", "indication", "aspirin"), ("headache", "other", "aspirin"), ("migraine", "x", "stroke"), ("nothing", "x", "stroke")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "subject string, relation string, object string, ord long")
    found = [(r["match_type"], r["reversed"]) for r in matching.confirmed(df, kg).orderBy("ord").collect()]
    assert found == [("exact", False), ("exact", True), ("same_relation", True), ("fuzzy_name", False), (None, None)]


def test_normalisation_and_concepts(spark):
    kg = spark.createDataFrame([("r", "", "1", "disease", "Rett syndrome", "t", "2", "gene/protein", "MECP2", "t")], model.KG_EDGES)
    asked = spark.createDataFrame([("rett syndrome", "disease"), ("mecp2", "disease"), ("rett s", "disease"), ("thing", "disease"), ("other", "disease")], "mention string, mention_type string")
    linked = spark.createDataFrame([("thing", "7", "Thing", 0.9), ("other", "8", "Other", 0.65)], "mention string, link_id string, link_name string, link_score double")
    judged = spark.createDataFrame([("other", "8", "Other", 0.8)], "mention string, judge_id string, judge_name string, judge_score double")
    found = {r["mention"]: (r["node_id"], r["confidence"], r["method"]) for r in matching.normalised(asked, matching.names(kg), linked, judged).collect()}
    assert found == {"rett syndrome": ("1", 1.0, "dictionary"), "mecp2": ("2", 0.95, "dictionary"), "rett s": ("1", 0.7, "dictionary_partial"), "thing": ("7", 0.9, "embedding"), "other": ("8", 0.8, "llm")}
    concepts = spark.createDataFrame([("C1", "Duchenne muscular dystrophy", ["DMD"]), ("C2", "Becker dystrophy", None)], "cui string, name string, aliases array<string>")
    m = {(r["mention"], r["cui"]): r["method"] for r in matching.matched_concepts(spark.createDataFrame([("dmd",), ("becker distrophy",)], "mention string"), concepts).collect()}
    assert m == {("dmd", "C1"): "exact", ("becker distrophy", "C2"): "fuzzy"}


def test_search_depths(spark):
    rows = [(a, "disease", "r", b, "disease", None, None, ["1"], 0.5) for a, b in (("A", "b"), ("B", "c"), ("c", "d"), ("d", "a"), ("x", "x"), ("e", "f"))]
    edges = edge_rows(spark, rows)
    seeds = spark.createDataFrame([("a",)], "entity string")
    sizes = [graph.neighbourhood(edges, seeds, k).count() for k in range(4)]
    assert sizes == [2, 4, 4, 4] and graph.neighbourhood(edges, spark.createDataFrame([("zz",)], "entity string"), 3).count() == 0
    assert {(r["entity"], r["hops"]) for r in graph.reached(graph.links_of(edges), seeds, 5).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    asked = spark.createDataFrame([(1, "tell me of e"), (2, "nothing")], "question_id int, question string")
    found = graph.retrieve(asked, edges.withColumn("source_name", F.when(F.col("source_name") == "e", "tell me").otherwise(F.col("source_name"))), 0)
    assert {(r["question_id"], r["insufficient_evidence"]) for r in found.collect()} >= {(1, False)}
    assert found.filter("question_id = 2 AND NOT insufficient_evidence").count() == 0


def test_retrieval_reads_whole_edges_only_for_what_it_found(spark, monkeypatch):
    held, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: held.append(df.columns) or stored(df, name))
    rows = [(a, "disease", "r", b, "disease", None, None, ["1"], c) for a, b, c in (("rett", "b", 0.1), ("B", "c", 0.9), ("c", "d", 0.5), ("rett", "x", 0.2), ("rett", "y", 0.8))]
    ids = F.when(F.col("ord") < 3, F.concat(F.lit("e"), F.col("ord").cast("string"))).otherwise("e9")  # the last two share an id: the later one counts
    edges = edge_rows(spark, rows).withColumn("edge_id", ids)
    asked = spark.createDataFrame([(1, "rett"), (2, "zzzz")], "question_id int, question string")
    for most in (None, 2):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", 0 if most is None else 100, raising=False)
        found = graph.retrieve(asked, edges, 1, most)
        assert {(r["question_id"], r["edge_id"], r["target_name"], r["rank"]) for r in found.collect()} == set([(1, "e1", "c", 1), (1, "e9", "y", 2), (1, "e0", "b", 3)][:most]) | {(2, None, None, None)}
    assert not any("evidence" in columns for columns in held)


def test_ages(spark):
    assert value(spark, ages.window(F.lit("2"), F.lit("junk"))) == (2.0, 2.0) and value(spark, ages.window(F.lit(None), F.lit("3"))) is None
    assert value(spark, ages.overlaps(F.lit(1), F.lit(2), F.lit(2), F.lit(3))) and not value(spark, ages.contained(F.lit(1), F.lit(2), F.lit(2), F.lit(3)))
    assert value(spark, ages.iso_years(F.lit("P1Y6M"))) == 1.5 and value(spark, ages.iso_years(F.lit("P30D"))) == 0.0821 and value(spark, ages.iso_years(F.lit("x"))) is None
    assert [value(spark, ages.readable(F.lit(a))) for a in (-1.0, 0.01, 0.3, 0.75, 1.5, 40.7)] == ["the prenatal period", "the neonatal period", "3 months", "9 months", "1.5 years", "40 years"]
    assert [value(spark, ages.onset_bin(F.lit(a), F.lit(b))) for a, b in ((0.0, 0.0), (0.0, 70.0), (60.0, 80.0))] == ["neonatal", "broad_range", "elderly"]
    assert [value(spark, ages.fit(F.lit(2.0), F.lit(4.0), F.lit(a))) for a in (3.0, 6.0, 12.0, 30.0)] == [1.0, 0.5, 0.25, 0.1]
    assert value(spark, ages.identifier_year(F.lit("PMID:25000000"))) == 2014 and value(spark, ages.identifier_year(F.lit("PMID:12"))) is None
    assert value(spark, ages.year_of(F.lit("1850-01"))) is None and value(spark, ages.year_of(F.lit("2001-02-03"))) == 2001


def test_parsers(spark):
    assert value(spark, parse.iso_date(F.lit("1999"))) == dt.date(1999, 1, 1) and value(spark, parse.any_date(F.lit("7/4/2001"))) == dt.date(2001, 7, 4)
    assert value(spark, parse.letter(F.lit("(b) since"))) == "B" and value(spark, parse.letter(F.lit("42"))) is None
    assert value(spark, parse.age_range(F.lit("from 3 to 5.5 years"))) == (3.0, 5.5) and value(spark, parse.age_phrase(F.lit("at 6 months"))) == (0.5, 0.5)
    assert value(spark, parse.age_phrase(F.lit("in the third decade"))) == (20.0, 30.0) and value(spark, parse.age_phrase(F.lit("early childhood"))) == (1.0, 5.0)
    record = {"subject": "a", "object": "b"}
    for t in (json.dumps([record]), "```json\n" + json.dumps({"triples": [record]}) + "\n```", json.dumps(record), "Here: " + json.dumps([record]) + " done", json.dumps({"any": [record]})):
        assert parse.repaired(t) == [record], t
    assert parse.repaired("junk") == [] and parse.repaired(None) == [] and parse.repaired("[1, 2") == []


def test_scores(spark):
    assert value(spark, scores.journal_score(F.lit("bioRxiv"))) == 0.15 and value(spark, scores.journal_score(F.lit(None).cast("string"))) == 0.3 and value(spark, scores.journal_score(F.lit("Odd Letters"))) == 0.3
    assert value(spark, scores.tier1_credibility()) == round(0.15 * (1 + 0.8 + 0.9 + 1 + 1) + 0.25 * 0.85, 4)
    assert value(spark, scores.percentage(F.lit(1), F.lit(0))) == 0.0 and value(spark, scores.grade(F.lit(0.7))) == "B"
    assert value(spark, benchmark.list_f1(F.array(F.lit("A b!"), F.lit("c")), F.array(F.array(F.lit("a B")), F.array(F.lit("d"))))) == 0.5


def test_gold(spark):
    rows = [(1, 1.0, 3.0, 2.0, 10.0, "manifests_as", 0.5, 1, 2), (1, 2.0, 2.0, 2.0, 10.0, "x", 0.4, 2, 1), (2, 0.0, 5.0, 0.0, 120.0, "x", 0.9, 3, 3), (3, 50.0, 60.0, 1.0, 5.0, "onset_at", None, 4, 1), (3, 50.0, 60.0, 1.0, 5.0, "onset_at", None, 5, 1)]
    m = spark.createDataFrame(rows, "disease_id int, onset_min double, onset_max double, ref_min double, ref_max double, relation string, credibility double, ord long, n_models int")
    s = gold.strategies(m, "disease_id").first()
    assert (s["compared"], s["minmax_overlap"], s["median_overlap"], s["per_triple_total"], s["per_triple_contained"]) == (2, 1, 1, 4, 1)
    assert {r["disease_id"]: r["category"] for r in gold.taxonomy(m, "disease_id").collect()} == {1: "PHENOTYPE_VS_DISEASE", 3: "GENUINELY_WRONG"}
    assert gold.by_quartile(m).agg(F.sum("n")).first()[0] == 2


def test_chunks(spark):
    text_ = "Intro words.\n\nFirst paragraph of a few words that goes on\nover two lines.\n\n\nSecond paragraph is here and has enough words to count for all.\nHEADING ONE\n" + "word " * 30 + "\nHEADING TWO\nshort"
    docs = spark.createDataFrame([("book", text_), ("empty", ""), ("sections of it", text_), ("budget", "One is here. " * 200)], "name string, text string")
    p = [(r["at"], r["start"]) for r in chunks.paragraphs(docs.filter("name = 'book'")).orderBy("at").collect()]
    assert p[0] == (0, 0) and p[1] == (1, 14) and text_[p[2][1] :].startswith("Second")
    w = chunks.paragraph_windows(docs.filter("name = 'book'"), 2, 1).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in w] == [f"TEXTBOOK:book:{i:04d}" for i in range(len(w))] and w[0]["text"].startswith("First paragraph")
    h = chunks.headed_sections(docs.filter("name LIKE 'sections%'"), r"^HEADING").collect()
    assert [r["section_heading"] for r in h] == ["", "HEADING ONE"]
    windows = chunks.budgeted("Aa. Bb. Cc. Dd.", 6, 3)
    assert [x for x, _ in windows] == ["Aa. Bb.", "Bb. Cc.", "Cc. Dd."]
    assert chunks.chunked(docs).select("source_name").distinct().count() == 3


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a"), (4, [0.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, source_type string")
    near = vectors.nearest(df, df, 2)
    assert [(r["vec_id"], round(r["score"], 3)) for r in near.filter("query_id = 1").orderBy("rank").collect()] == [(2, 0.994), (3, 0.0)]
    few = vectors.post_filtered(near, df.select("vec_id", "source_type"), "b", 2)
    assert few.filter("query_id = 1").count() == 1
    assert {(r["a"], r["b"]) for r in vectors.mutual_pairs(near, least=0.9).collect()} == {(1, 2)}


def test_questions(spark):
    edges = spark.createDataFrame([("d", m, a) for m, a in (("Walking", 1.0), ("walking", 1.2), ("Loss-of ambulation", 12.0), ("loss of ambulation presentation", 12.2), ("Death", 30.0), ("death", 31.0), ("once", 50.0))], "disease_id string, milestone string, age double")
    kept = benchmark.milestones(edges).first()["kept"]
    assert [m["name"] for m in kept] == ["Walking", "Loss-of ambulation", "Death"]
    assert benchmark.ordering(edges).first()["answer"] == "Walking → Loss-of ambulation → Death"
    assert benchmark.in_order("first **walking**, then death", ["Walking", "Death"]) and not benchmark.in_order("death, walking", ["Walking", "Death"])


def test_diagnosis(spark):
    o = spark.createDataFrame([("a", "Seizures", 0.0, 2.0), ("a", "ataxia gait", 1.0, 5.0), ("b", "seizures", 30.0, 40.0), ("b", "gait ataxia", 30.0, 40.0), ("c", "rash", 0.0, 1.0)], "disease string, phenotype string, onset_min double, onset_max double")
    s = diagnosis.simulate(o, o, points=(1.0,))
    a = {r["candidate"]: r["temporal"] for r in s.filter("target = 'a'").collect()}
    assert a["a"] == 1.0 and a["b"] < 0.2 and "c" not in a
    assert diagnosis.ranked(s, "temporal").filter("target = 'a'").first()["rank"] == 1
    t = profiles.paired_t(spark.createDataFrame([(x, x - 0.1 * i) for i, x in enumerate((0.5, 0.6, 0.7))], "a double, b double")).first()
    assert t["df"] == 2 and 0 < t["p"] < 1


def test_evidence(spark):
    assert value(spark, evidence.study_type(F.array(F.lit("Review"), F.lit("Meta-Analysis")))) == "meta-analysis"
    assert not value(spark, evidence.usable(F.lit("w " * 120), F.array(F.lit("Editorial")))) and value(spark, evidence.usable(F.lit("w " * 120), F.array(F.lit("Journal Article"))))
    docs = spark.createDataFrame([("d", "PMID:1", 0.9), ("d", "PMID:2", 0.5)], "disease_id string, source_id string, credibility_score double").withColumns({"source_type": F.lit("pubmed_abstract"), "text": F.lit("t")})
    full = spark.createDataFrame([("PMID:1", "PMC1", "whole")], "source_id string, pmcid string, focus_text string")
    found = {r["source_id"]: r for r in evidence.with_full_text(docs, full).collect()}
    assert len(found) == 3 and found["PMID:1|PMC1"]["credibility_score"] == pytest.approx(0.99)


def test_sources(spark, tmp_path):
    line = {"subject": "a1", "relation": "r", "object": "b1", "confidence": 0.5}
    (tmp_path / "MONDO_1").mkdir()
    (tmp_path / "MONDO_1/raw_triples.jsonl").write_text(json.dumps(line) + "\n\n{bad\n")
    found = files.folders(spark, str(tmp_path)).filter("subject IS NOT NULL").collect()
    assert [(r["disease_profile_id"], r["confidence"]) for r in found] == [("MONDO:1", "0.5")]
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(json.dumps(line) + "\n{bad\n")
    assert files.tolerant(spark, str(tmp_path / "x.jsonl.gz"), "subject string").count() == 1
    (tmp_path / "h.hpoa").write_text("#c\nOMIM:1\tD\t\tHP:1\tP\tE\tHP:0003593\t\t\t\tP\tX\nOMIM:1\tD\tNOT\tHP:2\tP\tE\tHP:0003581\t\t\t\tP\tX\n")
    rows = files.annotations(spark, str(tmp_path / "h.hpoa"))
    assert files.annotation_edges(rows).count() == 1
    assert files.annotation_ranges(rows, "database_id").first()["max_age"] == 120.0
    xml = "<L><Disorder><OrphaCode>5</OrphaCode><Name lang='en'>X</Name><AverageAgeOfOnsetList><AverageAgeOfOnset><Name lang='en'>Infancy</Name></AverageAgeOfOnset><AverageAgeOfOnset><Name lang='en'>Adult</Name></AverageAgeOfOnset></AverageAgeOfOnsetList></Disorder></L>"
    (tmp_path / "o.xml").write_text(xml)
    found = files.rare_diseases(spark, str(tmp_path / "o.xml")).collect()
    assert [(r["gold_id"], r["min_age"], r["max_age"]) for r in found] == [("ORPHA:5", 0.08, 120.0)]
    (tmp_path / "m.json").write_text(json.dumps({"graphs": [{"nodes": [{"id": "http://x/MONDO_0000005", "lbl": "n", "meta": {"xrefs": [{"val": "Orphanet:7"}, {"val": "OMIM:8"}, {"val": "Orphanet:6"}]}}]}]}))
    crosswalk, reverse, names = files.ontology(spark, str(tmp_path / "m.json"))
    assert {r["prefix"]: r["ids"] for r in crosswalk.collect()} == {"ORPHA": ["ORPHA:7", "ORPHA:6"], "OMIM": ["OMIM:8"]} and reverse.count() == 3 and names.first()["name"] == "n"
    packet = {"id": "c1", "diseases": [{"term": {"id": "OMIM:1", "label": "X"}}], "phenotypicFeatures": [{"type": {"id": "HP:1", "label": "P"}, "onset": {"age": {"iso8601duration": "P2Y"}}}, {"type": {"id": "HP:2", "label": "Q"}, "excluded": True}]}
    (tmp_path / "p.json").write_text(json.dumps(packet))
    onsets = files.phenopacket_onsets(files.phenopackets(spark, str(tmp_path / "p.json"))).collect()
    assert [(r["phenotype"], r["onset_min"]) for r in onsets] == [("p", 2.0)]
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "1", "body": "b", "type": "list", "documents": ["u/1", "u/2"], "snippets": [{"document": "u/2", "text": "s"}]}, {"id": "2"}]}))
    q = files.questions(spark, str(tmp_path / "q.json")).collect()
    assert [(r["with_snippet"], r["without_snippet"]) for r in q] == [(["2"], ["1"])] and chunks.snippets(files.questions(spark, str(tmp_path / "q.json"))).first()["chunk_id"] == "BIOASQ:1:00"
    (tmp_path / "a.json").write_text(json.dumps({"77": {"QUESTION": "q", "CONTEXTS": ["x", "y"], "final_decision": "Yes"}}))
    assert files.abstracts(spark, str(tmp_path / "a.json")).collect()[0]["decision"] == "yes"
    (tmp_path / "c.yaml").write_text("disease_id: MONDO:1\nis_rare: true\ngenes: [A, B]\n")
    assert files.yaml_documents(spark, str(tmp_path / "c.yaml"), {"disease_id": "string", "genes": "array<string>"}).first()["genes"] == ["A", "B"]


def test_article_xml(spark, tmp_path):
    body = "<PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Journal><JournalIssue><PubDate><Year>2003</Year><Month>Feb</Month></PubDate></JournalIssue><Title>Brain</Title></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='A'>" + "w " * 120 + "</AbstractText></Abstract><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f"<S>{body}{body.replace('w w w', 'w').replace('>5<', '>6<').replace('w ', '')}</S>")
    found = files.articles(spark, str(tmp_path / "a.xml")).collect()
    assert [(r["pmid"], r["publication_date"]) for r in found] == [("5", dt.date(2003, 2, 1))] and found[0]["abstract"].startswith("A: w")
    assert files.articles(spark, str(tmp_path / "a.xml"), filtered=False).count() == 2


def test_sinks(spark, tmp_path):
    edges = edge_rows(spark, [("a1", "disease", "manifests_as", "b1", "phenotype", "2000", None, ["1", "2"], 0.5), ("a1", "odd", "free", "c1", "phenotype", None, None, [], 0.5)])
    nodes, links = sinks.property_graph(edges)
    assert nodes.count() == 4 and {r["type"] for r in links.collect()} == {"DISEASE_PHENOTYPE_POSITIVE", "OTHER"}
    assert sinks.static_rows(edges).orderBy("y_id").first()["source_ids"] == '["1","2"]' and sinks.evidence_nodes(edges).count() == 2 and len(sinks.flat(edges).columns) == 15
    manifest = str(tmp_path / "done")
    assert sinks.finished(spark, manifest).count() == 0
    sinks.mark_finished(spark.createDataFrame([("d1", True, 20), ("d2", True, 5)], "disease_id string, validated boolean, n_consensus long"), manifest)
    wanted = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "disease_id string")
    assert sorted(r[0] for r in evidence.pending(wanted, sinks.finished(spark, manifest)).collect()) == ["d2", "d3"]


def test_quality_pipeline(spark):
    t = raw(spark, [{"subject": "Rett", "object": "seizures", "source_id": "PMID:1"}, {"subject": "Rett", "object": "seizures", "source_id": "PMID:2"}, {"subject": "", "object": "x"}])
    metadata = spark.createDataFrame([("PMID:1", 0.7, "RCT")], "source_id string, score double, study_type string")
    out = pipelines.quality_control(t, metadata, F.lit("2020-01-01").cast("date"))
    assert [(r["n_members"], r["quality_grade"]) for r in out["edges"].collect()] == [(2, "B")] and out["rejects"].count() == 1
    r = out["report"].first()
    assert (r["n_input"], r["n_valid"], r["n_edges"]) == (3, 2, 1)
    assert pipelines.disease_summary(out["edges"]).first()["total"] == 1


def test_extraction_and_answers(spark):
    triple = {"subject": "Rett", "relation": "manifests_as", "object": "seizures", "confidence": "high"}
    outputs = spark.createDataFrame([("d", "m1", json.dumps([triple])), ("d", "m2", json.dumps({"triples": [triple | {"object": "seizure"}]})), ("d", "m1", "junk")], "source_id string, extraction_model string, output string")
    assert pipelines.extraction(outputs).count() == 1
    edges = edge_rows(spark, [("Rett", "disease", "manifests_as", "seizures", "phenotype", "2000", None, ["1"], 0.5)])
    asked = spark.createDataFrame([(1, "does rett cause it"), (2, "zzz")], "question_id int, question string")
    found = {r["question_id"]: r["answer"] for r in pipelines.answer(asked, edges).collect()}
    assert found[1] == "Rett disease_phenotype_positive seizures" and found[2] == "insufficient evidence"


def test_streaming(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    metadata = spark.createDataFrame([("PMID:1", 0.7, "RCT")], "source_id string, score double, study_type string")
    line = {"subject": "Rett", "subject_type": "disease", "relation": "manifests_as", "object": "seizures", "object_type": "phenotype", "confidence": "0.9", "source_id": "PMID:1", "arrived": "2024-01-01T00:00:00"}
    (source / "1.json").write_text("\n".join(json.dumps(x) for x in (line, line, line | {"subject": "A"})))
    streams.run(spark, str(source), metadata, table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 1
    (source / "2.json").write_text("\n".join(json.dumps(x) for x in (line, line | {"object": "ataxia"})))
    streams.run(spark, str(source), metadata, table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_partitioning_changes_nothing(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["alpha beta", "alpha betta", "gamma delta"]), "disease", "manifests_as", rng.choice(["x one", "x onee"]), "phenotype", str(1990 + i % 9), None, [str(i % 7)], 0.1 * (i % 5)) for i in range(30)]
    edges = edge_rows(spark, rows)
    pick = lambda df: sorted(map(str, df.select("ord", "n_members", "evidence").collect()))
    assert pick(consensus.merge_sources(edges, "disease_profile_id")) == pick(consensus.merge_sources(edges.repartition(7, F.rand(3)), "disease_profile_id"))
    assert isinstance(edges.toPandas(), pd.DataFrame)


def test_name_keys(spark):
    assert value(spark, text.disease_key(F.lit("Rett Syndrome"))) == "rett" and value(spark, text.phenotype_key(F.lit("Muscular weakness (HP), mild"))) != ""
    assert value(spark, text.phenotype_key(F.lit("Epilepsy (seizure type)"))) == "seizures" and value(spark, text.phenotype_key(F.lit("Gait-ataxia, severe"))) == "gait_ataxia"
    assert value(spark, text.is_time_label(F.lit("Neonatal onset"))) and not value(spark, text.is_time_label(F.lit("ataxia")))
    df = spark.createDataFrame([("Gowers\u2019  sign.",), (None,)], "n string")
    assert [r["f"] for r in df.select(text.folded(F.col("n")).alias("f")).collect()] == ["gowers sign", None]
    assert value(spark, text.keywords(F.lit("Which of the following has ataxia during early childhood?"))) == ["ataxia", "early", "childhood"]
    assert value(spark, evidence.strategy(F.lit(600), F.lit(1)))["coverage"] == "moderate" and len(value(spark, evidence.queries_for(F.lit("X"), F.array(*map(F.lit, "abcd"))))) == 7


def test_ranked_by_keywords(spark):
    edges = edge_rows(spark, [("Rett", "disease", "manifests_as", "ataxia", "phenotype", None, None, ["1"], 0.5), ("Rett", "disease", "manifests_as", "rash", "phenotype", None, None, ["2"], 0.5)])
    edges = edges.withColumn("temporal", F.col("temporal").withField("onset_age_min", F.when(F.col("ord") == 0, 2.0)))
    asked = spark.createDataFrame([(1, "When does ataxia begin?", "MONDO:1"), (2, "Where is fever?", "MONDO:2")], "question_id int, question string, disease_id string")
    found = graph.keyword_ranked(asked, edges).collect()
    assert [(r["question_id"], r["target_name"], r["score"]) for r in found if r["rank"] == 1] == [(1, "ataxia", 3)]
    assert graph.keyword_ranked(asked, edges, least=9).count() == 0


def test_fuzzy_matching_is_complete(spark, monkeypatch):
    """Against every pair, names without a run of letters in common included."""
    rng = random.Random(3)
    names = ["als2", "al-s2", "abcde", "abxde", "abcdefgh", "abXdeXgh", "abcdefghij", "abXcdXefXghXij", "", "ß é", "é ß"]
    for _ in range(120):
        x = rng.choice(names)
        p = rng.randrange(len(x) + 1)
        names.append(x[:p] + rng.choice(["", "q", "zz", " "]) + x[p + rng.randint(0, 2) :])
    mentions, stock = sorted(set(names[::2])), sorted(set(names[1::2]))
    monkeypatch.setattr(matching, "COMPARED", 16)
    m, n = spark.createDataFrame([(x,) for x in mentions], "mention string"), spark.createDataFrame([(x, i) for i, x in enumerate(stock)], "name string, ord long")
    for least in (75.0, 80.0, 85.0):
        wanted = {(a, b) for a in mentions for b in stock if fuzzy.similarity(a.lower(), b.lower()) >= least}
        found = matching.best_fuzzy(m, n, least, None, token_sort=False).collect()
        assert {(r["mention"], r["name"]) for r in found} == wanted and len(wanted) > 30
        best = {r["mention"]: r["name"] for r in matching.best_fuzzy(m, n, least, 1, token_sort=False).collect()}
        assert best == {a: min((b for b in stock if (a, b) in wanted), key=lambda b: (-fuzzy.similarity(a.lower(), b.lower()), stock.index(b))) for a, _ in wanted}


def test_containing_is_complete(spark):
    names = ["a", "ab", "xaby", "b", "abc", "zabcz", "aab"]
    stock = spark.createDataFrame([(x, x, "", x) for x in names], "name_key string, node_id string, node_type string, node_name string")
    asked = spark.createDataFrame([(x,) for x in ("A", "ab", "by", "zabczz", "q")], "mention string")
    found = {(r["mention"], r["name_key"]) for r in matching.containing(asked, stock, None).collect()}
    assert found == {(m, n) for m in ("A", "ab", "by", "zabczz", "q") for n in names if m.lower() in n or n in m.lower()}
    assert matching.containing(asked, stock, 2).filter("mention = 'A'").count() == 2


def test_containing_ranks_for_each_mention(spark):
    """Two wordings of one name each get their own first names; names that share three letters and no more don't meet."""
    stock = spark.createDataFrame([(x, x, "", x) for x in ("ab1", "ab2", "ab3", "abcdefghij", "abcdefghijk")], "name_key string, node_id string, node_type string, node_name string")
    asked = spark.createDataFrame([("AB",), ("ab",), ("ABCDEFGHIJ",)], "mention string")
    found = sorted((r["mention"], r["rank"], r["name_key"]) for r in matching.containing(asked, stock, 2).collect())
    assert found == [("AB", 1, "ab1"), ("AB", 2, "ab2"), ("ABCDEFGHIJ", 1, "abcdefghij"), ("ABCDEFGHIJ", 2, "abcdefghijk"), ("ab", 1, "ab1"), ("ab", 2, "ab2")]
    assert "abcd" in spark.range(1).select(F.explode(matching.grams(F.lit("xabcd"))).alias("g")).toPandas()["g"].tolist()


def test_confirmation_by_candidates_of_either_end(spark):
    """Candidates of both ends against all pairs, for names that are several nodes, and in both orders."""
    rng = random.Random(3)
    edges = [("r", "", x, "drug", x, "t", y, "disease", y, "t") for x, y in sorted({(str(rng.randrange(300)), str(rng.randrange(60))) for _ in range(60)})]
    rows = [(str(rng.randrange(300)), "r", str(rng.randrange(60)), i) for i in range(200)] + [(e[2], "r", e[6], 200 + i) for i, e in enumerate(edges[:5])]
    nodes = sorted({(n, k) for e in edges for n, k in ((e[2], "drug"), (e[6], "disease"))})
    near = {m: {n for n, _ in [x for x in nodes if m in x[0] or x[0] in m][:10]} for row in rows for m in (row[0], row[2])}
    ahead = {(e[2], e[6]) for e in edges}

    def wanted(x, y):
        if (x, y) in ahead or (y, x) in ahead:
            return "exact", (x, y) not in ahead
        hits = [(a, b) not in ahead for a in near[x] for b in near[y] if (a, b) in ahead or (b, a) in ahead]
        return ("fuzzy_name", min(hits)) if hits else (None, None)

    kg = spark.createDataFrame(edges, model.KG_EDGES)
    for turned in (False, True):
        asked = [(y, r, x, i) if turned else (x, r, y, i) for x, r, y, i in rows]
        found = {r["ord"]: (r["match_type"], r["reversed"]) for r in matching.confirmed(spark.createDataFrame(asked, "subject string, relation string, object string, ord long"), kg).collect()}
        assert found == {i: wanted(x, y) for x, _, y, i in asked}
        assert {v[0] for v in found.values()} == {"exact", "fuzzy_name", None}


def test_linked_within_blocks(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["g", "h", None]), rng.choice(["alpha beta", "beta alpha", "alpha betta", "gamma"]), rng.choice(["one thing", "one thingg", "other"]), [str(rng.randrange(4))]) for i in range(90)]
    df = spark.createDataFrame(rows, "node long, g string, s string, o string, ids array<string>").repartition(3)
    same = lambda a, b: fuzzy.similarity(fuzzy.token_sorted(a), fuzzy.token_sorted(b)) >= 80
    wanted = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and same(a[2], b[2]) and same(a[3], b[3]) and a[4] != b[4]}
    for size in (512, 7):
        found = blocks.linked_within(df, ["g"], "node", ["s", "o", "ids"], consensus.same_claim(80.0, inside=False), size).collect()
        assert {(min(r), max(r)) for r in found} == wanted and len(found) == len(wanted)


def test_same_names_by_table_and_one_by_one(monkeypatch):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    few = fuzzy.same_names(names, 80.0, inside=True)
    monkeypatch.setattr(fuzzy, "FEW", 100)
    assert (fuzzy.same_names(names, 80.0, inside=True) == few).all() and few.sum() > 60


def test_bootstrap_of_repeated_rows(spark):
    rows = [("a", 0.0)] * 300 + [("a", 1.0)] * 300 + [("b", 0.0)] * 8 + [("b", 1.0)] * 8 + [("c", None)]
    found = {r["g"]: r for r in profiles.bootstrap(spark.createDataFrame(rows, "g string, score double"), "g").collect()}
    assert abs(found["a"]["low"] - 0.46) < 0.01 and abs(found["a"]["high"] - 0.54) < 0.01
    assert abs(found["b"]["low"] - 0.25) < 0.05 and abs(found["b"]["high"] - 0.75) < 0.05 and found["b"]["n"] == 16


def test_gold_by_name(spark):
    own = spark.createDataFrame([("Rett syndrome", ["RTT"]), ("Becker dystrophy", [])], "name string, synonyms array<string>")
    gold_ = spark.createDataFrame([("rett syndrome",), ("rtt",), ("becker distrophy",), ("none such",)], "name string")
    assert {r["name"]: r["own_name"] for r in matching.by_name(gold_, own).collect()} == {"rett syndrome": "rett syndrome", "rtt": "rett syndrome", "becker distrophy": "becker dystrophy"}


def test_vocabulary_and_batches(spark):
    rows = [("a1", "disease", "r", p, "phenotype", None, None, ["1"], 0.5) for p in ("Gait ataxia", "gait ataxia", "Gait ataxia", "rash")]
    assert [(r["name"], r["count"]) for r in evidence.vocabulary(edge_rows(spark, rows)).orderBy("ord").collect()] == [("Gait ataxia", 3), ("rash", 1)]
    done = spark.createDataFrame([("x", None, True), ("y", None, False), (None, "late", None)], "result string, error string, kg_coverage boolean")
    assert tuple(evidence.batch_summary(done).first())[:3] == (3, 2, 1)
    paths = spark.createDataFrame([("a/x.json",), ("a/x.json.gz",), ("b/x.json",)], "path string")
    assert sorted(r["path"] for r in evidence.preferred(paths).collect()) == ["a/x.json.gz", "b/x.json"]


def test_studies(spark):
    details = spark.createDataFrame([("d", "a long text of nothing in particular", 1), ("d", "begins at age 3", 2), ("d", "in infancy it shows", 3), ("e", "short", 4), ("f", None, 5)], "disease_id string, evidence_text string, ord long")
    assert [(r["disease_id"], r["ord"]) for r in studies.best_detail(details).collect()] == [("d", 3)]
    runs = spark.createDataFrame([("x", 0.1, 0.0, 1.0), ("x", 0.3, 0.0, 1.0), ("x", None, None, None)], "c string, mrr double, hits_1 double, hits_10 double")
    r = studies.seed_summary(runs, "c").first()
    assert r["n_seeds"] == 2 and r["mrr_mean"] == pytest.approx(0.2) and r["mrr_std"] == pytest.approx(0.1)
    kg = spark.createDataFrame([("1200_1134_1200",), ("5",)], "x_id string")
    assert sorted(r["disease_id"] for r in studies.component_ids(kg).collect()) == ["MONDO:0000005", "MONDO:0001134", "MONDO:0001200"]
    candidates = spark.createDataFrame([(1, "A", "d", "D"), (1, "B", "e", "E"), (1, "C", "f", "F")], "case_id int, letter string, disease string, name string")
    phenotypes = spark.createDataFrame([("d", f"p{i:02d}") for i in range(20)] + [("e", "q")], "disease string, phenotype string")
    windows = spark.createDataFrame([("d", "p01", 1.0, 2.0, 1), ("d", "p01", 5.0, 5.0, 0), ("d", "p00", 3.4, 3.4, 2)], "disease string, phenotype string, onset_min double, onset_max double, ord long")
    c = studies.case_contexts(candidates, phenotypes, windows).first()
    assert len(c["static_context"].split("\n")[0].split(", ")) == 15 and c["static_context"].endswith("C. F: No phenotype data available in this knowledge base")
    assert c["temporal_context"] == "A. D: p00 (onset: 3y), p01 (onset: 5y)\nB. E: Phenotypes: q (no onset age data)\nC. F: No data available"
    facts = spark.createDataFrame([(f"d{i}", f"x{j}") for i in range(12) for j in range(i % 3 + 1)] + [("z", f"y{j}") for j in range(9)], "disease string, item string")
    known = {(r["disease"], r["item"]) for r in facts.collect()}
    asked = studies.static_questions(facts, "drug").collect()
    assert asked and all(len(set(q["options"])) == 4 and [(q["disease"], o) in known for o in q["options"]].count(True) == 1 and q["options"]["ABCD".index(q["letter"])] == q["answer"] for q in asked)
    own = spark.createDataFrame([("d", "D", 1.0, 50.0, 12), ("e", "E", 2.0, 3.0, 1), ("f", "F", 0.0, 3.0, 2)], "disease_id string, name string, onset_min double, onset_max double, n_sources int")
    ref = spark.createDataFrame([(x, "s", 1.0, 10.0) for x in "def"], "disease_id string, source string, ref_min double, ref_max double")
    assert {(r["disease_id"], r["answer"], r["direction"]) for r in studies.extensions(own, ref).collect()} == {("d", "Yes", "older"), ("e", "No", "none")}
    onsets = spark.createDataFrame([("rett", "ataxia", 3, 1.0, 2.5), ("rett", "birth sign", 2, 0.0, 0.05), ("rett", "once", 1, 1.0, 1.0)], "disease string, phenotype string, n_cases int, onset_min double, onset_max double")
    ids = spark.createDataFrame([("Rett", "MONDO:1")], "name string, disease_id string")
    assert {r["answer"] for r in studies.case_questions(onsets, ids).collect()} == {"Age 1.0-2.5 years (from 3 cases).", "At birth / congenital (from 2 cases)."}


def test_line_item_numbers_beyond_a_long(spark):
    """The number is the SQL's in the range of a long; beyond it rows stay apart, in order within a span, and nothing overflows."""
    keys = [(0, 1, 5, 7, 3), (149_999, 7, 19_999, 999, 50), (-3, 1, 5, 7, 3), (1_808_504, 1, 1, 1, 1), (1_808_504, 3, 1_199_999, 59_999, 50), (1_808_504, 4, 0, 0, 0), (1_808_505, 1, 5, 7, 3), (1_808_505, 1, 5, 8, 3), (8_999_999, 7, 1_199_999, 59_999, 50), (9_000_000_000, 1, 5, 7, 3), (1_808_504, 3, 21_000_000, 59_999, 50)]
    rows = spark.createDataFrame([(*k[:4], float(k[4])) for k in keys], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    exact = [(((o * 10 + n) * 1_000_000 + p) * 10_000 + s) * 51 + q for o, n, p, s, q in keys]
    found = [r["x"] for r in rows.coalesce(1).select(tables.ord_().alias("x")).collect()]
    assert found == [v if abs(v) < tables.WRAP else v % tables.WRAP for v in exact]
    assert max(exact) > 2**63 and len(set(found)) == len(keys) and all(v % 50 == x % 50 for v, x in zip(exact, found, strict=True))
    assert rows.limit(1).selectExpr("cast(null as long) l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").select(tables.ord_().alias("x")).first()["x"] is None


@pytest.fixture
def late(spark, tmp_path):
    """Line items on both sides of where ORD_SQL leaves a long, each of one day, relation and pair with another."""
    keys = [(order, n, 1, 2, "RA"[i % 2], i % 2) for i, (order, n) in enumerate((o, n) for o in (1_808_500, 1_808_503, 1_808_506, 1_808_509) for n in (1, 2))]
    spark.createDataFrame([(o, p, s, n, 3.0, 1.0, 0.05, 0.02, f, "O", dt.datetime(1996, 1, 1 + d)) for o, n, p, s, f, d in keys], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "x", "b", "t", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_late_line_items_keep_their_order(spark, late):
    """Of one day the first by ORD_SQL comes first, also where the number no longer fits a long."""
    from kairoscope.queries import questions

    place = questions.phenotype_edges(spark, late).select("ord").orderBy("ord").collect()
    exact = [((((o * 10 + n) * 1_000_000 + 1) * 10_000 + 2) * 51 + 3) for o in (1_808_500, 1_808_503, 1_808_506, 1_808_509) for n in (1, 2)]
    assert [int(r["ord"]) for r in place] == exact


@pytest.mark.parametrize("query", ["q_supersession", "q_reasoning"])
def test_late_line_items_supersede_in_order(spark, late, query):
    """Of one day the first by ORD_SQL is ended, and by the first, also where the number no longer fits a long."""
    from kairoscope.queries import QUERIES

    assert [tuple(r)[:2] for r in QUERIES[query](spark, late).collect()] == [("1808500-1-1-2-3", "1808500-2-1-2-3")]


def test_late_line_items_agree_in_order(spark, late):
    """Of equal triples the first by ORD_SQL is kept, also where the number no longer fits a long."""
    from kairoscope.queries import edges

    lines = spark.read.parquet(f"{late}/lineitem.parquet").withColumns({"l_suppkey": F.col("l_suppkey") + F.col("l_linenumber") % 2, "l_returnflag": F.lit("R"), "l_linenumber": F.lit(4)})
    lines.filter("l_orderkey % 2 = 1").write.parquet(f"{late}/again/lineitem.parquet")
    found = [r["ord"] for r in edges.fuzzy_consensus(spark, f"{late}/again").collect()]
    assert found == [(((1_808_503 * 10 + 4) * 1_000_000 + 1) * 10_000 + 2) * 51 + 3]


def test_wordings_in_another_order_are_compared_once(monkeypatch):
    asked, similarity = [], fuzzy.similarity
    monkeypatch.setattr(fuzzy, "similarity", lambda a, b: asked.append((a, b)) or similarity(a, b))
    found = fuzzy.same_names(["alpha beta", "beta alpha", "alpha betaa", "gamma delta", "delta gamma", ""], 80.0, False)
    assert [[int(x) for x in row] for row in found] == [[1, 1, 1, 0, 0, 0]] * 3 + [[0, 0, 0, 1, 1, 0]] * 2 + [[0, 0, 0, 0, 0, 1]]
    assert len(asked) == 3


def test_edge_json_is_compressed(spark):
    """The export is several hundred bytes an edge, and mostly names of fields."""
    from kairoscope.queries import files as scans

    files_of = scans.QUERIES["q_edge_json"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files_of and all(f.endswith(".gz") for f in files_of)


def test_judged_sample_without_a_limit(spark):
    """The query's SQL has no limit, so the query ranks nothing and keeps every disease, however many there are."""
    from kairoscope.queries import QUERIES

    triples = spark.range(9).select("id", F.lit(3.0).alias("onset_min"), F.lit(4.0).alias("onset_max"), F.lit("evidence of this and that").alias("evidence_text"), F.col("id").alias("ord")).withColumnRenamed("id", "disease_id")
    ref = spark.range(9).select(F.col("id").alias("disease_id"), F.lit(1.0).alias("ref_min"), F.lit(9.0).alias("ref_max"))
    assert studies.judged_sample(triples, ref, n=4).count() == 2
    assert {r["disease_id"] for r in studies.judged_sample(triples, ref, n=None).collect()} == set(range(9))
    plan = QUERIES["q_judged_sample"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rank" not in plan


def test_late_line_items_merge_in_order(spark, late):
    """Of equally credible edges the first by ORD_SQL stays, also where the number no longer fits a long."""
    from kairoscope.queries import edges

    lines = spark.read.parquet(f"{late}/lineitem.parquet").withColumns({"l_returnflag": F.lit("R"), "l_linenumber": F.lit(4), "l_discount": F.lit(0.1)})
    lines.filter("l_orderkey % 2 = 1").write.parquet(f"{late}/merge/lineitem.parquet")
    found = [r["ord"] for r in edges.merge(spark, f"{late}/merge").collect()]
    assert found == [(((1_808_503 * 10 + 4) * 1_000_000 + 1) * 10_000 + 2) * 51 + 3]


def claims(spark):
    rng = random.Random(4)
    names, others = ["alpha beta", "beta alpha", "alpha betta", "gamma delta", ""], ["x one", "x onee", "other"]
    rows = [(rng.choice(names), "disease", rng.choice(["treats", "causes"]), rng.choice(others), "phenotype", None, None, [str(rng.randrange(5))], 0.1 * (i % 5)) for i in range(60)]
    return edge_rows(spark, rows)


@pytest.mark.parametrize("query", ["q_cross_source_merge", "q_consensus"])
def test_small_groups_write_no_pairs(spark, monkeypatch, query):
    """Groups of a few rows are settled in the task that holds them, without tables of pairs and of components."""
    from kairoscope.queries import QUERIES

    def refuse(*_, **__):
        raise AssertionError("pairs of small groups")

    for name in ("linked_within", "components"):
        monkeypatch.setattr(consensus, name, refuse)
    out = QUERIES[query](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "ENSURE_REQUIREMENTS" not in plan and out.count() > 1000


def test_merge_of_small_and_large_groups(spark):
    """Groups beyond `size` are compared in blocks, with the same rows; with one source each and with several."""
    pick = lambda df: sorted(map(str, df.select("ord", "n_members", "evidence").collect()))
    one = claims(spark)
    several = one.withColumn("evidence", F.col("evidence").withField("source_ids", F.when(F.col("ord") % 3 == 0, F.array(F.lit("3"), F.lit("9"))).otherwise(F.col("evidence.source_ids"))))
    for edges in (one, several):
        found = pick(consensus.merge_sources(edges, "disease_profile_id"))
        assert found == pick(consensus.merge_sources(edges, "disease_profile_id", size=3)) and len(found) > 5


def test_consensus_of_small_and_large_groups(spark):
    rows = claims(spark).select(F.col("source_name").alias("subject"), "relation", F.col("target_name").alias("object"), F.col("evidence.source_ids")[0].alias("extraction_model"), F.col("evidence.credibility_score").alias("confidence"), (F.col("ord") % 2).alias("source_id"), "ord")
    rows = rows.withColumn("extraction_model", F.when(F.col("ord") % 7 > 0, F.col("extraction_model")))
    pick = lambda df: sorted(map(str, df.collect()))
    for least in (1, 2):
        found = pick(consensus.consensus(rows, "source_id", least=least))
        assert found == pick(consensus.consensus(rows, "source_id", least=least, size=3)) and len(found) > 5
    assert pick(consensus.consensus(rows)) == pick(consensus.consensus(rows, size=3))
