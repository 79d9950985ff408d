"""Temporal reasoning over edges: validity, supersession and its application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.model import CONTRADICTORY, SUPERSEDABLE, SUPERSESSION_PHRASES
from kairoscope.operators import quality
from kairoscope.operators.graph import few
from kairoscope.storage import stored

EVENT = ("old_edge_id", "new_edge_id", "reason", "old_discovery_date", "new_discovery_date", "ord")


def inferred_validity(edges: DataFrame) -> DataFrame:
    """validity_start from the discovery date where it isn't set; inferred says where."""
    t = F.col("temporal")
    return edges.withColumn("inferred", t["validity_start"].isNull() & t["discovery_date"].isNotNull()).withColumn("temporal", t.withField("validity_start", F.coalesce(t["validity_start"], t["discovery_date"])))


def _end(edge_id: str, name: str) -> Column:
    return F.lower(F.coalesce(F.nullif(F.col(edge_id), F.lit("")), F.col(name)))


def contradictions(edges: DataFrame, pairs: tuple = CONTRADICTORY) -> DataFrame:
    """Events: the newest edge of the second relation ends the oldest of the first on the same two ends, if it is newer.

    One pass: minima and maxima of (date, ord) for each relation combine on the map side, whatever the pair's size.
    """
    date = F.col("temporal.discovery_date")
    dated = edges.filter(date.isNotNull()).withColumns({"a": _end("source_id", "source_name"), "b": _end("target_id", "target_name"), "d": date})
    firsts, lasts = [], []
    for i, (old, new) in enumerate(pairs):
        firsts.append(F.min(F.when(F.col("relation") == old, F.struct("d", "ord", "edge_id"))).alias(f"old{i}"))
        lasts.append(F.max(F.when(F.col("relation") == new, F.struct("d", (-F.col("ord")).alias("o"), "edge_id"))).alias(f"new{i}"))
    grouped = dated.groupBy("a", "b").agg(*firsts, *lasts)
    events = F.array(*[F.when(F.col(f"new{i}.d") > F.col(f"old{i}.d"), F.struct(F.col(f"old{i}.edge_id").alias("old_edge_id"), F.col(f"new{i}.edge_id").alias("new_edge_id"), F.lit("contradictory").alias("reason"), F.col(f"old{i}.d").alias("old_discovery_date"), F.col(f"new{i}.d").alias("new_discovery_date"), (-F.col(f"new{i}.o")).alias("ord"))) for i in range(len(pairs))])
    return grouped.select(F.explode(F.array_compact(events)).alias("e")).select("e.*")


def updated_treatments(edges: DataFrame) -> DataFrame:
    """Events: a newer treatment of a disease whose evidence speaks of replacement and names the older one's drug."""
    disease = F.when(F.col("source_type") == "disease", _end("source_id", "source_name")).when(F.col("target_type") == "disease", _end("target_id", "target_name"))
    drug = F.lower(F.when(F.col("source_type") == "drug", F.col("source_name")).otherwise(F.col("target_name")))
    treatments = edges.filter(F.col("relation").isin(*SUPERSEDABLE) & F.col("temporal.discovery_date").isNotNull()).select(disease.alias("disease"), drug.alias("drug"), F.col("temporal.discovery_date").alias("d"), "edge_id", "ord", F.lower("evidence.evidence_text").alias("said")).filter("disease IS NOT NULL")
    new = treatments.filter(F.col("said").rlike("|".join(SUPERSESSION_PHRASES))).select("disease", F.col("d").alias("new_d"), F.col("edge_id").alias("new_edge_id"), "said", F.col("ord").alias("new_ord"))
    old = treatments.select("disease", F.col("d").alias("old_d"), F.col("edge_id").alias("old_edge_id"), "drug")
    met = new.join(old, "disease").filter((F.col("old_d") < F.col("new_d")) & (F.col("old_edge_id") != F.col("new_edge_id")) & F.contains("said", "drug"))
    return met.select("old_edge_id", "new_edge_id", F.lit("updated_treatment").alias("reason"), F.col("old_d").alias("old_discovery_date"), F.col("new_d").alias("new_discovery_date"), F.col("new_ord").alias("ord"))


def supersessions(edges: DataFrame) -> DataFrame:
    return contradictions(edges).unionByName(updated_treatments(edges))


def superseded(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges with validity_end and superseded_by of the last event that ends them: updates after contradictions, then by ord.

    An id that several edges share is ended on the first of them. Where few end, no edge is dealt out.
    """
    last = events.groupBy(F.col("old_edge_id").alias("edge_id")).agg(F.max(F.struct((F.col("reason") == "updated_treatment").alias("u"), "ord", "new_edge_id", "new_discovery_date")).alias("x"))
    last = stored(last, "ended")
    n = last.count()
    first = edges.join(few(last.select("edge_id"), n), "edge_id", "left_semi").groupBy("edge_id").agg(F.min("ord").alias("ord"))
    ends = stored(last.join(first, "edge_id").select("ord", F.col("x.new_discovery_date").alias("ended"), F.col("x.new_edge_id").alias("by")), "ends")
    t = F.col("temporal")
    return edges.join(few(ends, n), "ord", "left").withColumn("temporal", t.withField("validity_end", F.coalesce("ended", t["validity_end"])).withField("superseded_by", F.coalesce("by", t["superseded_by"]))).drop("ended", "by")


def reason(edges: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges (with ord) after reasoning, the supersession events and the consistency issues."""
    started = inferred_validity(edges)
    events = supersessions(started)
    done = superseded(started, events)
    return done, events, quality.consistency_issues(done, as_of)


def summary(done: DataFrame, events: DataFrame, issues: DataFrame) -> DataFrame:
    return done.agg(F.count("*").alias("total_edges"), F.count_if("inferred").alias("validity_periods_inferred")).crossJoin(F.broadcast(events.agg(F.count("*").alias("supersessions_detected")))).crossJoin(F.broadcast(issues.agg(F.count("*").alias("consistency_issues"))))


def chronology(edges: DataFrame, *by: str) -> DataFrame:
    """Earliest and latest dated evidence for each key with at least two dated edges."""
    dated = edges.filter("temporal.discovery_date IS NOT NULL")
    d = F.col("temporal.discovery_date")
    return dated.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(d.alias("d"), "ord")).alias("x"), F.max(F.struct(d.alias("d"), (-F.col("ord")).alias("o"))).alias("y")).filter("n >= 2").select(*by, "n", F.col("x.d").alias("first_date"), F.col("y.d").alias("last_date"))
