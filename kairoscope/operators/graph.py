"""Graph retrieval over an edge table: adjacency, bounded breadth-first search, entity resolution, patient subgraphs, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import ages, scores, text
from kairoscope.operators import matching
from kairoscope.operators.ranks import numbered
from kairoscope.storage import stored

#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000


def few(counted: DataFrame, n: int) -> DataFrame:
    """A table of n rows, broadcast if they are few."""
    return F.broadcast(counted) if n <= BROADCAST_ROWS else counted


def ends(edges: DataFrame, *columns: str) -> DataFrame:
    """entity for both ends of each edge, lower-cased, once each, and columns of the edge."""
    return edges.select(F.explode(F.array_distinct(F.array(F.lower("source_name"), F.lower("target_name")))).alias("entity"), *columns).filter("entity IS NOT NULL")


def adjacency(edges: DataFrame) -> DataFrame:
    """(entity, edge_id) for both ends, lower-cased, once each."""
    return ends(edges, "edge_id").distinct()


def by_source(edges: DataFrame) -> DataFrame:
    """(source_id, edge_id): which edges a document supports."""
    return edges.select(F.explode("evidence.source_ids").alias("document"), "edge_id").filter("document <> ''").distinct()


def latest(edges: DataFrame) -> DataFrame:
    """One edge for each id, the last by ord.

    Ids are counted by their hashes first: where few occur twice, only the edges with those are dealt out and ordered.
    """
    ordered = lambda e: e.withColumn("last", F.row_number().over(Window.partitionBy("edge_id").orderBy(F.desc("ord")))).filter("last = 1").drop("last")
    key = F.xxhash64("edge_id")
    often = stored(edges.groupBy(key.alias("often")).agg(F.count("*").alias("n")).filter("n > 1").select("often"), "often")
    if (n := often.count()) > BROADCAST_ROWS:
        return ordered(edges)
    repeated = few(often, n)
    return edges.join(repeated, key == F.col("often"), "left_anti").unionByName(ordered(edges.join(repeated, key == F.col("often"), "left_semi")))


def reached(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(entity, hops) within `depth` hops of the seeds; links is (entity, neighbour), both ways.

    Each level is one join of the frontier, less what was seen; levels are tables, so lineage doesn't grow with depth.
    """
    seen = frontier = stored(seeds.select("entity").distinct().withColumn("hops", F.lit(0)), "frontier")
    for hop in range(1, depth + 1):
        step = links.join(frontier.select("entity"), "entity").select(F.col("neighbour").alias("entity")).distinct()
        frontier = stored(step.join(seen.select("entity"), "entity", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def links_of(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.lower("source_name").alias("a"), F.lower("target_name").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = ends.select(F.col("a").alias("entity"), F.col("b").alias("neighbour")).unionByName(ends.select(F.col("b").alias("entity"), F.col("a").alias("neighbour")))
    return both.filter("entity <> neighbour").distinct()


def incident(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with either end among the entities."""
    ids = adjacency(edges).join(entities.select("entity").distinct(), "entity", "left_semi").select("edge_id").distinct()
    return edges.join(ids, "edge_id", "left_semi")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """All edges of every entity within `depth` hops; their other ends may lie one hop further."""
    return incident(edges, reached(links_of(edges), seeds, depth))


def resolve(mentions: DataFrame, edges: DataFrame, kg_names: DataFrame | None = None, normalised: DataFrame | None = None) -> DataFrame:
    """mention -> entity of the graph: its own name, else its normalised name, else the first static name that holds or is
    held by it and is in the graph, else the first entity that holds it."""
    entities = stored(ends(edges).distinct(), "entities")
    asked = mentions.select("mention").distinct().withColumn("entity", F.lower("mention"))
    found = asked.join(entities, "entity", "left_semi").select("mention", "entity")
    for stage in (normalised, kg_names):
        if stage is None:
            continue
        rest = asked.join(found.select("mention"), "mention", "left_anti").select("mention")
        if stage is normalised:
            hits = rest.join(normalised.select("mention", F.lower("node_name").alias("entity")), "mention")
        else:
            hits = matching.containing(rest, kg_names).select("mention", F.col("name_key").alias("entity"))
        found = found.unionByName(hits.join(entities, "entity", "left_semi").groupBy("mention").agg(F.min("entity").alias("entity")))
    rest = asked.join(found.select("mention"), "mention", "left_anti").select("mention")
    stock = entities.select(F.col("entity").alias("name_key"), F.lit("").alias("node_id"), F.lit("").alias("node_type"), F.col("entity").alias("node_name"))
    partial = matching.containing(rest, stock, None).filter(F.contains("name_key", F.lower("mention"))).groupBy("mention").agg(F.min("name_key").alias("entity"))
    return found.unionByName(partial)


def ranked(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Edges with score and rank: half credibility, three tenths consensus, two tenths grade; ties by edge_id."""
    e = F.col("evidence")
    scored = edges.withColumn("score", scores.rerank(e["credibility_score"], e["consensus_confidence"], F.col("quality_grade")))
    order = F.desc("score"), F.col("edge_id")
    return numbered(scored, "rank", *order) if most is None else scored.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def cited(edges: DataFrame) -> DataFrame:
    return by_source(edges).select("document").distinct()


def retrieve(questions: DataFrame, edges: DataFrame, depth: int = 2, most: int | None = None, kg_names: DataFrame | None = None) -> DataFrame:
    """question_id -> ranked edges around what a question (question_id, question) mentions.

    Questions without an entity, or whose entities have no edge, come back once with insufficient_evidence.
    """
    e = F.col("evidence")
    score = scores.rerank(e["credibility_score"], e["consensus_confidence"], F.col("quality_grade"))
    unique = stored(latest(edges.select("edge_id", "ord", "source_name", "target_name", score.alias("score"))).drop("ord"), "edges")
    asked = questions.select("question_id", F.explode(text.mentions(F.col("question"))).alias("mention")).distinct()
    frontier = stored(asked.join(resolve(asked, unique, kg_names), "mention").select("question_id", "entity").distinct(), "frontier")
    seen, n = frontier, [frontier.count()]
    for _ in range(depth):
        # One edge's ends, each with the other: no table of all links is made, as the frontier leaves few of them.
        met = ends(unique, "source_name", "target_name").join(few(frontier, n[-1]), "entity")
        step = met.select("question_id", F.explode(F.array(F.lower("source_name"), F.lower("target_name"))).alias("entity")).filter("entity IS NOT NULL").distinct()
        frontier = stored(step.join(seen, ["question_id", "entity"], "left_anti"), "frontier")
        n.append(frontier.count())
        if not n[-1]:
            break
        seen = seen.unionByName(frontier)
    found = ends(unique, "edge_id", "score").join(few(seen, sum(n)), "entity").select("question_id", "edge_id", "score").distinct()
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "edge_id")))
    if most is not None:
        found = found.filter(F.col("rank") <= most)
    found = stored(found, "found")
    # Whole edges are only read for what was found.
    ids = stored(found.select("edge_id").distinct(), "ids")
    whole = latest(edges.drop("score", "rank").join(few(ids, ids.count()), "edge_id", "left_semi"))
    columns = [F.col(f"`{c}`") for c in whole.columns if c != "edge_id"]
    met = whole.join(found, "edge_id").select("question_id", "edge_id", *columns, "score", "rank")
    return questions.select("question_id").join(met, "question_id", "left").withColumn("insufficient_evidence", F.col("edge_id").isNull())


def patient_subgraph(seeds: DataFrame, edges: DataFrame, age: float | None = None, depth: int = 1) -> DataFrame:
    """Edges around a patient's symptoms, findings and risks (entity), without those whose window excludes the age."""
    t = F.col("temporal")
    near = neighbourhood(edges, seeds, depth)
    return near if age is None else near.filter(ages.admits(t["onset_age_min"], t["onset_age_max"], F.lit(age)))


def both_directions(edges: DataFrame, name: Column, most: int) -> DataFrame:
    """Up to most // 2 outgoing and as many incoming edges of an entity, by edge_id."""
    out = edges.filter(F.lower("source_name") == F.lower(name)).orderBy("edge_id").limit(most // 2).withColumn("direction", F.lit("out"))
    into = edges.filter(F.lower("target_name") == F.lower(name)).orderBy("edge_id").limit(most // 2).withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def disease_subgraph(kg: DataFrame, node_id: Column) -> DataFrame:
    return kg.filter((F.col("x_id") == node_id) | (F.col("y_id") == node_id))


def profile(kg: DataFrame, kind: str = "disease") -> DataFrame:
    """For each node of a kind: edges, distinct relations and a histogram of its neighbours' types."""
    side = lambda a, b: kg.filter(F.col(f"{a}_type") == kind).select(F.col(f"{a}_id").alias("node_id"), F.col(f"{b}_type").alias("neighbour_type"), "relation")
    both = side("x", "y").unionByName(side("y", "x"))
    by_type = both.groupBy("node_id", "neighbour_type").agg(F.count("*").alias("n"), F.collect_set("relation").alias("r"))
    return by_type.groupBy("node_id").agg(F.sum("n").alias("n_edges"), F.size(F.array_distinct(F.flatten(F.collect_list("r")))).alias("n_relations"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("neighbour_type", "n")))).alias("neighbour_types"))


def neighbours(kg: DataFrame) -> DataFrame:
    """(node_id, relation) -> sorted distinct neighbour names."""
    side = lambda a, b: kg.select(F.col(f"{a}_id").alias("node_id"), "relation", F.col(f"{b}_name").alias("name"))
    return side("x", "y").unionByName(side("y", "x")).groupBy("node_id", "relation").agg(F.array_sort(F.collect_set("name")).alias("names"))


def chains(edges: DataFrame) -> DataFrame:
    """Gene -> disease -> treatment, where the treatment was found later; year_gap says by how much."""
    d = F.col("temporal.discovery_date")
    dated = edges.filter(d.isNotNull()).withColumn("year", F.year(d))
    genes = dated.filter((F.col("source_type") == "gene/protein") & (F.col("target_type") == "disease")).select(F.lower("target_name").alias("disease"), F.col("source_name").alias("gene"), F.col("year").alias("gene_year"))
    drugs = dated.filter((F.col("source_type") == "drug") & (F.col("target_type") == "disease")).select(F.lower("target_name").alias("disease"), F.col("source_name").alias("treatment"), F.col("year").alias("treatment_year"))
    return genes.join(drugs, "disease").withColumn("year_gap", F.col("treatment_year") - F.col("gene_year")).filter("year_gap > 0")


def integer_ids(edges: DataFrame, seed: int = 42) -> DataFrame:
    """Distinct (head, relation, tail) with dense ids by name and a split of 80/10/10 by hash."""
    distinct = edges.select(F.col("source_name").alias("head"), "relation", F.col("target_name").alias("tail")).distinct()
    entity = numbered(distinct.select(F.explode(F.array("head", "tail")).alias("name")).distinct(), "id", "name").withColumn("id", F.col("id") - 1)
    relation = numbered(distinct.select("relation").distinct(), "relation_id", "relation").withColumn("relation_id", F.col("relation_id") - 1)
    place = F.pmod(F.xxhash64("head", "relation", "tail", F.lit(seed)), F.lit(10))
    joined = distinct.join(entity.select(F.col("name").alias("head"), F.col("id").alias("head_id")), "head").join(entity.select(F.col("name").alias("tail"), F.col("id").alias("tail_id")), "tail").join(relation, "relation")
    return joined.withColumn("split", F.when(place < 8, "train").when(place < 9, "valid").otherwise("test"))


def temporal_relations(edges: DataFrame) -> DataFrame:
    """Three labellings of each phenotype edge: plain, by onset bin, by onset bin and evidence bin; no loops, no blanks."""
    t = F.col("temporal")
    stage = ages.link_bin(t["onset_age_min"], t["onset_age_max"])
    era = ages.year_bin(F.year(t["discovery_date"]))
    kept = edges.filter(text.present(F.col("source_name")) & text.present(F.col("target_name")) & (F.lower("source_name") != F.lower("target_name")))
    labels = F.array(F.struct(F.lit("static").alias("condition"), F.col("relation").alias("label")), F.struct(F.lit("stage").alias("condition"), F.concat_ws("__", "relation", stage).alias("label")), F.struct(F.lit("stage_year").alias("condition"), F.concat_ws("__", "relation", stage, era).alias("label")))
    return kept.select(F.lower("source_name").alias("head"), F.lower("target_name").alias("tail"), F.explode(labels).alias("l")).select("l.condition", "head", F.col("l.label").alias("relation"), "tail").distinct()


def link_metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """Mean reciprocal rank and hits at 1, 3 and 10."""
    return ranks.groupBy(*by).agg(F.avg(1 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in (1, 3, 10)])


def keyword_ranked(questions: DataFrame, edges: DataFrame, most: int = 15, least: int = 2, bonuses: bool = True) -> DataFrame:
    """question_id -> the best edges of its diseases by how many of its keywords they hold, and by their time.

    A stated onset counts two more, a stage and a qualifier one each. A question whose best edge scores less than `least`
    has none. questions is (question_id, question, disease_id).
    """
    t = F.col("temporal")
    asked = questions.select("question_id", "disease_id", text.keywords(F.col("question")).alias("keywords"))
    met = asked.join(edges, asked["disease_id"] == edges["disease_profile_id"])
    said = F.lower(F.concat_ws(" ", "source_name", "target_name", "relation", F.to_json("temporal")))
    score = F.size(F.filter("keywords", lambda k: F.contains(said, k)))
    if bonuses:
        score = score + F.when(t["onset_age_min"].isNotNull(), 2).otherwise(0) + text.present(t["progression_stage"]).cast("int") + text.present(t["temporal_qualifier"]).cast("int")
    by = Window.partitionBy("question_id")
    ranked_ = met.withColumn("score", score).withColumns({"rank": F.row_number().over(by.orderBy(F.desc("score"), "edge_id")), "best": F.max("score").over(by)})
    return ranked_.filter((F.col("rank") <= most) & (F.col("best") >= least)).drop("best", "keywords")


def bullet(source: Column, relation: Column, target: Column, said: Column) -> Column:
    """An edge as a line of a prompt, with the start of what its evidence says."""
    snippet = F.when(F.coalesce(said, F.lit("")) != "", F.concat(F.lit(" ["), F.left(said, F.lit(80)), F.lit("]"))).otherwise("")
    return F.concat(F.lit("- "), F.coalesce(source, F.lit("?")), F.lit(" → "), F.replace(F.coalesce(relation, F.lit("?")), F.lit("_"), F.lit(" ")), F.lit(" → "), F.coalesce(target, F.lit("?")), snippet)
