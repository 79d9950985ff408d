"""Alignment with a static graph and name resolution: staged joins, each stage on what the one before left over.

Substring stages are blocked by runs of letters, fuzzy ones compare blocks of mentions with blocks of names; neither misses a
candidate. Candidates are ranked by name and id, so "first" is the same on every run.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import fuzzy, text
from kairoscope.model import LOOKUP_TYPES, key_of, look_up
from kairoscope.storage import stored

CANDIDATES = 10
#: Mentions, and names, that are compared at once.
COMPARED = 4096
#: Letters of the shorter name that substring stages block by: with fewer, long tables meet far more names than hold each other.
RUN = 8


def nodes(kg: DataFrame) -> DataFrame:
    """Distinct nodes (id, type, name, source) of both sides of a static graph."""
    side = lambda p: kg.select(*[F.col(f"{p}_{c}").alias(f"node_{c}") for c in ("id", "type", "name", "source")])
    return side("x").unionByName(side("y")).dropDuplicates(["node_id", "node_type"])


def names(kg: DataFrame) -> DataFrame:
    """name_key -> node, for each distinct name; ord by id and type."""
    return nodes(kg).withColumn("name_key", key_of(F.col("node_name")))


def lookup_type(kind: Column) -> Column:
    key = key_of(kind)
    return F.coalesce(look_up(LOOKUP_TYPES, key), key)


def resolved(mentions: DataFrame, graph_names: DataFrame) -> DataFrame:
    """mention, mention_type (nullable) -> every node with that name and, if one is asked for, that type."""
    asked = mentions.withColumns({"name_key": key_of(F.col("mention")), "asked": lookup_type(F.col("mention_type"))})
    return asked.join(graph_names, "name_key").filter(F.col("asked").isNull() | (F.col("asked") == F.col("node_type"))).drop("asked")


def grams(name: Column) -> Column:
    """The distinct runs of one to RUN letters of a name."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name))), lambda i: F.transform(F.array(*map(F.lit, range(1, RUN + 1))), lambda n: F.substr(name, i, n)))))


def containing(mentions: DataFrame, graph_names: DataFrame, most: int | None = CANDIDATES) -> DataFrame:
    """mention -> the first `most` names that hold it or that it holds, by name and id; all of them without `most`.

    Blocked by the first RUN letters of the shorter name (all of it, if it has fewer), which are in the longer one: each
    mention probes with its own against all runs of the names, and each name with its own against the mention's.
    """
    asked = mentions.select("mention", key_of(F.col("mention")).alias("m")).distinct().filter("m <> ''")
    stock = graph_names.select("name_key", "node_id", "node_type", "node_name").distinct().filter("name_key <> ''")
    first = lambda c: F.substr(c, F.lit(1), F.lit(RUN))
    held = asked.withColumn("g", first(F.col("m"))).join(stock.withColumn("g", F.explode(grams(F.col("name_key")))), "g").filter(F.contains("name_key", "m"))
    holds = asked.withColumn("g", F.explode(grams(F.col("m")))).join(stock.withColumn("g", first(F.col("name_key"))), "g").filter(F.contains("m", "name_key") & (F.col("m") != F.col("name_key")))
    found = held.drop("g").unionByName(holds.drop("g"))  # equal names are in the first only, so each pair is there once
    if most is None:
        return found.drop("m")
    rank = F.row_number().over(Window.partitionBy("mention").orderBy("name_key", "node_id", "node_type"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).drop("m")


def cascade_lookup(mentions: DataFrame, graph_names: DataFrame) -> DataFrame:
    """mention, mention_type -> node_id, node_name, confidence, method: typed exact 1, exact 0.95, contained (5 letters or more) 0.7, else unresolved 0.

    Of several nodes the last by id wins an exact stage, the first name by spelling the contained one.
    """
    asked = mentions.select("mention", "mention_type").distinct().withColumns({"name_key": key_of(F.col("mention")), "asked": lookup_type(F.col("mention_type"))})
    typed = graph_names.groupBy("name_key", F.col("node_type").alias("asked")).agg(F.max(F.struct("node_id", "node_name")).alias("typed"))
    anywhere = graph_names.groupBy("name_key").agg(F.max(F.struct("node_id", "node_name")).alias("anywhere"))
    exact = asked.join(typed, ["name_key", "asked"], "left").join(anywhere, "name_key", "left")
    rest = exact.filter("typed IS NULL AND anywhere IS NULL AND length(name_key) >= 5")
    inside = containing(rest, graph_names, None).filter(F.contains("name_key", key_of(F.col("mention")))).groupBy("mention").agg(F.min(F.struct("name_key", "node_id", "node_name")).alias("part"))
    all_ = exact.join(inside, "mention", "left")
    hit = F.coalesce("typed", "anywhere", F.struct("part.node_id", "part.node_name"))
    confidence = F.when(F.col("typed").isNotNull(), 1.0).when(F.col("anywhere").isNotNull(), 0.95).when(F.col("part").isNotNull(), 0.7).otherwise(0.0)
    method = F.when(confidence >= 0.95, "dictionary").when(confidence > 0.5, "dictionary_partial").otherwise("unresolved")
    return all_.select("mention", "mention_type", hit["node_id"].alias("node_id"), hit["node_name"].alias("node_name"), confidence.alias("confidence"), method.alias("method"))


def normalised(mentions: DataFrame, graph_names: DataFrame, linked: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """Entity normalisation in stages: dictionary (0.95 or more), embedding (0.85), judge (candidate 0.6, judge 0.7), partial dictionary, unresolved.

    linked (mention, link_id, link_name, link_score) and judged (mention, judge_id, judge_name, judge_score) come from
    pluggable stages; without them those stages find nothing.
    """
    found = cascade_lookup(mentions, graph_names)
    for extra, prefix in ((linked, "link"), (judged, "judge")):
        if extra is not None:
            best = extra.groupBy("mention").agg(F.max_by(F.struct(f"{prefix}_id", f"{prefix}_name", f"{prefix}_score"), f"{prefix}_score").alias(prefix))
            found = found.join(best, "mention", "left")
        else:
            found = found.withColumn(prefix, F.lit(None).cast(f"struct<{prefix}_id: string, {prefix}_name: string, {prefix}_score: double>"))
    by_link = F.col("link.link_score") >= 0.85
    by_judge = (F.col("link.link_score") >= 0.6) & (F.col("judge.judge_score") >= 0.7)
    sure = F.col("confidence") >= 0.95
    pick = lambda own, link, judge: F.when(sure, own).when(by_link, link).when(by_judge, judge).otherwise(own)
    return found.select(
        "mention", "mention_type", pick(F.col("node_id"), F.col("link.link_id"), F.col("judge.judge_id")).alias("node_id"), F.coalesce(pick(F.col("node_name"), F.col("link.link_name"), F.col("judge.judge_name")), F.trim("mention")).alias("node_name"),
        F.round(pick(F.col("confidence"), F.col("link.link_score"), F.col("judge.judge_score")), 6).alias("confidence"), pick(F.col("method"), F.lit("embedding"), F.lit("llm")).alias("method"),
    )


def resolution_rate(found: DataFrame) -> DataFrame:
    return found.groupBy("method").agg(F.count("*").alias("n"), F.avg((F.col("method") != "unresolved").cast("int")).alias("resolved"))


def fuzzy_hits(rest: DataFrame, pair: DataFrame, stock: DataFrame) -> DataFrame:
    """x, y and near_reversed of the pairs of names (x, y) of which candidates of both ends are an edge; pair is (x, y, pair_reversed, back), both ways.

    What the candidates of one end lead to is worked out once for each name, so that a pair meets the other end's few
    candidates and never all pairs of both. It is the end that leads to less.
    """
    mentions = rest.select(F.explode(F.array("x", "y")).alias("mention")).distinct()
    near = stored(containing(mentions, stock).select("mention", F.col("name_key").alias("name")).distinct(), "near")  # a name may be several nodes
    edge = stored(pair.select(F.col("x").alias("name"), F.col("y").alias("other"), F.col("pair_reversed").alias("ahead"), "back"), "linked")
    degree = stored(edge.groupBy("name").agg(F.count("*").alias("n")), "degree")
    ends = {c: stored(near.join(rest.select(F.col(c).alias("mention")).distinct(), "mention", "left_semi"), "near") for c in ("x", "y")}
    leads = {c: ends[c].join(degree, "name").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for c in ("x", "y")}
    far, own = ("y", "x") if leads["y"] <= leads["x"] else ("x", "y")
    way = "back" if far == "y" else "ahead"
    to = stored(ends[far].join(edge, "name").groupBy(F.col("mention").alias(far), F.col("other").alias("c")).agg(F.min(way).alias("r")), "reached")
    tried = rest.join(ends[own].select(F.col("mention").alias(own), F.col("name").alias("c")), own)
    return tried.join(to, [far, "c"]).groupBy("x", "y").agg(F.min("r").alias("near_reversed"))


def confirmed(triples: DataFrame, kg: DataFrame, fuzzy_stage: bool = True) -> DataFrame:
    """Triples (with ord, subject, relation, object) with match_type: exact, same_relation or fuzzy_name, and whether the static edge is reversed; null if none.

    Exact: same names and relation. same_relation: same names, any relation. fuzzy_name: among the first ten names that
    hold or are held by each end, some pair is an edge. In each stage the stored order is tried before the reversed one.
    """
    edge = kg.select(key_of(F.col("x_name")).alias("x"), F.lower(F.trim("relation")).alias("r"), key_of(F.col("y_name")).alias("y"))
    both = edge.withColumn("reversed", F.lit(False)).unionByName(edge.select(F.col("y").alias("x"), "r", F.col("x").alias("y"), F.lit(True).alias("reversed")))
    exact = both.groupBy("x", "r", "y").agg(F.min("reversed").alias("exact_reversed"))
    pair = both.groupBy("x", "y").agg(F.min("reversed").alias("pair_reversed"), (~F.max("reversed")).alias("back"))  # back: the same of (y, x)
    asked = triples.withColumns({"x": key_of(F.col("subject")), "r": F.lower(F.trim("relation")), "y": key_of(F.col("object"))})
    staged = asked.join(exact, ["x", "r", "y"], "left").join(pair.drop("back"), ["x", "y"], "left")
    if fuzzy_stage:
        rest = stored(staged.filter("exact_reversed IS NULL AND pair_reversed IS NULL").select("x", "y").distinct(), "rest")
        hits = fuzzy_hits(rest, pair, names(kg))
        staged = staged.join(hits, ["x", "y"], "left")
    else:
        staged = staged.withColumn("near_reversed", F.lit(None).cast("boolean"))
    kind = F.when(F.col("exact_reversed").isNotNull(), "exact").when(F.col("pair_reversed").isNotNull(), "same_relation").when(F.col("near_reversed").isNotNull(), "fuzzy_name")
    return staged.withColumns({"match_type": kind, "reversed": F.coalesce("exact_reversed", "pair_reversed", "near_reversed")}).drop("x", "r", "y", "exact_reversed", "pair_reversed", "near_reversed")


def best_fuzzy(mentions: DataFrame, stock: DataFrame, least: float, most: int | None = 1, token_sort: bool = True) -> DataFrame:
    """mention -> the `most` names of stock (name, ord) that are most similar, at `least` or more (all, without `most`); ties to the first.

    No key is shared by all names of such similarity, so every mention meets every name: both sides are dealt in blocks, two
    of which are compared in one place, and only what reaches `least` comes out, `most` spellings a mention and block at most.
    """
    form = fuzzy.sorted_tokens if token_sort else (lambda c: c)
    m = stored(mentions.select("mention").distinct().withColumn("m", form(F.lower("mention"))).filter("m IS NOT NULL"), "mentions")
    n = stored(stock.select("name", "ord").withColumn("n", form(F.lower("name"))).filter("n IS NOT NULL"), "names")
    left, right = m.select("m").distinct(), n.groupBy("n").agg(F.min("ord").alias("ord"))
    sizes = [max(1, -(-x.count() // COMPARED)) for x in (left, right)]
    deal = lambda x, c, i: x.withColumn(f"block{i}", F.pmod(F.xxhash64(c), F.lit(sizes[i])).cast("int")).withColumn(f"block{1 - i}", F.explode(F.sequence(F.lit(0), F.lit(sizes[1 - i] - 1))))

    reaching = fuzzy.reaching  # the function alone travels, not its module

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a["m"].tolist(), b.sort_values("ord")
        found = pd.DataFrame(reaching(a, b["n"].tolist(), least), columns=["i", "j", "score"])
        if most is not None:
            found = found.sort_values(["i", "score", "j"], ascending=[True, False, True]).groupby("i").head(most)
        return pd.DataFrame({"m": [a[i] for i in found["i"]], "n": b["n"].to_numpy()[found["j"].to_numpy(dtype="int64")], "score": found["score"].astype("float64")})

    blocked = deal(left, "m", 0).groupBy("block0", "block1").cogroup(deal(right, "n", 1).groupBy("block0", "block1"))
    scored = blocked.applyInPandas(compare, "m string, n string, score double").join(m, "m").join(n, "n")
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "ord"))
    ranked = scored.withColumn("rank", rank)
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).select("mention", "name", "score", "rank")


def matched_concepts(mentions: DataFrame, concepts: DataFrame, semantic: DataFrame | None = None, most: int = 5) -> DataFrame:
    """mention -> concepts (cui, score, method): exact name 1, abbreviation 0.95, fuzzy 0.8 or more, semantic 0.7 or more.

    concepts has cui, name, aliases. An exact hit ends the search for its mention; each concept counts once, with its best score.
    """
    spelled = concepts.select("cui", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling"))
    keyed = spelled.withColumn("k", key_of(F.col("spelling")))
    asked = mentions.select("mention").distinct().withColumn("k", key_of(F.col("mention")))
    exact = asked.join(keyed, "k").select("mention", "cui", F.lit(1.0).alias("score"), F.lit("exact").alias("method")).distinct()
    rest = asked.join(exact.select("mention").distinct(), "mention", "left_anti")
    abbreviated = rest.filter(text.is_abbreviation(F.col("mention"))).join(spelled, F.col("mention") == F.upper("spelling")).select("mention", "cui", F.lit(0.95).alias("score"), F.lit("abbreviation").alias("method"))
    stock = spelled.select(F.col("spelling").alias("name")).distinct().withColumn("ord", F.xxhash64("name"))
    near = []
    for sort in (False, True):
        near.append(best_fuzzy(rest, stock, 80.0, None, sort))
    close = near[0].unionByName(near[1]).join(spelled, F.col("name") == F.col("spelling")).select("mention", "cui", F.round(F.col("score") / 100, 4).alias("score"), F.lit("fuzzy").alias("method"))
    found = exact.unionByName(abbreviated).unionByName(close)
    if semantic is not None:
        found = found.unionByName(rest.join(semantic, "mention").filter("score >= 0.7").select("mention", "cui", "score", F.lit("semantic").alias("method")))
    best = found.groupBy("mention", "cui").agg(F.max(F.struct("score", "method")).alias("x")).select("mention", "cui", "x.score", "x.method")
    rank = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "cui"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most)


def first_listed(left: DataFrame, crosswalk: DataFrame, gold: DataFrame, key: str = "disease_id") -> DataFrame:
    """left joined with the first of its crosswalk ids (ids, in order) that gold (gold_id) has."""
    listed = crosswalk.select(key, F.posexplode("ids").alias("pos", "gold_id"))
    hits = listed.join(gold.select("gold_id").distinct(), "gold_id", "left_semi")
    first = hits.groupBy(key).agg(F.min_by("gold_id", "pos").alias("gold_id"))
    return left.join(first, key).join(gold, "gold_id")


def by_name(gold: DataFrame, own: DataFrame, least: float = 85.0) -> DataFrame:
    """gold name -> own name (name, synonyms): equal, else a synonym, else the most similar at `least` or more."""
    asked = gold.select(key_of(F.col("name")).alias("k")).distinct()
    names = own.select(key_of(F.col("name")).alias("own_name"), "synonyms")
    exact = asked.join(names, asked["k"] == names["own_name"]).select("k", "own_name")
    spelled = names.select("own_name", F.explode("synonyms").alias("s")).join(names.select(F.col("own_name").alias("s")), "s", "left_anti")
    rest = asked.join(exact, "k", "left_anti")
    synonym = rest.join(spelled, rest["k"] == F.lower("s")).groupBy("k").agg(F.max("own_name").alias("own_name"))
    left = rest.join(synonym, "k", "left_anti").select(F.col("k").alias("mention"))
    stock = names.select(F.col("own_name").alias("name")).distinct().withColumn("ord", F.xxhash64("name"))
    near = best_fuzzy(left, stock, least).select(F.col("mention").alias("k"), F.col("name").alias("own_name"))
    return exact.unionByName(synonym).unionByName(near).select(F.col("k").alias("name"), "own_name")
