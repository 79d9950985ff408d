"""Agreement between extractors and merging across sources: blocked fuzzy joins, distributed components, argmax merges.

Triples are compared within (document, relation), edges within (profile, relation). Rows with equal names are one variant,
and only variants are compared, so a claim that many rows make word for word costs no pairs. Groups of up to BLOCK rows are
settled where they meet: one row of each cluster comes out, and neither pairs nor components are written. Larger groups are
compared block by block (operators/blocks.py), and only links are emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairoscope.functions import fuzzy, text
from kairoscope.operators.blocks import BLOCK, linked_within
from kairoscope.operators.components import components
from kairoscope.storage import stored

SAME = 80.0
#: What settled() compares: both names, and the sources (or models) of which no two may be the same.
CLAIM = ("claim_s", "claim_o", "claim_ids")
PER_SOURCE = 0.33


def clustered(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (with ord) and cluster: the smallest ord that pairs (a, b) of ords connect them to."""
    roots = components(pairs)
    return rows.join(roots, rows["ord"] == roots["node"], "left").withColumn("cluster", F.coalesce("root", "ord")).drop("node", "root")


def same_claim(least: float, inside: bool) -> Callable:
    """A test of rows (s, o, ids): both names are alike and no source is in both."""
    same = same_rows(least, inside)
    return lambda columns: same(*[column.to_pylist() for column in columns])


def same_rows(least: float, inside: bool) -> Callable:
    same_names = fuzzy.same_names  # the function alone travels, not its module

    def test(s: list[str], o: list[str], ids: list[list[str] | None]) -> np.ndarray:
        table = np.ones((len(ids), len(ids)), dtype=bool)
        for names in (s, o):
            number: dict[str, int] = {}
            at = [number.setdefault(x, len(number)) for x in names]
            table &= same_names(list(number), least, inside)[np.ix_(at, at)]
        for x, y in zip(*np.nonzero(np.triu(table, 1)), strict=True):
            if ids[x] and ids[y] and not set(ids[x]).isdisjoint(ids[y]):
                table[x, y] = table[y, x] = False
        return table

    return test


def labels_of(same: Callable) -> Callable:
    """A function that numbers the clusters of one group's rows (s, o, ids); rows without s are apart.

    As in clusters(), equal names are one node, unless rows come with several ids, which are compared one by one.
    """

    def label(s: list[str | None], o: list[str], ids: list[list[str] | None]) -> list[int]:
        if len(s) == 1:
            return [0]
        named = [i for i, x in enumerate(s) if x is not None]
        several = any(ids[i] and len(ids[i]) > 1 for i in named)
        number: dict = {}
        at = [number.setdefault(i if several else (s[i], o[i]), len(number)) for i in named]
        first = [0] * len(number)
        tags: list[set] = [set() for _ in number]
        for i, node in zip(named, at, strict=True):
            first[node] = i
            tags[node].add(ids[i][0] if ids[i] else ("row", i))
        linked = [len(x) > 1 for x in tags]
        if len(number) > 1:
            asked = [ids[i] if several or (not many and ids[i]) else [] for i, many in zip(first, linked, strict=True)]
            ends = np.nonzero(np.triu(same([s[i] for i in first], [o[i] for i in first], asked), 1))
        else:
            ends = ((), ())
        parent = list(range(len(number)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(*map(list, ends), strict=True):
            linked[x] = linked[y] = True
            parent[find(x)] = find(y)
        out = list(range(len(number), len(number) + len(s)))  # a row that nothing links is its own
        for i, node in zip(named, at, strict=True):
            if linked[node]:
                out[i] = find(node)
        return out

    return label


def parted(rows: DataFrame, block: list[str], size: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to `size` rows, and those of larger ones, if there are any."""
    large = stored(rows.groupBy(*block).agg(F.count("*").alias("n")).filter(F.col("n") > size).select(*[F.col(c).alias(f"v_{c}") for c in block]), "large")
    if not large.head(1):
        return rows, None
    equal = F.lit(True)
    for c in block:
        equal &= F.col(c).eqNullSafe(F.col(f"v_{c}"))
    return rows.join(large, equal, "left_anti"), rows.join(large, equal, "left_semi")


def settled(rows: DataFrame, block: list[str], order: list[Column], gathered: list[str], same: Callable) -> DataFrame:
    """The first row (by order) of each cluster of rows with CLAIM's columns, with claim_n (its rows) and the union of each of
    its `gathered` arrays in their place.

    A group's rows are in one task, in that order; rows that are dealt out by some of block already aren't dealt out again.
    """
    kept = [c for c in rows.columns if c not in (*CLAIM, *gathered)]
    begins = (F.row_number().over(Window.partitionBy(*block).orderBy(*order)) == 1).alias("begins")
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("claim_n", T.LongType()), *[T.StructField(c, T.ArrayType(T.StringType())) for c in gathered]])
    label, width = labels_of(same), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            here = here if left is None else pa.concat_tables([left, here])
            at = np.flatnonzero(here.column("begins").to_numpy())
            if len(at) > 1:
                yield from settle(here.slice(0, at[-1]), at).to_batches()
                here = here.slice(at[-1])
            left = here
        if left is not None and left.num_rows:
            yield from settle(left, np.array([0, left.num_rows])).to_batches()

    def settle(table: pa.Table, at: np.ndarray) -> pa.Table:
        s, o, ids = (table.column(width + i).to_pylist() for i in range(3))
        values = [ids if c == "claim_ids" else table.column(c).to_pylist() for c in gathered]
        first, n, unions = [], [], [[] for _ in gathered]
        at = at.tolist()
        for x, y in zip(at, at[1:], strict=False):
            members: dict[int, list[int]] = {}
            for i, cluster in enumerate(label(s[x:y], o[x:y], ids[x:y]), x):
                members.setdefault(cluster, []).append(i)
            for own in members.values():
                first.append(own[0])
                n.append(len(own))
                for union, value in zip(unions, values, strict=True):
                    found = {v for i in own for v in value[i] or ()}
                    blank = [None] if None in found else []
                    union.append(sorted(found.difference(blank)) + blank)
        out = table.select(range(width)).take(pa.array(first, pa.int64()))
        out = out.append_column("claim_n", pa.array(n, pa.int64()))
        for c, union in zip(gathered, unions, strict=True):
            out = out.append_column(c, pa.array(union, pa.list_(pa.string())))
        return out.combine_chunks()

    return rows.select(*kept, *CLAIM, *[c for c in gathered if c not in CLAIM], begins).mapInArrow(run, schema)


def clusters(rows: DataFrame, block: list[str], least: float = SAME, inside: bool = False) -> DataFrame:
    """(ord, cluster) of rows (block, s, o, tag, ord): rows of one block link if their tags differ and both names are the same.

    All rows of a variant (equal names) link as soon as it has two tags, or links to another variant: then each of its rows
    has a partner with another tag. So variants are the nodes, and a variant of one tag that links to none leaves its rows
    apart.
    """
    variants = stored(rows.groupBy(*block, "s", "o").agg(F.min("ord").alias("rep"), F.min("tag").alias("low"), F.max("tag").alias("high")), "variants")
    tagged = variants.withColumn("ids", F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array().cast("array<string>")))
    pairs = stored(linked_within(tagged, block, "rep", ["s", "o", "ids"], same_claim(least, inside)), "pairs")
    touched = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("linked", F.lit(True))
    roots = components(pairs).select(F.col("node").alias("rep"), "root")
    labelled = variants.join(touched, "rep", "left").join(roots, "rep", "left").filter((F.col("low") != F.col("high")) | F.col("linked"))
    label = labelled.select(*[F.col(c).alias(f"v_{c}") for c in (*block, "s", "o")], F.coalesce("root", "rep").alias("label"))
    equal = F.lit(True)
    for c in (*block, "s", "o"):
        equal &= F.col(c).eqNullSafe(F.col(f"v_{c}"))
    return rows.join(label, equal, "left").select("ord", F.coalesce("label", "ord").alias("cluster"))


def consensus(triples: DataFrame, *block: str, least: int = 2, first: str = "ord", size: int = BLOCK) -> DataFrame:
    """One triple for each cluster on which `least` models agree: the most confident, then the longest named, then the first
    (by the column `first`, where ord only tells triples apart).

    Its confidence becomes the share of the block's models that agree; its relation keeps its wording. Triples of one model
    may meet in a cluster by way of another's. Groups of more than `size` triples are compared in blocks.
    """
    model, group = F.col("extraction_model"), [*block, "claim_r"]
    named = triples.withColumns({"claim_r": text.canonical_relation(F.col("relation")), "claim_s": text.entity_name(F.col("subject")), "claim_o": text.entity_name(F.col("object"))})
    named = named.withColumns({"claim_s": F.when((F.col("claim_s") != "") & (F.col("claim_o") != ""), F.col("claim_s")), "claim_ids": F.array(F.coalesce(model, F.lit(""))), "extraction_models": F.array_compact(F.array(model))})
    few, many = parted(named, group, size)
    best = [F.col("confidence").cast("double"), F.length("subject") + F.length("object"), -F.col(first)]
    found = settled(few, group, [x.desc_nulls_last() for x in best], ["extraction_models"], same_rows(SAME, inside=True)).drop("claim_n")
    if many is not None:
        held = stored(many.drop("extraction_models"), "triples")
        linked = clusters(held.filter("claim_s IS NOT NULL").select(*group, "ord", F.col("claim_ids")[0].alias("tag"), F.col("claim_s").alias("s"), F.col("claim_o").alias("o")), group, inside=True)
        every = held.join(linked, "ord", "left").withColumn("cluster", F.coalesce("cluster", "ord"))
        kept = every.groupBy(*block, "cluster").agg(F.array_sort(F.collect_set("extraction_model")).alias("extraction_models"), F.max_by("ord", F.struct(*best)).alias("ord"))
        found = found.unionByName(held.join(kept.select("ord", "extraction_models"), "ord").select(*found.columns))
    agreed = found.withColumn("n_models", F.size("extraction_models").cast("long")).filter(F.col("n_models") >= least)
    models = triples.groupBy(*block).agg(F.count_distinct("extraction_model").alias("n_block_models"))
    met = agreed.join(stored(models, "models"), list(block)) if block else agreed.crossJoin(F.broadcast(models))
    share = (F.col("n_models") / F.col("n_block_models")).alias("confidence")
    return met.select("ord", *[share if c == "confidence" else c for c in triples.columns if c != "ord"], "n_models", "extraction_models")


def third_model_needed(counts: DataFrame, first: str, second: str) -> DataFrame:
    """Whether each document needs the tie-breaking model: one of the two found nothing, or over five times as much as the other."""
    n = counts.groupBy("source_id").agg(F.count_if(F.col("extraction_model") == first).alias("n_first"), F.count_if(F.col("extraction_model") == second).alias("n_second"))
    low, high = F.least("n_first", "n_second"), F.greatest("n_first", "n_second")
    return n.withColumn("needs_third", ((low == 0) & (high > 0)) | (high > 5 * low))


def merge_pairs(edges: DataFrame, *block: str) -> DataFrame:
    """Pairs of ords of edges of one relation, from different sources, whose names are alike."""
    keyed = edges.select(*block, "ord", "relation", F.coalesce(F.lower("source_name"), F.lit("")).alias("s"), F.coalesce(F.lower("target_name"), F.lit("")).alias("o"), F.col("evidence.source_ids").alias("ids"))
    return linked_within(keyed, [*block, "relation"], "ord", ["s", "o", "ids"], same_claim(SAME, inside=False))


def with_members(own: Column, n: Column, ids: Column, models: Column) -> Column:
    """The evidence of a cluster's best edge, with all sources and models: consensus is its own or a third for each member,
    whichever is more, up to one."""
    shared = own.withField("source_ids", ids).withField("extraction_models", models).withField("consensus_confidence", F.greatest(own["consensus_confidence"], F.least(F.lit(1.0), n * PER_SOURCE)))
    return F.when(n > 1, shared).otherwise(own).alias("evidence")


def merged(clusters: DataFrame, first: str = "ord") -> DataFrame:
    """One edge for each cluster: the most credible (the first of equals), with_members()."""
    columns = [c for c in clusters.columns if c != "cluster"]
    e = F.col("evidence")
    agg = clusters.groupBy("cluster").agg(
        F.max_by(F.struct(*columns), F.struct(e["credibility_score"], -F.col(first))).alias("best"),
        F.count("*").alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(e["source_ids"])))).alias("ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(e["extraction_models"])))).alias("models"),
    )
    evidence = with_members(F.col("best.evidence"), F.col("n"), F.col("ids"), F.col("models"))
    return agg.select(*[evidence if c == "evidence" else F.col(f"best.{c}").alias(c) for c in columns], F.col("n").alias("n_members"))


def merge_sources(edges: DataFrame, *block: str, first: str = "ord", size: int = BLOCK) -> DataFrame:
    """Edges (with ord) of which those that claim the same from different sources have become one, the first (by the column
    `first`) of the most credible.

    Edges that come with several sources each are compared one by one, as they may overlap without being equal. Groups of
    more than `size` edges are compared in blocks.
    """
    e, group = F.col("evidence"), [*block, "relation"]
    keyed = edges.withColumns({"claim_s": F.coalesce(F.lower("source_name"), F.lit("")), "claim_o": F.coalesce(F.lower("target_name"), F.lit("")), "claim_ids": e["source_ids"], "claim_models": e["extraction_models"]})
    few, many = parted(keyed, group, size)
    best = [e["credibility_score"], -F.col(first)]
    found = settled(few, group, [x.desc_nulls_last() for x in best], ["claim_ids", "claim_models"], same_rows(SAME, inside=False))
    evidence = with_members(e, F.col("claim_n"), F.col("claim_ids"), F.col("claim_models"))
    out = found.select(*[evidence if c == "evidence" else c for c in edges.columns], F.col("claim_n").alias("n_members"))
    return out if many is None else out.unionByName(_merge_large(many.select(*edges.columns), group, first))


def _merge_large(edges: DataFrame, group: list[str], first: str) -> DataFrame:
    held = stored(edges, "edges")
    if held.filter(F.size("evidence.source_ids") > 1).head(1):
        return merged(clustered(held, merge_pairs(held, *group[:-1])), first)
    tag = F.coalesce(F.get("evidence.source_ids", F.lit(0)), F.concat(F.lit("row "), F.col("ord").cast("string")))
    named = held.select(*group, "ord", tag.alias("tag"), F.coalesce(F.lower("source_name"), F.lit("")).alias("s"), F.coalesce(F.lower("target_name"), F.lit("")).alias("o"))
    return merged(held.join(clusters(named, group), "ord"), first)


def consolidated(edges: DataFrame) -> DataFrame:
    """Edges with the same id as one, by the same policy as merge_sources()."""
    return merged(edges.withColumn("cluster", F.min("ord").over(Window.partitionBy("edge_id"))))


def majority(votes: DataFrame, *by: str, verdict: str = "verdict", least: int = 2) -> DataFrame:
    """The verdict that `least` judges share (more votes first, then by name), else DISAGREE."""
    n = votes.groupBy(*by, verdict).count()
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(verdict).alias("v"))).alias("x"))
    return best.select(*by, F.when(-F.col("x.n") >= least, F.col("x.v")).otherwise("DISAGREE").alias("verdict"))


def canonical_by_count(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, canonical): each component's most frequent name; names has name, ord and count."""
    found = clustered(names, pairs)
    top = found.groupBy("cluster").agg(F.max_by("name", F.struct("count", -F.col("ord"))).alias("canonical"), F.count("*").alias("size"))
    return found.join(top, "cluster").select("name", "canonical", "size")

