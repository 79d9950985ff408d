"""Scores and statistics as column expressions: credibility, percentages, answer metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairoscope.model import STUDY_WEIGHTS, look_up

# Signal weights, journal tiers and journals in order of lookup.
WEIGHTS = {"journal_tier": 0.15, "citation_velocity": 0.15, "study_type": 0.25, "replication_status": 0.15, "retraction_status": 0.15, "llm_consensus": 0.15}
JOURNAL_TIERS = {"Q1": 1.0, "Q2": 0.75, "Q3": 0.5, "Q4": 0.25, "preprint": 0.15, "unknown": 0.3}
JOURNALS = (
    ("The New England journal of medicine", "Q1"), ("Lancet", "Q1"), ("Nature medicine", "Q1"), ("Nature genetics", "Q1"), ("Nature", "Q1"), ("Science", "Q1"), ("JAMA", "Q1"), ("BMJ", "Q1"),
    ("Annals of neurology", "Q1"), ("Brain", "Q1"), ("Neurology", "Q1"), ("The Lancet. Neurology", "Q1"), ("Nature reviews. Neurology", "Q1"), ("Nature machine intelligence", "Q1"),
    ("Genome research", "Q1"), ("American journal of human genetics", "Q1"), ("Genetics in medicine", "Q1"), ("npj digital medicine", "Q1"),
    ("Neuromuscular disorders", "Q2"), ("Muscle & nerve", "Q2"), ("Journal of neurology, neurosurgery, and psychiatry", "Q2"), ("Journal of neurology", "Q2"), ("European journal of neurology", "Q2"),
    ("Orphanet journal of rare diseases", "Q2"), ("Human mutation", "Q2"), ("Human molecular genetics", "Q2"), ("Molecular therapy", "Q2"), ("Gene therapy", "Q2"), ("Scientific data", "Q2"),
)
TIER1_SIGNALS = {"journal_tier": 1.0, "citation_velocity": 0.8, "study_type": 0.85, "replication_status": 0.9, "retraction_status": 1.0, "llm_consensus": 1.0}


def journal_score(journal: Column) -> Column:
    """The tier of the first known journal whose name holds the given one or is held by it; then preprints; then unknown."""
    name = F.lower(F.trim(journal))
    known = F.array(*[F.struct(F.lit(n.lower()).alias("n"), F.lit(JOURNAL_TIERS[t]).alias("s")) for n, t in JOURNALS])
    first = F.get(F.filter(known, lambda j: F.contains(name, j["n"]) | F.contains(j["n"], name)), F.lit(0))["s"]
    return F.when(F.coalesce(journal, F.lit("")) == "", JOURNAL_TIERS["unknown"]).otherwise(F.coalesce(first, F.when(name.rlike("biorxiv|medrxiv|arxiv|preprint"), JOURNAL_TIERS["preprint"]), F.lit(JOURNAL_TIERS["unknown"])))


def citation_velocity(citations: Column, published: Column, as_of: Column) -> Column:
    """Citations a year, in three linear pieces; a count of zero or a missing date scores zero."""
    v = citations / F.greatest(F.lit(0.5), F.datediff(as_of, published) / 365.25)
    score = F.when(v >= 50, F.least(F.lit(1.0), 0.9 + (v - 50) / 500)).when(v >= 5, 0.5 + (v - 5) / 45 * 0.4).otherwise(v / 5 * 0.5)
    return F.when((citations > 0) & published.isNotNull(), score).otherwise(0.0)


def study_score(study_type: Column) -> Column:
    return F.coalesce(look_up(STUDY_WEIGHTS, study_type), F.lit(STUDY_WEIGHTS["other"]))


def weighted(signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of signals, held to 0..1, to four places (half even)."""
    total = F.lit(0.0)
    for name, w in (weights or WEIGHTS).items():
        total = total + F.lit(w) * signals[name]
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def credibility(study_type: Column, consensus: Column, journal: Column | None = None, citations: Column | None = None, published: Column | None = None, retracted: Column | None = None, replication: Column | None = None, as_of: Column | None = None) -> Column:
    """The credibility of a source from six signals; what isn't given has its neutral value."""
    none = F.lit(None)
    return weighted(
        {
            "journal_tier": journal_score(none.cast("string") if journal is None else journal),
            "citation_velocity": F.lit(0.0) if citations is None else citation_velocity(citations, published, F.current_date() if as_of is None else as_of),
            "study_type": study_score(study_type),
            "replication_status": F.lit(0.5) if replication is None else replication,
            "retraction_status": F.lit(1.0) if retracted is None else F.when(retracted, 0.0).otherwise(1.0),
            "llm_consensus": consensus,
        }
    )


def tier1_credibility() -> Column:
    return weighted({k: F.lit(v) for k, v in TIER1_SIGNALS.items()})


def rerank(credibility: Column, consensus: Column, grade: Column) -> Column:
    return credibility * 0.5 + consensus * 0.3 + F.when(grade == "A", 1.0).otherwise(0.5) * 0.2


def percentage(part: Column, whole: Column, places: int = 2) -> Column:
    return F.coalesce(F.bround(F.try_divide(100 * part, F.nullif(whole, F.lit(0))), places), F.lit(0.0))


def grade(ratio: Column) -> Column:
    return F.when(ratio >= 0.9, "A").when(ratio >= 0.7, "B").otherwise("C")


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets of strings."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (shared > 0), 2.0 * shared / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))).otherwise(0.0)


def plain_words(text: Column) -> Column:
    """Words without punctuation, lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", ""), r"\s+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_distinct(F.filter(pairs, lambda g: g.isNotNull()))


def rouge2(answer: Column, gold: Column) -> Column:
    return set_f1(bigrams(plain_words(answer)), bigrams(plain_words(gold)))


def token_f1(answer: Column, gold: Column) -> Column:
    return set_f1(F.array_distinct(plain_words(answer)), F.array_distinct(plain_words(gold)))


def macro_f1(predicted: Column, gold: Column, labels: tuple = ("yes", "no", "maybe")) -> Column:
    """An aggregate: the mean over labels of their F1."""
    total = F.lit(0.0)
    for label in labels:
        hit, said, true = (F.count_if(c) for c in ((predicted == label) & (gold == label), predicted == label, gold == label))
        total = total + F.when(said + true > 0, 2.0 * hit / (said + true)).otherwise(0.0)
    return total / len(labels)


def index_quantile(values: Column, numerator: int, denominator: int = 4) -> Column:
    """An aggregate: the element at floor(numerator * n / denominator) of the sorted values, without interpolation."""
    held = F.array_sort(F.collect_list(values))
    return F.get(held, F.floor(F.lit(numerator) * F.size(held) / denominator).cast("int"))
