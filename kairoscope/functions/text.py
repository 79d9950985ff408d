"""Names and texts: normalisers, tests, windows and templates. Java's \\w is ASCII, so patterns carry (?U)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairoscope.model import CARRIERS, MISSING, RELATION_SYNONYMS, TYPE_SYNONYMS, look_up

# Endings that add no meaning to a name, taken off in this order, each once.
NOISE_ENDINGS = (" treatment", " therapy", " supplementation", " administration", " expression", " signaling", " pathway", " level", " levels", "-based", "-mediated")
DOSE = r"(?U)\b\d+\.?\d*\s*(mg|g|kg|ml|µg|iu|u)[\w/]*\b"
PER_TIME = r"(?U)\bper\s+(day|week|month|dose)\b"
BRACKETED = r"\([^)]{1,10}\)"
#: Words that no mention consists of.
QUESTION_WORDS = (
    "the", "a", "an", "in", "of", "for", "and", "or", "is", "are", "was", "were", "with", "what", "when", "which", "who", "how", "does", "do", "have", "has", "been", "be", "this", "that",
    "can", "could", "would", "may", "might", "will", "should", "by", "at", "to", "from", "than", "more", "most", "its", "it", "not", "no", "if", "then", "also", "but", "so", "as", "on",
)


def present(value: Column) -> Column:
    """Not null, blank, or a word for missing."""
    return F.coalesce(~F.lower(F.trim(value.cast("string"))).isin(*MISSING), F.lit(False))


def entity_name(name: Column) -> Column:
    """A name without doses, short brackets, slashes and noise endings; a null name is empty."""
    out = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, DOSE, ""), PER_TIME, ""), BRACKETED, "")
    out = F.replace(out, F.lit("/"), F.lit(" "))
    # One fold over the endings keeps the expression small: a chain of when() would double it at every step.
    endings = F.array(*map(F.lit, NOISE_ENDINGS))
    out = F.aggregate(endings, out, lambda s, e: F.when(F.endswith(s, e) & (F.length(s) > F.length(e) + 3), F.left(s, F.length(s) - F.length(e))).otherwise(s))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def canonical_relation(relation: Column) -> Column:
    """The canonical form of a relation's wording; the first group that knows it wins, others pass."""
    groups: dict[str, str] = {}
    for canonical, variants in RELATION_SYNONYMS.items():
        for v in variants:
            groups.setdefault(v, canonical)
    key = F.lower(F.trim(relation))
    return F.coalesce(look_up(groups, key), key)


def graph_relation(relation: Column) -> Column:
    """Carrier relations as graph relations; free text passes."""
    key = F.lower(F.trim(relation))
    return F.coalesce(look_up(CARRIERS, key), key)


def node_type(kind: Column) -> Column:
    return F.coalesce(look_up(TYPE_SYNONYMS, F.lower(F.trim(kind))), F.lit("phenotype"))


def audit_name(name: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def tokens(name: Column, least: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def audit_match(a: Column, b: Column) -> Column:
    """struct(matched, score) of two names that audit_name() returned: equal 1, contained 0.85, else their words' Jaccard."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    ta, tb = tokens(a, 3), tokens(b, 3)
    shared = F.when((F.size(ta) > 0) & (F.size(tb) > 0), jaccard(ta, tb)).otherwise(0.0)
    inside = (F.length(shorter) >= 4) & F.contains(longer, shorter) & (F.length(shorter) >= 0.4 * F.length(longer))
    score = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, 0.85).otherwise(shared)
    return F.struct((score >= 0.5).alias("matched"), score.alias("score"))


def phenotype_match(a: Column, b: Column, shared_word: float = 0.5) -> Column:
    """Equal 1, one in the other 0.7, a shared word of more than four letters 0.5 (or as given), else 0."""
    long_a, long_b = (F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 4) for x in (a, b))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.7).when(F.arrays_overlap(long_a, long_b), shared_word).otherwise(0.0)


def is_abbreviation(text: Column) -> Column:
    return text.rlike(r"^[A-Z][A-Z0-9]{1,7}$")


def list_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9 ]", " "), r"\s+", " "))


# Endings of disease and phenotype names, and phenotypes that are the same.
DISEASE_ENDINGS = (" syndrome", " disease", " disorder", " (disorder)")
PHENOTYPE_ENDINGS = (", severe", ", mild", ", moderate", ", chronic", ", acute")
PHENOTYPES = {
    "delayed walking": "delayed_motor_milestones", "delayed motor development": "delayed_motor_milestones", "motor delay": "delayed_motor_milestones", "delayed gross motor development": "delayed_motor_milestones",
    "gait delay": "delayed_motor_milestones", "delayed gait": "delayed_motor_milestones", "intellectual disability": "intellectual_disability", "intellectual disabilities": "intellectual_disability",
    "mental retardation": "intellectual_disability", "developmental delay": "developmental_delay", "global developmental delay": "developmental_delay", "muscle weakness": "muscle_weakness", "muscular weakness": "muscle_weakness",
    "proximal muscle weakness": "proximal_weakness", "proximal weakness": "proximal_weakness", "seizure": "seizures", "seizures": "seizures", "epilepsy": "seizures", "convulsions": "seizures",
    "hypotonia": "hypotonia", "muscular hypotonia": "hypotonia", "low muscle tone": "hypotonia",
}
# Names that stand for a time of life and not for a phenotype.
TIME_LABELS = ("symptom onset", "diagnosis", "death", "organ failure", "infant mortality", "age of onset", "onset age", "disease onset", "clinical presentation")
TIME_PATTERN = r"^(neonatal|congenital|prenatal|fetal|birth|newborn|infant(ile|cy|)?|pediatric|childhood|early childhood|late childhood|juvenile|adolescent|young adult|adult|elderly|late[- ]onset|early[- ]onset)\s+(presentation|onset)$"


def _without(name: Column, endings: tuple) -> Column:
    """A name without the endings, taken off in their order, each once."""
    return F.aggregate(F.array(*map(F.lit, endings)), name, lambda s, e: F.when(F.endswith(s, e), F.left(s, F.length(s) - F.length(e))).otherwise(s))


def disease_key(name: Column) -> Column:
    return F.trim(_without(F.lower(F.trim(name)), DISEASE_ENDINGS))


def phenotype_key(name: Column) -> Column:
    """Without a bracket at the end and severity words; the common name of synonyms, else joined by underscores."""
    plain = F.trim(_without(F.trim(F.regexp_replace(F.lower(F.trim(name)), r"\s*\([^)]*\)\s*$", "")), PHENOTYPE_ENDINGS))
    return F.coalesce(look_up(PHENOTYPES, plain), F.regexp_replace(plain, "[ -]", "_"))


def is_time_label(name: Column) -> Column:
    """Labels that must not be merged with others."""
    key = F.lower(F.trim(name))
    return key.isin(*TIME_LABELS) | key.rlike(TIME_PATTERN)


@F.pandas_udf(T.StringType())
def decomposed(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFKD", n))


def folded(name: Column) -> Column:
    """Compatibility-decomposed, lower case, without apostrophes and a mark at the end."""
    low = F.regexp_replace(F.trim(F.lower(decomposed(name))), "['`’]", "")
    return F.regexp_replace(F.regexp_replace(low, r"\s+", " "), "[.,;:]$", "")


def padded_id(text: Column, prefix: str = "MONDO", width: int = 7) -> Column:
    """PREFIX:0001234 of any spelling of the identifier."""
    digits = F.regexp_extract(text, r"(\d+)\s*$", 1)
    return F.when(digits != "", F.concat(F.lit(f"{prefix}:"), F.lpad(digits.try_cast("long").cast("string"), width, "0")))


def unpadded_id(text: Column) -> Column:
    return F.concat(F.regexp_extract(text, r"^([^:_]+)", 1), F.lit(":"), F.regexp_extract(text, r"(\d+)\s*$", 1).try_cast("long").cast("string"))


def folder_id(folder: Column) -> Column:
    return F.regexp_replace(folder, "^([^_]+)_", "$1:")


def safe_id(text: Column, most: int = 64) -> Column:
    return F.left(F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_"), F.lit(most))


def split_ids(text: Column) -> Column:
    """Sorted distinct identifiers of a list separated by bars, commas, semicolons or blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"[|,;\s]+"), lambda x: x != "")))


def strip_tags(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case words, hyphens inside kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w[\w-]*\b"), 0)


def ngrams(found: Column, most: int = 4) -> Column:
    """Windows of `most` down to one word, as text, in that order."""

    def of(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return F.concat(*[of(n) for n in range(most, 0, -1)])


def mentions(question: Column) -> Column:
    """Candidate mentions: windows of one to four words that aren't all stop words or short ones, longest first."""
    stop = F.array(*map(F.lit, QUESTION_WORDS))
    return F.filter(ngrams(words(question)), lambda g: F.exists(F.split(g, " "), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2)))


def topic_entities(text: Column, most: int = 5) -> Column:
    """Up to `most` accession-like or all-capital names, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(r"\b([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-Z][A-Z0-9]{2,9})\b"), 1)
    return F.slice(F.array_distinct(found), 1, most)


# Phrases and words of questions that say nothing of their subject; words of time stay.
FILLERS = ("which of the following", "based on typical", "is most consistent", "what phenotypes are", "rank the following", "is age", "within the typical onset window", "does not typically present")
KEYWORD_STOPS = (
    "the", "and", "for", "with", "from", "this", "that", "have", "has", "are", "was", "were", "been", "being", "their", "which", "what",
    "does", "during", "typically", "following", "clinical", "most", "consistent", "presentation", "typical",
)


def keywords(question: Column) -> Column:
    """Words of more than three letters that say what a question is about."""
    low = F.lower(question)
    for f in FILLERS:
        low = F.replace(low, F.lit(f), F.lit(""))
    stop = F.array(*map(F.lit, KEYWORD_STOPS))
    kept = F.filter(F.split(low, r"\s+"), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, r"^[.,?!()]+|[.,?!()]+$", "")))


def options(letters_to_text: Column) -> Column:
    """A) first, B) second ... of a map, by letter."""
    entries = F.array_sort(F.map_entries(letters_to_text))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
