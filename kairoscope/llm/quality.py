"""Quality rules: a threshold table compiled into one Spark projection.

Each rule bounds one ratio of a text. The table below is data: compile_rules() turns it into a single boolean
expression over the counts, and base_counts() into one projection over the text; no user function, no shuffle.

Defined results: a null text has no words and is rejected by the base rule; an empty text likewise; repeated rows get
the same verdict; other columns of the input, whatever their names, pass through filter_documents() untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.common import WORD_CHAR, WORD_GAP, let, unused

#: Symbols that prose rarely has.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages in the corpus; prose in any of them holds some of these.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "have", "he", "his", "i", "in", "is", "it", "not", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "we", "were", "with", "you",
    "au", "aux", "ce", "dans", "des", "du", "elle", "en", "est", "et", "il", "je", "la", "le", "les", "mais", "ne", "nous", "ou", "par", "pas", "pour", "qu", "que", "qui", "sur", "un", "une", "vous",
    "aber", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "die", "ein", "eine", "er", "es", "für", "ich", "im", "ist", "mit", "nicht", "sich", "sie", "sind", "und", "von", "wir", "zu",
    "al", "como", "con", "de", "del", "el", "fue", "las", "lo", "los", "no", "o", "para", "pero", "por", "se", "si", "son", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """least <= numerator / denominator <= most; a side that is None is open. A denominator of zero passes."""

    name: str
    numerator: str
    denominator: str
    least: float | None
    most: float | None


#: The threshold table.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, 0.9),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_per_line", "n_words", "n_lines", 2.0, None),
)
#: Base rule of the corpus: fewest words, and the most words in repeated windows, in per cent.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = F.when(
        F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, first, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    def starts(ranked: Column) -> Column:
        found = F.filter(
            F.transform(ranked, lambda x, j: F.when((x["h"] == F.get(ranked, j - 1)["h"]) | (x["h"] == F.get(ranked, j + 1)["h"]), x["i"])), lambda i: i.isNotNull()
        )
        return covered(F.array_sort(found))

    def count(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ranked, starts))

    return let(windows, count)


def base_counts(text: Column) -> Column:
    """A struct of every count that a rule may use, in one expression over the text."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD_CHAR))
        return let(
            lines,
            lambda found: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.regexp_replace(whole, WORD_GAP, "")).cast("long").alias("word_chars"),
                (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
                _repeated(words).cast("long").alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(found).cast("long").alias("n_lines"),
            ),
        )

    return let(F.filter(F.split(whole, WORD_GAP), lambda w: w != ""), of_words)


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def compile_rules(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds. Ratios are compared as products, so that no division rounds."""
    holds = F.lit(True)
    for r in rules:
        top, bottom = counts[r.numerator].cast("double"), counts[r.denominator].cast("double")
        if r.least is not None:
            holds &= top >= bottom * F.lit(float(r.least))
        if r.most is not None:
            holds &= top <= bottom * F.lit(float(r.most))
    return holds


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, every count, base_failed and kept, for each document."""
    counted = docs.select("doc_id", base_counts(F.col("text")).alias("c"))
    c = F.col("c")
    return counted.select("doc_id", "c.*", base_failed(c).alias("base_failed"), (~base_failed(c) & compile_rules(c, rules)).alias("kept"))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    name = unused("counts", docs.columns)
    c = F.col(name)
    return docs.withColumn(name, base_counts(F.col("text"))).filter(~base_failed(c) & compile_rules(c, rules)).drop(name)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in DuckDB's SQL, from the same table of rules."""
    gap = WORD_GAP
    holds = [f"{r.numerator} >= {r.denominator} * {float(r.least)!r}::DOUBLE" for r in rules if r.least is not None]
    holds += [f"{r.numerator} <= {r.denominator} * {float(r.most)!r}::DOUBLE" for r in rules if r.most is not None]
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    symbols = "".join("\\" + c if c in "$*|" else c for c in SYMBOLS)
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '{gap}'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD_CHAR}')) AS l
  FROM base),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM split)),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1)
  GROUP BY r),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{gap}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[{symbols}]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
  FROM split LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(holds)} AS kept
FROM b"""
