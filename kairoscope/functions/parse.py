"""Parsing of answers, dates, age phrases and model output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys under which a model may wrap its list.
WRAPPERS = ("triples", "results", "data", "relations", "extractions")
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "yyyyMMdd", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss")
# Words of life stages and their windows, longest word first.
STAGE_WORDS = (("young adulthood", 18.0, 40.0), ("early childhood", 1.0, 5.0), ("adolescence", 10.0, 18.0), ("adulthood", 18.0, 65.0), ("childhood", 1.0, 12.0), ("congenital", 0.0, 0.0), ("neonatal", 0.0, 0.08), ("infancy", 0.08, 1.0), ("at birth", 0.0, 0.0))
UNITS = {"day": 365.25, "week": 52.18, "month": 12.0, "year": 1.0}


def iso_date(text: Column) -> Column:
    """A date from an ISO text or a bare year (its first of January)."""
    year = F.regexp_extract(text, r"^\s*(\d{4})\s*$", 1).try_cast("int")
    return F.coalesce(F.when(year.between(1, 9999), F.make_date(year, F.lit(1), F.lit(1))), F.try_to_timestamp(F.trim(text)).cast("date"))


def any_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in DATE_FORMATS])


def letter(answer: Column, letters: str = "A-E") -> Column:
    """The option letter of an answer: at its start, else after 'answer is', else the first that stands alone."""
    a = F.upper(F.trim(answer))
    found = [F.regexp_extract(a, p, 1) for p in (rf"^\(?([{letters}])\b", rf"ANSWER(?:\s+IS)?[:\s]+\(?([{letters}])\b", rf"\b([{letters}])\b")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def yes_no_maybe(answer: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(answer, r"(?i)\b(yes|no|maybe)\b", 1)), F.lit(""))


def age_range(answer: Column) -> Column:
    """struct(min, max) of the first range of ages in an answer, else of its first single age."""
    low = F.regexp_extract(answer, r"(?i)(\d+\.?\d*)\s*(?:to|-|–|and)\s*(\d+\.?\d*)", 1).try_cast("double")
    high = F.regexp_extract(answer, r"(?i)(\d+\.?\d*)\s*(?:to|-|–|and)\s*(\d+\.?\d*)", 2).try_cast("double")
    single = F.regexp_extract(answer, r"(?i)(\d+\.?\d*)\s*(?:years?|yrs?|y)\b", 1).try_cast("double")
    return F.when(low.isNotNull(), F.struct(low.alias("min"), high.alias("max"))).when(single.isNotNull(), F.struct(single.alias("min"), single.alias("max")))


def age_phrase(text: Column) -> Column:
    """struct(min, max) in years of a phrase: a range with a unit, one age with a unit, a decade, else a stage's word."""
    t = F.lower(text)
    per = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    span, one = r"(\d+\.?\d*)\s*(?:to|-|–|and)\s*(\d+\.?\d*)\s*(day|week|month|year)", r"(\d+\.?\d*)\s*(day|week|month|year)"
    unit, unit1 = F.try_element_at(per, F.regexp_extract(t, span, 3)), F.try_element_at(per, F.regexp_extract(t, one, 2))
    decade = F.coalesce(*[F.when(t.contains(f"{w} decade"), F.lit(10.0 * i)) for i, w in enumerate(("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"))])
    found = [
        F.when(unit.isNotNull(), F.struct((F.regexp_extract(t, span, 1).try_cast("double") / unit).alias("min"), (F.regexp_extract(t, span, 2).try_cast("double") / unit).alias("max"))),
        F.when(unit1.isNotNull(), F.struct((F.regexp_extract(t, one, 1).try_cast("double") / unit1).alias("min"), (F.regexp_extract(t, one, 1).try_cast("double") / unit1).alias("max"))),
        F.when(decade.isNotNull(), F.struct(decade.alias("min"), (decade + 10.0).alias("max"))),
        *[F.when(t.contains(w), F.struct(F.lit(a).alias("min"), F.lit(b).alias("max"))) for w, a, b in STAGE_WORDS],
    ]
    return F.coalesce(*found)


def embedded_json(text: Column, schema: str) -> Column:
    """The first {...} of a text, parsed."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def repaired(text: str | None) -> list[dict]:
    """The records of a model's output: a list, a wrapped list, a single record, or whatever array can be found in it."""
    if not text:
        return []
    body = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", text.strip())
    try:
        value = json.loads(body)
    except ValueError:
        found = re.search(r"\[.*\]", body, re.DOTALL)
        try:
            value = json.loads(found[0]) if found else []
        except ValueError:
            return []
    if isinstance(value, dict):
        lists = [value[k] for k in WRAPPERS if isinstance(value.get(k), list)] or [v for v in value.values() if isinstance(v, list)][:1]
        value = lists[0] if lists and not {"subject", "object"} <= value.keys() else [value] if {"subject", "object"} <= value.keys() else []
    return [r for r in value if isinstance(r, dict)] if isinstance(value, list) else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_records(outputs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Each output's records, as JSON texts."""
    for batch in outputs:
        yield batch.map(lambda t: [json.dumps(r, ensure_ascii=False) for r in repaired(t)])
