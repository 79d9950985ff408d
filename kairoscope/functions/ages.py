"""Ages, age windows and years: casts, interval predicates, bins and fits. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut points of the onset bins, (below this midpoint, name), the last name without a bound.
REFINED_BINS = ((0.0, "prenatal"), (0.08, "neonatal"), (2.0, "infantile"), (6.0, "early_childhood"), (12.0, "childhood"), (18.0, "adolescent"), (40.0, "young_adult"), (65.0, "middle_adult"), (None, "elderly"))
LINK_BINS = ((0.1, "neonatal"), (2.0, "infantile"), (12.0, "childhood"), (18.0, "juvenile"), (40.0, "adult"), (65.0, "middle_age"), (None, "late_onset"))
TERM_BINS = ((0.08, "neonatal"), (1.0, "infantile"), (5.0, "early_childhood"), (12.0, "childhood"), (18.0, "juvenile"), (40.0, "young_adult"), (65.0, "adult"), (None, "late_onset"))
YEAR_BINS = ((2000.0, "historical"), (2010.0, "older"), (2020.0, "modern"), (None, "recent"))
# Age windows of onset terms. The two term tables differ on purpose: each belongs to its own analysis.
GOLD_CATEGORIES = {"Antenatal": (0.0, 0.0), "Neonatal": (0.0, 0.08), "Infancy": (0.08, 1.0), "Childhood": (1.0, 5.0), "Adolescent": (10.0, 18.0), "Adult": (15.0, 120.0), "Elderly": (60.0, 120.0), "All ages": (0.0, 120.0)}
CROSSWALK_TERMS = {
    "HP:0030674": (0.0, 0.0), "HP:0003577": (0.0, 0.0), "HP:0003623": (0.0, 0.08), "HP:0003593": (0.08, 1.0), "HP:0011463": (1.0, 5.0),
    "HP:0003621": (5.0, 15.0), "HP:0011462": (15.0, 40.0), "HP:0003584": (15.0, 120.0), "HP:0003581": (40.0, 120.0), "HP:0025708": (60.0, 120.0),
}
BENCHMARK_TERMS = {
    "HP:0030674": (0.0, 0.0), "HP:0034197": (0.0, 0.0), "HP:0034198": (0.0, 0.0), "HP:0034199": (0.0, 0.0), "HP:0011461": (0.0, 0.0), "HP:0025710": (0.0, 0.0), "HP:0003577": (0.0, 0.0),
    "HP:0003623": (0.0, 0.08), "HP:0025709": (0.0, 0.08), "HP:0003593": (0.08, 2.0), "HP:0011463": (1.0, 11.0), "HP:0003621": (5.0, 15.0), "HP:0011462": (15.0, 40.0),
    "HP:0003584": (15.0, 120.0), "HP:0003581": (40.0, 120.0), "HP:0003596": (40.0, 60.0), "HP:0025708": (40.0, 60.0),
}
ONSET_STAGES = (("Antenatal", 0.0, 0.0), ("Neonatal", 0.0, 0.08), ("Infancy", 0.08, 1.0), ("Childhood", 1.0, 5.0), ("Adolescent", 5.0, 15.0), ("Adult", 15.0, 120.0), ("Elderly", 60.0, 120.0))
OLDEST = 120.0


def number(text: Column) -> Column:
    """A double, or null for junk."""
    return F.trim(text.cast("string")).try_cast("double")


def window(low: Column, high: Column) -> Column:
    """struct(min, max) of doubles; a missing max is the min, a missing min makes both null."""
    least = number(low)
    return F.when(least.isNotNull(), F.struct(least.alias("min"), F.coalesce(number(high), least).alias("max")))


def plausible(*ages: Column) -> Column:
    holds = F.lit(True)
    for a in ages:
        holds &= a.between(0, OLDEST)
    return holds


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return (a_min <= b_max) & (a_max >= b_min)


def contained(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """The first window lies within the second."""
    return (a_min >= b_min) & (a_max <= b_max)


def narrower(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return (a_max - a_min) < (b_max - b_min)


def all_ages(low: Column, high: Column) -> Column:
    return (low == 0) & (high >= 100)


def admits(low: Column, high: Column, age: Column) -> Column:
    """Only a window with both bounds can exclude an age."""
    return low.isNull() | high.isNull() | age.between(low, high)


def binned(value: Column, bins: tuple) -> Column:
    """The name of the first bin whose upper bound lies above the value."""
    out = None
    for below, name in bins[:-1]:
        out = F.when(value < below, name) if out is None else out.when(value < below, name)
    return F.when(value.isNotNull(), out.otherwise(bins[-1][1]))


def onset_bin(low: Column, high: Column, broad: float = 60.0) -> Column:
    """The refined bin of a window's midpoint; windows wider than `broad` years are uninformative."""
    return F.when(high - low > broad, "broad_range").otherwise(binned((low + high) / 2, REFINED_BINS))


def link_bin(low: Column, high: Column, bins: tuple = LINK_BINS) -> Column:
    """The bin of a window's midpoint; a missing or zero upper bound counts as the lower one."""
    return binned((low + F.coalesce(F.nullif(high, F.lit(0.0)), low)) / 2, bins)


def term_window(term: Column, terms: dict) -> Column:
    """struct(min, max) of an onset term, null if the table doesn't have it."""
    low, high = ({k: v[i] for k, v in terms.items()} for i in (0, 1))
    return F.when(term.isin(*terms), F.struct(F.try_element_at(_map(low), term).alias("min"), F.try_element_at(_map(high), term).alias("max")))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def year_bin(year: Column) -> Column:
    return binned(year.cast("double"), YEAR_BINS)


def stage_index(age: Column) -> Column:
    """Position of the first stage that holds the age; the last one if none does."""
    out = None
    for i, (_, low, high) in enumerate(ONSET_STAGES):
        out = F.when(age.between(low, high), i) if out is None else out.when(age.between(low, high), i)
    return out.otherwise(len(ONSET_STAGES) - 1)


def readable(age: Column) -> Column:
    months = F.format_string("%.0f months", F.bround(age * 12, 0))
    return (
        F.when(age < 0, "the prenatal period")
        .when(age < 0.08, "the neonatal period")
        .when(age < 0.5, F.concat((age * 12).cast("int").cast("string"), F.lit(" months")))
        .when(age < 1, months)
        .when(age < 2, F.format_string("%.1f years", age))
        .when(age.isNotNull(), F.concat(age.cast("int").cast("string"), F.lit(" years")))
    )


def iso_years(text: Column) -> Column:
    """Years of an ISO-8601 duration of years, months, weeks and days, to four places; null if it doesn't begin with P."""
    parts = r"^P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, parts, i).try_cast("double"), F.lit(0.0))

    return F.when(text.startswith("P"), F.bround(part(1) + part(2) / 12 + part(3) * 7 / 365.25 + part(4) / 365.25, 4))


def onset_window(onset: Column, terms: dict = CROSSWALK_TERMS) -> Column:
    """struct(min, max) of an onset struct: its ontology class, else its age, else its age range."""
    age = iso_years(onset["age"]["iso8601duration"])
    start, end = iso_years(onset["ageRange"]["start"]["iso8601duration"]), iso_years(onset["ageRange"]["end"]["iso8601duration"])
    return F.coalesce(
        term_window(onset["ontologyClass"]["id"], terms),
        F.when(age.isNotNull(), F.struct(age.alias("min"), age.alias("max"))),
        F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("min"), end.alias("max"))),
    )


def gap(low: Column, high: Column, age: Column) -> Column:
    """Years between an age and a window's nearer end; zero inside."""
    return F.when(age.between(low, high), 0.0).otherwise(F.least(F.abs(age - low), F.abs(age - high)))


def fit(low: Column, high: Column, age: Column, steps: tuple = ((0.0, 1.0), (3.0, 0.5), (8.0, 0.25)), beyond: float = 0.1) -> Column:
    """How well an age fits a window: the value of the first step that reaches the gap."""
    out, g = None, gap(low, high, age)
    for years, value in steps:
        out = F.when(g <= years, value) if out is None else out.when(g <= years, value)
    return out.otherwise(beyond)


#: Variants of the fit: published cases and the first simulation.
CASE_STEPS = ((0.0, 1.0), (2.0, 0.7), (5.0, 0.4))
FIRST_STEPS = ((0.0, 1.0), (5.0, 0.5), (10.0, 0.25))


def year_of(text: Column, least: int = 1900, most: int = 2026) -> Column:
    year = F.substring(F.trim(text.cast("string")), 1, 4).try_cast("int")
    return F.when(year.between(least, most), year)


# Fixed values: (first identifier, year there, years until the next).
IDENTIFIER_YEARS = ((1_000_000, 1970, 30, 9_000_000), (10_000_000, 2000, 10, 10_000_000), (20_000_000, 2010, 8, 10_000_000), (30_000_000, 2018, 8, 10_000_000))


def identifier_year(identifier: Column) -> Column:
    """A publication year for an ascending literature identifier, linear between known points."""
    n = F.regexp_extract(identifier, r"(\d{6,9})", 1).try_cast("long")
    out = F.when(n < IDENTIFIER_YEARS[0][0], IDENTIFIER_YEARS[0][1])
    for first, year, years, width in IDENTIFIER_YEARS:
        out = out.when(n < first + width, year + F.floor((n - first) / F.lit(float(width)) * years).cast("int"))
    return out.when(n.isNotNull(), 2025)
