"""Texts into chunks: paragraph windows, headed sections and character budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fewest words of a section and of a window.
SECTION_WORDS, WINDOW_WORDS = 20, 15
CHUNK = "chunk_id string, source_type string, source_name string, section_heading string, text string, char_start int, char_end int"
#: Strategy by a part of the source's name; window, step, budget and overlap are its parameters.
STRATEGIES = {"default": {"kind": "paragraphs", "window": 3, "step": 2}, "sections": {"kind": "headings"}, "budget": {"kind": "characters", "budget": 1200, "overlap": 200}}


def paragraphs(docs: DataFrame) -> DataFrame:
    """name, at, paragraph, start: runs of non-blank lines, joined by spaces, with the offset of their first character."""
    lines = docs.select("name", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    by_line = Window.partitionBy("name").orderBy("line_no")
    placed = lines.withColumn("line", F.rtrim(F.replace("line", F.lit("\r"), F.lit("")))).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    blank = F.trim("line") == ""
    grouped = placed.withColumn("g", F.sum(blank.cast("int")).over(by_line)).filter(~blank)
    joined = grouped.groupBy("name", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("paragraph"), F.min("start").alias("start"))
    return joined.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("g")) - 1).select("name", "at", "paragraph", "start")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _numbered(chunks: DataFrame, order: str, kind: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("name").orderBy(order)) - 1
    return chunks.withColumn("n", number).select(F.concat(F.lit(f"{kind.upper()}:"), "name", F.lit(":"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("chunk_id"), F.lit(kind).alias("source_type"), F.col("name").alias("source_name"), "section_heading", "text", "char_start", "char_end")


def paragraph_windows(docs: DataFrame, window: int = 3, step: int = 2, kind: str = "textbook") -> DataFrame:
    """Windows of `window` paragraphs, every `step`; those of few words go. Each paragraph is sent to the windows that hold it."""
    found = paragraphs(docs)
    at = F.col("at")
    first = F.greatest(F.lit(0), F.ceil((at - (window - 1)) / step)).cast("int")
    last = F.floor(at / step).cast("int")
    sent = found.withColumn("w", F.explode(F.when(first <= last, F.sequence(first, last))))
    joined = sent.groupBy("name", "w").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "paragraph"))), lambda x: x["paragraph"]), " ")).alias("text"), F.min("start").alias("char_start"), F.max_by(F.col("start") + F.length("paragraph"), "at").alias("char_end"))
    return _numbered(joined.filter(n_words(F.col("text")) >= WINDOW_WORDS).withColumn("section_heading", F.lit("")), "w", kind)


def headed_sections(docs: DataFrame, heading: str, noise: str = r"^\s*\d+\s*$", kind: str = "textbook") -> DataFrame:
    """One chunk for each heading's section, without noise lines; sections of few words go."""
    lines = docs.select("name", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.rtrim(F.replace("line", F.lit("\r"), F.lit(""))))
    by_line = Window.partitionBy("name").orderBy("line_no")
    upto = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumn("end", F.sum(F.length("line") + 1).over(upto).cast("int")).filter(~F.col("line").rlike(noise))
    is_heading = F.col("line").rlike(heading)
    grouped = placed.withColumn("g", F.sum(is_heading.cast("int")).over(upto))
    body = F.filter(F.array_sort(F.collect_list(F.when(~is_heading, F.struct("line_no", "line")))), lambda x: F.trim(x["line"]) != "")
    sections = grouped.groupBy("name", "g").agg(F.coalesce(F.max(F.when(is_heading, F.col("line"))), F.lit("")).alias("section_heading"), F.array_join(F.transform(body, lambda x: x["line"]), " ").alias("text"), F.min(F.col("end") - F.length("line") - 1).cast("int").alias("char_start"), F.max("end").alias("char_end"))
    return _numbered(sections.filter(n_words(F.col("text")) >= SECTION_WORDS), "g", kind)


def budgeted(text: str, budget: int, overlap: int) -> list[tuple[str, int]]:
    """Sentences gathered up to a budget of characters, each window beginning with the last ones that fit the overlap."""
    out, held, size, start = [], [], 0, 0
    for sentence in (s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)):
        if not sentence:
            continue
        if held and size + len(sentence) > budget:
            whole = " ".join(held)
            out.append((whole, start))
            keep, kept = len(held), 0
            while keep and kept + len(held[keep - 1]) <= overlap:
                keep -= 1
                kept += len(held[keep])
            held, size, start = held[keep:], kept, start + len(whole) - kept
        held.append(sentence)
        size += len(sentence)
    return [*out, (" ".join(held), start)] if held else out


def character_windows(docs: DataFrame, budget: int = 1200, overlap: int = 200, drop_line: str = r"^\s*(\(?(Figure|Fig\.|Table)\s|\d+\.\s+[A-Z][a-z]+,? [A-Z]\b)", kind: str = "textbook") -> DataFrame:
    """Windows of whole sentences with overlap; a sequential scan of one text, so it is a pandas function over batches of texts."""
    pattern = drop_line

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        skip = re.compile(pattern)
        for batch in batches:
            rows = []
            for name, text in zip(batch["name"], batch["text"], strict=True):
                clean = "\n".join(x for x in (line.strip() for line in (text or "").splitlines()) if not skip.match(x))
                found = [(w, at) for w, at in budgeted(clean, budget, overlap) if len(w.split()) >= WINDOW_WORDS]
                rows += [(f"{kind.upper()}:{name}:{i:04d}", kind, name, "", w, at, at + len(w)) for i, (w, at) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return docs.select("name", "text").mapInPandas(cut, CHUNK)


def chunked(docs: DataFrame, strategies: dict = STRATEGIES, heading: str = r"^[A-Z][A-Z \-]{4,}$") -> DataFrame:
    """Each document by the strategy whose key its name holds, else by the default."""
    keys = [k for k in strategies if k != "default"]
    chosen = F.coalesce(*[F.when(F.contains(F.lower("name"), F.lit(k)), F.lit(k)) for k in keys], F.lit("default"))
    routed, out = docs.withColumn("strategy", chosen), None
    for key, s in strategies.items():
        own = routed.filter(F.col("strategy") == key).drop("strategy")
        part = {"paragraphs": lambda: paragraph_windows(own, s["window"], s["step"]), "headings": lambda: headed_sections(own, s.get("heading", heading)), "characters": lambda: character_windows(own, s["budget"], s["overlap"])}[s["kind"]]()
        out = part if out is None else out.unionByName(part)
    return out


def snippets(questions: DataFrame) -> DataFrame:
    """A chunk for each snippet of each question, numbered within it."""
    each = questions.select("id", F.posexplode("snippets").alias("n", "s"))
    document = F.element_at(F.split("s.document", "/"), -1)
    return each.select(F.concat(F.lit("BIOASQ:"), "id", F.lit(":"), F.format_string("%02d", F.col("n"))).alias("chunk_id"), F.lit("bioasq_snippet").alias("source_type"), document.alias("source_name"), F.coalesce("s.beginSection", F.lit("")).alias("section_heading"), F.col("s.text").alias("text"), F.col("s.offsetInBeginSection").cast("int").alias("char_start"), F.col("s.offsetInEndSection").cast("int").alias("char_end"))
