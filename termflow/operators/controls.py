"""The term table's controls: filters, search, sorting, bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termflow.functions import text as T
from termflow.operators.vocabulary import LEVELS

#: The table's columns and each sort field's default direction (True: descending).
COLUMNS = ["term", "reading", "pos", "frequency", "jlpt", "sentences", "comprehension"]
SORTS = {"frequency": False, "chronological": False, "sentenceCount": True, "comprehension": False, "jlpt": False}


@dataclass
class Controls:
    """State of the controls; a part of speech or level without a flag is shown."""

    least: int | None = None
    most: int | None = None
    include_unknown: bool = True
    pos: dict[str, bool] = field(default_factory=dict)
    levels: dict[str, bool] = field(default_factory=dict)
    query: str = ""
    sort: str = "frequency"
    descending: bool | None = None


def frequency_bounds(terms: DataFrame) -> DataFrame:
    """One row (least, most) of the known frequencies: least is 1 at least, most not under it, (1, 1) without any."""
    return terms.agg(F.greatest(F.coalesce(F.min("harmonic"), F.lit(1)), F.lit(1)).alias("least"), F.greatest(F.coalesce(F.max("harmonic"), F.lit(1)), F.coalesce(F.min("harmonic"), F.lit(1)), F.lit(1)).alias("most"))


def clamp(value: int, least: int, most: int) -> int:
    """A filter's end inside the data's bounds."""
    return max(least, min(most, value))


def filtered(terms: DataFrame, c: Controls) -> DataFrame:
    """Terms (lemma, lemma_reading, surface, surface_reading, full_segment, pos, harmonic, level) that the flags and the range let through."""
    f = F.col("harmonic")
    inside = F.lit(True)
    if c.least is not None:
        inside = inside & (f >= c.least)
    if c.most is not None:
        inside = inside & (f <= c.most)
    df = terms.filter(F.when(f.isNull(), F.lit(c.include_unknown)).otherwise(inside))
    if off := [p for p, on in c.pos.items() if not on]:
        df = df.filter(~F.col("pos").isin(off))
    if off := [x for x, on in c.levels.items() if not on]:
        df = df.filter(~F.coalesce("level", F.lit("none")).isin(off))
    return df


def searched(terms: DataFrame, query: str, sentences: DataFrame | None = None) -> DataFrame:
    """Terms that match a query in a form, reading, part of speech, or in the text of a sentence (term_id, text) they occur in."""
    query = query.strip()
    if not query:
        return terms
    hit = F.lit(False)
    for c in ("lemma", "lemma_reading", "surface", "surface_reading", "full_segment", "pos"):
        hit = hit | F.coalesce(T.search(F.col(c), query), F.lit(False))
    if sentences is None:
        return terms.filter(hit)
    there = sentences.filter(T.search(F.col("text"), query)).select(F.col("term_id").alias("_id")).distinct()
    return terms.join(there, F.col("term_id") == F.col("_id"), "left").filter(hit | F.col("_id").isNotNull()).drop("_id")


def ordered(terms: DataFrame, c: Controls, tie: str = "term_id") -> DataFrame:
    """Sorted by the chosen field; an unknown value counts as greater than all others."""
    key = {"frequency": "harmonic", "chronological": "first_ord", "sentenceCount": "n_sentences", "comprehension": "comprehension", "jlpt": "level"}[c.sort]
    by = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")) if c.sort == "jlpt" else F.col(key)
    down = SORTS[c.sort] if c.descending is None else c.descending
    return terms.orderBy(by.desc_nulls_first() if down else by.asc_nulls_last(), F.asc(tie))


def apply(terms: DataFrame, c: Controls, sentences: DataFrame | None = None) -> DataFrame:
    """Filter, search, sort."""
    return ordered(searched(filtered(terms, c), c.query, sentences), c)


def reconcile_columns(saved: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """Known columns once each in saved order, missing ones appended as visible; the term is always visible."""
    out: dict[str, bool] = {}
    for name, on in saved:
        if name in COLUMNS and name not in out:
            out[name] = on or name == "term"
    return [*out.items(), *[(c, True) for c in COLUMNS if c not in out]]
