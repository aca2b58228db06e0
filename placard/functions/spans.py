"""Places in texts: occurrences of quotes, changes, protected spans, highlight parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placard.functions.places import quoted

# What a rewrite may not touch, each pattern by itself. (?U): digits and white space as in Unicode.
PROTECTED = (
    r"(?iU)(?:https?://|www\.)[^\s<>]+",
    r"(?U)[^\s@<>]+@[^\s@<>]+\.[^\s@<>]+",
    r"(?U)\d+(?:[.,:/~\-–]\d+)*(?:\s*[년월일시분초])?",
    r"[월화수목금토일]요일",
)
WORD = r"^[\p{L}\p{M}\p{N}\p{Pc}]$"
PLACES = "array<struct<start:bigint,end:bigint>>"


def unique_place(text: Column, quote: Column) -> Column:
    """Where a quote stands, from 0 in code points, if just once (overlaps count); else null. Never guesses."""
    at = F.instr(text, quote)
    again = F.instr(F.substr(text, at + 1), quote)
    return F.when((F.length(quote) > 0) & (at > 0) & (again == 0), (at - 1).cast("long"))


def match_status(text: Column, quote: Column) -> Column:
    """matched, ambiguous or not_found."""
    return F.when(F.instr(text, quote) == 0, "not_found").when(unique_place(text, quote).isNull(), "ambiguous").otherwise("matched")


def apply_changes(text: Column, changes: Column) -> Column:
    """The text with sorted, non-overlapping changes (start, end, replacement; code points, end exclusive) made."""
    done = F.aggregate(
        changes,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, c: F.struct(F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (c["start"] - acc["at"]).cast("int")), c["replacement"]).alias("out"), c["end"].alias("at")),
    )
    return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))


def changes_in_order(changes: Column, length: Column) -> Column:
    """Whether changes are sorted, don't overlap and stay within the length."""
    end = F.aggregate(
        changes,
        F.lit(0).cast("long"),
        lambda at, c: F.when((at >= 0) & (c["start"] >= at) & (c["end"] > c["start"]) & (c["end"] <= length), c["end"]).otherwise(F.lit(-1).cast("long")),
    )
    return end >= 0


def shifted(changes: Column, start: Column, end: Column) -> Column:
    """Where [start, end) stands after the changes: struct of status (unchanged, replaced, original_only), start and end."""
    delta = F.aggregate(F.filter(changes, lambda c: c["end"] <= start), F.lit(0).cast("long"), lambda d, c: d + F.length(c["replacement"]) - (c["end"] - c["start"]))
    crossing = F.filter(changes, lambda c: (c["start"] < end) & (start < c["end"]))
    whole = (F.size(crossing) == 1) & (F.get(crossing, F.lit(0))["start"] == start) & (F.get(crossing, F.lit(0))["end"] == end)
    status = F.when(F.size(crossing) == 0, "unchanged").when(whole, "replaced").otherwise("original_only")
    new_end = F.when(F.size(crossing) == 0, end + delta).when(whole, start + delta + F.length(F.get(crossing, F.lit(0))["replacement"]))
    return F.struct(status.alias("status"), F.when(status != "original_only", start + delta).alias("start"), new_end.alias("end"))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def matches(text: Column, pattern: str) -> Column:
    """Places (start, end; code points, end exclusive) of a pattern's matches: lengths of what stands between, and of the matches, added up."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(found)), lambda x: F.length(x)).alias("gap"), F.transform(found, lambda x: F.length(x)).alias("own"))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(PLACES).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["own"]).cast("long").alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).cast("long").alias("start"), (acc["at"] + x["gap"] + x["own"]).cast("long").alias("end"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, walked).otherwise(F.when(text.isNotNull(), F.array().cast(PLACES)))


def protected_spans(text: Column) -> Column:
    """Places of addresses, mails, numbers with their units, and weekdays; those of different kinds may overlap."""
    return F.array_sort(F.array_distinct(F.concat(*[matches(text, p) for p in PROTECTED])))


def _is_word(text: Column, place: Column) -> Column:
    """Whether the character at a place (from 0) is part of a word; false outside the text."""
    return F.coalesce(F.when(place >= 0, F.substr(text, (place + 1).cast("int"), F.lit(1))).rlike(WORD), F.lit(False))


def locate(text: Column, context: Column, original: Column, protected: Column, whole_word: bool = False) -> Column:
    """Struct of start, end and problem of a term in its context in a text; nothing is guessed.

    problem: not_unique (context in the text, or term in the context), part_of_word
    (``whole_word``: whatever the term's own ends are), protected; null where found.
    """
    outer, inner = unique_place(text, context), unique_place(context, original)
    start = outer + inner
    end = start + F.length(original)
    last = F.length(original) - 1
    ends = (F.lit(True), F.lit(True)) if whole_word else (_is_word(original, F.lit(0)), _is_word(original, last))
    torn = (ends[0] & _is_word(text, start - 1)) | (ends[1] & _is_word(text, end))
    problem = F.when(start.isNull(), "not_unique").when(torn, "part_of_word").when(overlaps(protected, start, end), "protected")
    return F.struct(F.when(problem.isNull(), start).alias("start"), F.when(problem.isNull(), end).alias("end"), problem.alias("problem"))


def resolved(located: Column) -> Column:
    """Terms (structs with start and end) in order of place, without those that have none and those that overlap one given before them."""
    kept = F.aggregate(
        F.filter(located, lambda x: x["start"].isNotNull()), F.slice(located, F.lit(1), F.lit(0)),
        lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), acc).otherwise(F.array_append(acc, x)),
    )
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def glossary_parts(text: Column, terms: Column) -> Column:
    """The text cut at terms (array of strings): array of (text, is_term). At one place the longest term counts."""
    listed = F.transform(F.array_distinct(F.filter(terms, lambda t: F.trim(t) != "")), lambda t: F.struct((-F.length(t)).alias("n"), quoted(t).alias("t")))
    pattern = F.array_join(F.transform(F.array_sort(listed), lambda t: t["t"]), "|")
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    part = lambda value, is_term: F.struct(value.alias("text"), F.lit(is_term).alias("is_term"))
    # Zipped, so the text is searched once and not again for each part.
    cut = F.flatten(F.transform(F.arrays_zip(between.alias("b"), found.alias("f")), lambda z: F.array(part(z["b"], False), part(z["f"], True))))
    whole = F.array(part(text, False))
    return F.filter(F.when(pattern == "", whole).otherwise(cut), lambda p: F.coalesce(p["text"], F.lit("")) != "")


def flatten_sections(headline: Column, intro: Column, sections: Column) -> Column:
    """A rewrite as text: blocks with a blank line between; the sentences of steps are numbered."""
    numbered = lambda s: F.transform(s["sentences"], lambda x, i: F.when(s["style"] == "steps", F.concat((i + 1).cast("string"), F.lit(". "), x)).otherwise(x))
    blocks = F.transform(sections, lambda s: F.concat_ws("\n", s["heading"], F.array_join(numbered(s), "\n")))
    return F.concat_ws("\n\n", headline, F.when(F.size(intro) > 0, F.array_join(intro, "\n")), blocks)
