"""Where a summary's evidence stands in the notice: spans for each card, and the text in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.places import quote_places


def occurrences(text: Column, quote: Column) -> Column:
    """All places (from 0, code points) of a quote, overlapping ones too."""
    found = quote_places(text, quote)
    return F.when(found["exact"], F.transform(found["places"], lambda p: p["start"])).otherwise(F.array().cast("array<int>"))


def locate(evidence: DataFrame) -> DataFrame:
    """evidence (notice_id, card, excerpt, source_type, body) with place_status, start and end (UTF-16 units).

    An excerpt that is there but once is matched; one that is there but once
    with other white space is near, and its place is where it stands in the
    body; two or more places are ambiguous, none is guessed.
    """
    own = F.coalesce("excerpt", F.lit(""))
    placed = evidence.withColumn("_found", quote_places(F.when(F.col("source_type") == "text", F.col("body")), own))
    n, exact = F.size("_found.places"), F.col("_found.exact")
    status = (
        F.when(F.col("source_type") != "text", "file_reference").when(own == "", "invalid_reference").when((n == 1) & exact, "matched")
        .when(n == 1, "near").when(n > 1, "ambiguous").otherwise("not_found")
    )
    only = lambda c: F.when(n == 1, F.col("_found.places")[0][c]).cast("long")
    return placed.withColumns({"place_status": status, "start": only("start16"), "end": only("end16")}).drop("_found")


def card_status(located: DataFrame) -> DataFrame:
    """notice_id, card, status (ready, partial, ambiguous, file_only, not_found, no_evidence) and spans, sorted and distinct."""
    n = lambda *s: F.count_if(F.col("place_status").isin(*s))
    sums = located.groupBy("notice_id", "card").agg(
        F.count("place_status").alias("all"), n("matched", "near").alias("matched"), n("ambiguous").alias("ambiguous"), n("file_reference").alias("files"),
        F.array_sort(F.collect_set(F.when(F.col("place_status").isin("matched", "near"), F.struct("start", "end")))).alias("spans"),
    )
    status = (
        F.when(F.col("all") == 0, "no_evidence").when(F.col("matched") == F.col("all"), "ready").when(F.col("matched") > 0, "partial").when(F.col("files") == F.col("all"), "file_only")
        .when(F.col("ambiguous") > 0, "ambiguous").otherwise("not_found")
    )
    return sums.select("notice_id", "card", status.alias("status"), "spans")


def parts(text: Column, spans: Column) -> Column:
    """The text cut at the spans' ends: array of (text, highlighted). spans: start, end in code points."""
    inside = F.filter(F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), lambda p: (p > 0) & (p < F.length(text)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.length(text).cast("long")), inside)))
    made = F.transform(
        F.arrays_zip(F.slice(cuts, F.lit(1), F.size(cuts) - 1).alias("a"), F.slice(cuts, F.lit(2), F.size(cuts) - 1).alias("b")),
        lambda p: F.struct(F.substr(text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")).alias("text"), F.exists(spans, lambda s: (s["start"] <= p["a"]) & (p["b"] <= s["end"])).alias("highlighted")),
    )
    return F.when(F.length(text) > 0, made).otherwise(F.array().cast("array<struct<text:string,highlighted:boolean>>"))


def line_breaks(text: Column) -> Column:
    """A break in place of the spaces after a Korean sentence, before a bullet, and before the numbers of a list.

    Breaks and indents stay; addresses hold no spaces; numbers count as a list only if they go up from 1 within their line and aren't
    part of a date.
    """
    date = r"\b\d{1,4}\.[ \t]*\d{1,2}\.(?:[ \t]*\d{1,2}\.)?"
    lines = F.split(text, "\n", -1)
    number = r"(?:^|(?<=[ \t]))(?:\((\d+)\)|(\d+)[.)])[ \t]+(?=\S)"

    def broken(line: Column) -> Column:
        undated = F.regexp_replace(line, date, "")
        found = F.transform(F.regexp_extract_all(undated, F.lit(number), F.lit(0)), lambda m: F.regexp_extract(m, r"\d+", 0).try_cast("int"))
        is_list = (F.size(found) > 1) & F.forall(F.transform(found, lambda n, i: n == i + 1), lambda ok: F.coalesce(ok, F.lit(False)))
        # What follows another mark on the line, isn't a date and begins with the list's next number.
        listed = F.when(is_list, F.regexp_replace(line, r"(?<=\S)[ \t]+(?=(?:\(\d+\)|\d+[.)])[ \t]+\S)(?!\d{1,4}\.[ \t]*\d{1,2}\.)", "\n")).otherwise(line)
        sentences = F.regexp_replace(listed, r"(?<=[가-힣][.!?])[ \t]+(?=\S)|(?<=[가-힣][.!?][\"'”’」』)])[ \t]+(?=\S)", "\n")
        return F.regexp_replace(sentences, r"(?<=\S)[ \t]+(?=[•●■▶※][ \t]+\S)", "\n")

    return F.array_join(F.transform(lines, broken), "\n")
