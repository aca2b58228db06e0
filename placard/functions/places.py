"""Places of quotes and of a dictionary's terms in whole texts, in time linear in the text.

Quotes are compared as they are, and if they stand nowhere, with each run of
white space as one space; every place is given, those that overlap too, in code
points and in the units of UTF-16 that an app counts in.

A dictionary's terms are one Aho-Corasick automaton for all texts, broadcast as
long as it has at most ``MOST_TERMS`` terms; a larger dictionary makes several, and
the texts are passed over once for each.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TERMS = 200_000
PLACES = T.StructType([T.StructField("exact", T.BooleanType()), T.StructField("places", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "start16", "end16")])))])
SPAN, FOUND = (T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in names])) for names in (("start", "end"), ("at", "size")))
MARKS = T.StructType([T.StructField("n_places", T.LongType()), T.StructField("spans", SPAN)])
_SPACE = re.compile(r"\s+")


def all_places(text: str, quote: str) -> list[int]:
    """Where a quote begins, overlapping places too."""
    out, at = [], text.find(quote) if quote else -1
    while at >= 0:
        out.append(at)
        at = text.find(quote, at + 1)
    return out


def spaced_places(text: str, quote: str) -> list[tuple[int, int]]:
    """(start, end) of a quote in a text where runs of white space count as one space; the quote's own ends are trimmed."""
    target = _SPACE.sub(" ", quote).strip(" ")
    # Where each run stands in the text that has one space for it, and how much longer the text is up to its end.
    runs, longer, grown = [], [0], 0
    for run in _SPACE.finditer(text):
        runs.append(run.start() - grown)
        grown += run.end() - run.start() - 1
        longer.append(grown)
    # The origin of a character comes after all runs before it; a place's end is the end of its last character's origin.
    return [(at + longer[bisect_right(runs, at - 1)], at + len(target) + longer[bisect_right(runs, at + len(target) - 1)]) for at in all_places(_SPACE.sub(" ", text), target)]


def utf16(text: str, points: list[int]) -> list[int]:
    """The same places in UTF-16 units."""
    if text.isascii() or max(text) <= "￿":
        return points
    wide = np.concatenate(([0], np.cumsum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") > 0xFFFF)))
    return [int(p + wide[p]) for p in points]


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())


@F.arrow_udf(PLACES)
def quote_places(text: pa.Array, quote: pa.Array) -> pa.Array:
    """All places of a quote; exact: as it is, else with other white space. Null or empty ones have none.

    Only the text at hand is a Python object; the places go into one array of numbers.
    """
    exact, sizes, numbers = [], [], array("i")
    for t, q in zip(text, quote, strict=True):
        t, q = t.as_py(), q.as_py()
        found = [(a, a + len(q)) for a in all_places(t, q)] if t and q else []
        exact.append(bool(found))
        if not found and t and q:
            found = spaced_places(t, q)
        points = [p for pair in found for p in pair]
        units = utf16(t, points) if found else []
        sizes.append(len(found))
        numbers.extend(x for i in range(0, len(points), 2) for x in (points[i], points[i + 1], units[i], units[i + 1]))
    columns = np.array(numbers, np.int32).reshape(-1, 4).T
    each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["start", "end", "start16", "end16"])
    return pa.StructArray.from_arrays([pa.array(exact, pa.bool_()), pa.ListArray.from_arrays(_offsets(sizes), each)], ["exact", "places"])


def longest_terms(automaton, text: str) -> dict[int, int]:
    """The longest term's length for each place at which terms begin."""
    found: dict[int, int] = {}
    for last, size in automaton.iter(text):
        start = last - size + 1
        if size > found.get(start, 0):
            found[start] = size
    return found


def left_to_right(found: dict[int, int]) -> list[tuple[int, int]]:
    """The terms that count: from the left, at each place the longest, none overlapping the one before."""
    out, at = [], 0
    for start in sorted(found):
        if start >= at:
            at = start + found[start]
            out.append((start, at))
    return out


def mark_terms(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", most: int = MOST_TERMS) -> DataFrame:
    """texts with n_places (at which some term begins) and spans (array of start, end: the terms that count), for terms' distinct, not blank strings.

    A null text has no places.
    """
    spark = texts.sparkSession
    named = terms.select(F.col(term).alias("term")).filter("trim(term) <> ''").distinct()
    passes = max(1, -(-named.count() // most))
    parted = named.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(passes)))
    found = []
    for part in range(passes):
        own = [r.term for r in parted.filter(F.col("part") == part).select("term").collect()]
        found.append(spark.sparkContext.broadcast(own))
    # One automaton gives the result at once; of several, each pass leaves its places and lengths as numbers, and the last step joins them.
    marks = _term_marks(found[0])(F.col(text)) if passes == 1 else _joined_marks(*[_term_finder(shared)(F.col(text)) for shared in found])
    return texts.withColumn("_found", marks).withColumns({"n_places": F.col("_found.n_places"), "spans": F.col("_found.spans")}).drop("_found")


def _searched(shared, values: pa.Array) -> Iterator[dict[int, int]]:
    """longest_terms of one text after the other; only the one at hand is held."""
    automaton = _automaton(shared)
    for value in values:
        t = value.as_py()
        yield longest_terms(automaton, t) if t and len(automaton) else {}


def _marked(found: Iterable[dict[int, int]]) -> pa.Array:
    """n_places and spans of each text, as arrays of numbers."""
    n_places, sizes, numbers = array("q"), [], array("i")
    for each in found:
        spans = left_to_right(each)
        n_places.append(len(each))
        sizes.append(len(spans))
        for span in spans:
            numbers.extend(span)
    start, end = np.array(numbers, np.int32).reshape(-1, 2).T
    spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(start)), pa.array(np.ascontiguousarray(end))], ["start", "end"])
    return pa.StructArray.from_arrays([pa.array(np.array(n_places, np.int64)), pa.ListArray.from_arrays(_offsets(sizes), spans)], ["n_places", "spans"])


def _term_marks(shared):
    @F.arrow_udf(MARKS)
    def marks(values: pa.Array) -> pa.Array:
        return _marked(_searched(shared, values))

    return marks


def _term_finder(shared):
    @F.arrow_udf(FOUND)
    def finder(values: pa.Array) -> pa.Array:
        sizes, at, size = [], array("i"), array("i")
        for found in _searched(shared, values):
            sizes.append(len(found))
            at.extend(found.keys())
            size.extend(found.values())
        each = pa.StructArray.from_arrays([pa.array(np.array(x, np.int32)) for x in (at, size)], ["at", "size"])
        return pa.ListArray.from_arrays(_offsets(sizes), each)

    return finder


@F.arrow_udf(MARKS)
def _joined_marks(*parts: pa.Array) -> pa.Array:
    def joined() -> Iterator[dict[int, int]]:
        for row in zip(*parts, strict=True):
            best: dict[int, int] = {}
            for part in row:
                for start, size in zip(*(part.values.field(f).to_pylist() for f in ("at", "size")), strict=True):
                    best[start] = max(size, best.get(start, 0))
            yield best

    return _marked(joined())


def _automaton(shared):
    """The automaton of a broadcast list of terms, built once in each worker and kept beside the list."""
    import ahocorasick

    terms = shared.value
    if not (terms and isinstance(terms[-1], ahocorasick.Automaton)):
        automaton = ahocorasick.Automaton()
        for term in terms:
            automaton.add_word(term, len(term))
        automaton.make_automaton()
        terms.append(automaton)
    return terms[-1]


def quoted(literal: Column) -> Column:
    """A pattern that matches just this string, whatever it holds."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
