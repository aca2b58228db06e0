"""Shapes of JSON texts, checked with the variant type: what isn't JSON, isn't the right type, or has keys too many or too few."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARDS = ("audience", "deadline", "action", "notes")
#: What counts as white space in a blank card (fixed value).
BLANK = r"^[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$"


def object_map(json: Column) -> Column:
    """An object's members as variants by key; null for anything else."""
    value = F.try_parse_json(json)
    return F.when(F.schema_of_variant(value).startswith("OBJECT<"), value.try_cast("map<string,variant>"))


def kind(value: Column) -> Column:
    """The JSON type of a variant: null, boolean, number, string, array or object."""
    named = F.schema_of_variant(value)
    return (
        F.when(named == "VOID", "null").when(named == "STRING", "string").when(named == "BOOLEAN", "boolean").when(named.startswith("ARRAY<"), "array").when(named.startswith("OBJECT<"), "object").when(named.isNotNull(), "number")
    )


def card_errors(json: Column, cards: tuple[str, ...] = CARDS) -> Column:
    """Sorted codes of what is wrong with a cards object: each of its keys there, none beside, a null or a line of text under each. A null column is right."""
    members = object_map(json)
    own = [F.element_at(members, c) for c in cards]
    text = [v.try_cast("string") for v in own]
    some = lambda tests: F.exists(F.array(*tests), lambda t: F.coalesce(t, F.lit(False)))
    is_text = [kind(v) == "string" for v in own]
    codes = {
        "extra_key": F.size(F.array_except(F.map_keys(members), F.array(*map(F.lit, cards)))) > 0, "missing_key": F.size(F.array_except(F.array(*map(F.lit, cards)), F.map_keys(members))) > 0,
        "type": some([~kind(v).isin("null", "string") for v in own]), "blank": some([i & t.rlike(BLANK) for i, t in zip(is_text, text, strict=True)]), "line_break": some([i & t.rlike("[\r\n]") for i, t in zip(is_text, text, strict=True)]),
    }
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in codes.items()])))
    whole = F.when(F.try_parse_json(json).isNull(), F.array(F.lit("malformed"))).when(members.isNull(), F.array(F.lit("not_object"))).otherwise(found)
    return F.when(json.isNull(), F.array().cast("array<string>")).otherwise(whole)


def entry_errors(json: Column, strings: tuple[str, ...], arrays: tuple[str, ...]) -> Column:
    """Sorted codes of what is wrong with an array of objects that have just these keys: not blank strings, and arrays of not blank strings, at least one in each."""
    value = F.try_parse_json(json)
    items = F.when(F.schema_of_variant(value).startswith("ARRAY<"), value.try_cast("array<variant>"))
    member = lambda item: item.try_cast("map<string,variant>")
    is_object = lambda item: kind(item) == "object"
    keys = F.array(*map(F.lit, (*strings, *arrays)))
    one = lambda test: F.exists(items, lambda item: F.coalesce(is_object(item) & test(member(item)), F.lit(False)))
    stated = lambda v: (kind(v) == "string") & ~v.try_cast("string").rlike(BLANK)
    listed = lambda v: (kind(v) == "array") & (F.size(v.try_cast("array<variant>")) > 0) & F.forall(v.try_cast("array<variant>"), lambda x: F.coalesce(stated(x), F.lit(False)))
    wrong = lambda m: F.exists(F.array(*[F.coalesce(stated(F.element_at(m, k)), F.lit(False)) for k in strings], *[F.coalesce(listed(F.element_at(m, k)), F.lit(False)) for k in arrays]), lambda ok: ~ok)
    codes = {
        "not_object": F.exists(items, lambda item: ~is_object(item)), "extra_key": one(lambda m: F.size(F.array_except(F.map_keys(m), keys)) > 0),
        "missing_key": one(lambda m: F.size(F.array_except(keys, F.map_keys(m))) > 0), "value": one(lambda m: (F.size(F.array_except(keys, F.map_keys(m))) == 0) & wrong(m)),
    }
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in codes.items()])))
    return F.when(value.isNull(), F.array(F.lit("malformed"))).when(items.isNull(), F.array(F.lit("not_array"))).otherwise(found)
