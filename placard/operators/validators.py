"""Rule tables: each rule has a name and a column that is true where a row breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.spans import changes_in_order

# The allowed categories of notices, and limits of a summary's fields.
LICENSES = ("KOGL-1", "KOGL-2", "KOGL-3", "KOGL-4")
SUMMARY_LIMITS = {"summary": 300, "audience": 200, "action": 200, "location": 200, "applicable_area": 100, "publisher": 100}
DATE_KINDS = ("application", "event", "operation", "payment", "submission", "effective", "disruption", "result", "other")


def notice_rules() -> dict[str, Column]:
    """A notice's shape: which categories have a district, a real key, a known licence."""
    dong = F.col("category") == "dong"
    return {
        "category": ~F.col("category").isin("nowon", "seoul", "dong"), "key_blank": F.trim(F.coalesce("post_sn", F.lit(""))) == "",
        "district": (dong & F.col("dong_group").isNull()) | (~dong & F.col("dong_group").isNotNull()), "pinned": ~dong & F.col("is_pinned"),
        "license": F.col("license_type").isNotNull() & ~F.col("license_type").isin(*LICENSES), "title_blank": F.trim(F.coalesce("title", F.lit(""))) == "",
    }


def file_rules() -> dict[str, Column]:
    blank = lambda c: F.col(c).isNotNull() & (F.col(c) != F.trim(c)) | (F.col(c) == "")
    return {"kind": ~F.col("kind").isin("attachment", "image"), "serial": blank("file_sn"), "file_id": blank("file_id"), "half_identity": F.col("file_sn").isNull() != F.col("file_id").isNull()}


def summary_rules() -> dict[str, Column]:
    """A summary's fields: lengths, single lines, dates that are real and in order, at most five notes."""
    rules = {f"{c}_long": F.length(c) > n for c, n in SUMMARY_LIMITS.items()} | {f"{c}_lines": F.col(c).contains("\n") for c in SUMMARY_LIMITS}
    real = lambda d: d.isNull() | (d.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(d).isNotNull())
    clock = lambda t: t.isNull() | t.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return rules | {
        "date_kind": F.exists("dates", lambda d: ~d["kind"].isin(*DATE_KINDS)), "date_real": F.exists("dates", lambda d: ~(real(d["start_date"]) & real(d["end_date"]))),
        "date_order": F.exists("dates", lambda d: d["end_date"] < d["start_date"]), "time_real": F.exists("dates", lambda d: ~(clock(d["start_time"]) & clock(d["end_time"]))), "notes_many": F.size("notes") > 5,
    }


def change_rules(text: str = "original_text", changes: str = "changes") -> dict[str, Column]:
    """Changes of an easy text: in order, and each one's original really stands there."""
    differs = F.exists(changes, lambda c: F.substr(F.col(text), (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int")) != c["original"])
    return {"order": ~changes_in_order(F.col(changes), F.length(text).cast("long")), "original": differs, "unchanged": F.exists(changes, lambda c: c["original"] == c["replacement"])}


def broken(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that a row breaks; an unknown outcome is no breach."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()])))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and broken of the rows that break any rule."""
    return rows.select(key, broken(rules).alias("broken")).filter(F.size("broken") > 0)


def unique(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def toggled(ids: Column, one: Column) -> Column:
    """A bookmark list without the id if it has it, else with it at the end."""
    return F.when(F.array_contains(ids, one), F.array_remove(ids, one)).otherwise(F.array_append(ids, one))
