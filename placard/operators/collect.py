"""Collecting notice lists: first occurrences, conflicts, completeness, and where to stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_occurrences(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Each key's first row in list order, with n_seen and conflict (two rows of the key differ)."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    position = F.struct(*order)
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), position).alias("r"), F.count("*").alias("n_seen"), (F.count_distinct(F.struct(*rest)) > 1).alias("conflict"))
    return picked.select(key, "r.*", "n_seen", "conflict")


def pinned_or_regular(rows: DataFrame, key: str = "post_sn") -> DataFrame:
    """One row for each post of a board list: pinned if any of its rows is, with conflict where title, department or date differ."""
    facts = ("title", "department", "registered_on")
    out = rows.groupBy(key).agg(F.bool_or("is_pinned").alias("is_pinned"), *[F.min_by(f, F.struct(*[c for c in ("page", "pos") if c in rows.columns], *facts)).alias(f) for f in facts], (F.count_distinct(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in facts])) > 1).alias("conflict"))
    return out


def page_proof(pages: DataFrame) -> DataFrame:
    """pages (page, total_count, page_size, total_pages, n_regular) with valid: the counts agree with each other."""
    last = F.col("total_count") - (F.col("total_pages") - 1) * F.col("page_size")
    expected = F.when(F.col("page") < F.col("total_pages"), F.col("page_size")).when(F.col("page") == F.col("total_pages"), last).otherwise(0)
    sized = F.col("total_pages") == F.ceil(F.col("total_count") / F.col("page_size"))
    return pages.withColumn("valid", F.coalesce(sized & (F.col("n_regular") == expected), F.lit(False)))


def completeness(rows: DataFrame, total: Column, key: str = "post_sn") -> DataFrame:
    """One row: listed, distinct, conflicts and complete (as many keys as the source says, none in conflict)."""
    each = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*[c for c in rows.columns if c not in (key, "page", "pos")])).alias("versions"))
    sums = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("listed"), F.count("*").alias("distinct"), F.count_if(F.col("versions") > 1).alias("conflicts"))
    return sums.withColumn("complete", (F.col("distinct") == total) & (F.col("conflicts") == 0))


def traversal(pages: DataFrame, again: DataFrame, key: str = "post_sn") -> DataFrame:
    """One row on a list read in overlapping pages: listed, distinct, conflicts, moved and complete.

    pages: page, pos, total, key and facts, as read; again: the first page, read
    once more at the end. The list moved meanwhile if that page's keys differ
    or the pages don't agree on the total.
    """
    facts = [c for c in pages.columns if c not in (key, "page", "pos", "total")]
    each = pages.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*facts)).alias("versions"))
    sums = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("listed"), F.count("*").alias("distinct"), F.count_if(F.col("versions") > 1).alias("conflicts"))
    totals = pages.agg(F.min("total").alias("low"), F.max("total").alias("high"), F.min("page").alias("first"))
    first = pages.join(F.broadcast(totals.select(F.col("first").alias("page"))), "page").select("pos", F.col(key).alias("before"))
    differs = first.join(again.select("pos", F.col(key).alias("after")), "pos", "full_outer").agg(F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("different"))
    one_row = sums.join(totals, F.lit(True)).join(differs, F.lit(True))
    moved = (F.col("different") > 0) | (F.col("low") != F.col("high"))
    return one_row.select("listed", "distinct", "conflicts", moved.alias("moved"), ((F.col("distinct") == F.col("high")) & (F.col("conflicts") == 0) & ~moved).alias("complete"))


def list_ranks(rows: DataFrame, by: tuple[str, ...], pos: str, buckets: int = 256) -> DataFrame:
    """rows with rank: the place from 1, highest pos (a whole number) first, within each list.

    Lists are cut into buckets of equal width of pos; counts of the buckets
    before give the offset, so no task ranks a whole list.
    """
    span = rows.agg(F.min(pos).alias("_low"), F.max(pos).alias("_high"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_high") - F.col("_low") + 1) / buckets))
    cut = rows.join(F.broadcast(span), F.lit(True)).withColumn("_bucket", F.floor((F.col("_high") - F.col(pos)) / width)).drop("_low", "_high")
    lists = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(lists), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(F.desc(pos)))
    return cut.join(offsets, [*by, "_bucket"]).withColumn("rank", (F.col("_before") + within).cast("long")).drop("_bucket", "_before")


def boundary_scan(rows: DataFrame, first: int, mode: str = "new", baseline: bool = False, by: tuple[str, ...] = (), refresh_stops: bool = True) -> DataFrame:
    """rows (rank in list order from 1, known) that an incremental run takes.

    Of the ``first`` rows the unknown ones are taken (all of them in a baseline
    or refresh). If none of those is known, the run goes on until the first
    known row. ``refresh_stops`` false is the variant in which a refresh goes
    on as well. Lists are independent by ``by``; of each, only the rank of its
    first known row is gathered, so a long list isn't one task's.
    """
    refresh = mode == "refresh"
    lists = rows if by else rows.withColumn("_one", F.lit(1))
    keys = list(by) or ["_one"]
    known = lists.filter("known").groupBy(*keys).agg(F.min("rank").alias("_known"))
    head = (F.col("rank") <= first) & (F.lit(baseline or refresh) | ~F.col("known"))
    tail = (F.col("rank") > first) & F.lit(not baseline and not (refresh and refresh_stops)) & (F.col("_known").isNull() | ((F.col("_known") > first) & (F.col("rank") < F.col("_known"))))
    return lists.join(known, keys, "left").filter(head | tail).select(*rows.columns)


def first_rows(rows: DataFrame, order: tuple[str, ...], most: int) -> tuple[DataFrame, Column]:
    """(the first rows in order, whether that leaves any out: a column over all rows)."""
    return rows.orderBy(*order).limit(most), F.count(F.lit(1)) > most


def in_range(rows: DataFrame, column: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(rows dated within [start, end], rows whose date can't be read)."""
    day = F.when(F.col(column).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(column))
    dated = rows.withColumn("_day", day)
    return dated.filter(F.col("_day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).drop("_day"), dated.filter("_day is null").drop("_day")


def until_rate_limited(attempts: DataFrame, order: str = "attempt", status: str = "status") -> DataFrame:
    """attempts with outcome: what follows a 429 wasn't attempted."""
    before = F.max((F.col(status) == 429).cast("int")).over(Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return attempts.withColumn("outcome", F.when(F.coalesce(before, F.lit(0)) == 1, "rate_limited_not_attempted").when(F.col(status) == 429, "rate_limited").when(F.col(status) == 200, "saved").otherwise("failed"))
