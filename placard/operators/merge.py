"""Keyed writes as snapshot merges: upsert with change detection, child sets, fenced and guarded writes.

A merge reads the current snapshot and a batch and returns the next snapshot;
it is written to a new path. Keys are joined once; conflicts of a batch with
itself are reported, not resolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("category", "source_board", "post_sn")
#: The columns whose change counts as a change of the notice.
CONTENT = ("category", "source_board", "dong_group", "post_sn", "title", "department", "registered_on", "url", "body_html", "license_type")
#: What a snapshot knows of a notice beside its columns.
STATE = ("is_modified", "is_visible", "content_revision", "content_updated_at", "updated_at")


def _struct(side: str, columns: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(f"{side}.{c}") for c in columns])


def batch_conflicts(batch: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Keys that a batch has more than once, with the number of different rows."""
    rest = [c for c in batch.columns if c not in key]
    rows = batch.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(*rest)).alias("n_different"))
    return rows.filter("n > 1")


def upsert_notices(target: DataFrame, batch: DataFrame, now: Column, key: tuple[str, ...] = KEY, content: tuple[str, ...] = CONTENT) -> DataFrame:
    """The next snapshot of notices.

    target has key and content columns and STATE; batch has key and content. A
    notice in the batch becomes visible again; its revision moves on, and it
    counts as modified, only if some content differs (null-safe). Any further
    column (is_pinned, body_text) comes from the batch where the batch has it,
    and counts for no change; otherwise a notice keeps its own.
    """
    content = tuple(c for c in content if c not in key)
    carried = [c for c in dict.fromkeys((*target.columns, *batch.columns)) if c not in (*key, *content, *STATE)]
    old, new = target.alias("t"), batch.alias("b")
    joined = old.join(new, reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]), "full_outer")
    in_batch, in_target = F.col(f"b.{key[-1]}").isNotNull(), F.col(f"t.{key[-1]}").isNotNull()
    further = lambda c: F.col(f"t.{c}") if c not in batch.columns else F.when(in_batch, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}") if c in target.columns else None)
    changed = in_batch & in_target & ~_struct("t", content).eqNullSafe(_struct("b", content))
    return joined.select(
        *[F.coalesce(f"b.{k}", f"t.{k}").alias(k) for k in key],
        *[F.when(in_batch, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in content],
        *[further(c).alias(c) for c in carried],
        (F.coalesce("t.is_modified", F.lit(False)) | changed).alias("is_modified"),
        F.when(in_batch, True).otherwise(F.col("t.is_visible")).alias("is_visible"),
        (F.coalesce("t.content_revision", F.lit(0)) + F.when(changed | ~in_target, 1).otherwise(0)).cast("long").alias("content_revision"),
        F.when(changed | ~in_target, now).otherwise(F.col("t.content_updated_at")).alias("content_updated_at"),
        F.when(in_batch, now).otherwise(F.col("t.updated_at")).alias("updated_at"),
    )


def insert_if_absent(target: DataFrame, batch: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """target and those rows of the batch whose key it doesn't have."""
    return target.unionByName(batch.join(target.select(*key), list(key), "left_anti").select(*target.columns))


def child_set_diff(old: DataFrame, new: DataFrame, parent: str, identity: tuple[str, ...]) -> DataFrame:
    """For each parent in ``new``: n_deleted, n_inserted, changed.

    The whole set is replaced if any child differs, so a changed set counts
    every old child as deleted and every new one as inserted. A child may
    appear once in a set.
    """
    both = old.select(parent, *identity, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(new.select(parent, *identity, F.lit(0).alias("_old"), F.lit(1).alias("_new")))
    each = both.groupBy(parent, *identity).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    sums = each.groupBy(parent).agg(F.sum("_old").alias("_n_old"), F.sum("_new").alias("_n_new"), F.max((F.col("_old") != F.col("_new")).cast("int")).alias("_differs"))
    count = lambda c, name: F.when(F.col("_differs") == 1, F.col(c)).otherwise(0).cast("long").alias(name)
    return sums.filter("_n_new > 0").select(parent, count("_n_old", "n_deleted"), count("_n_new", "n_inserted"), (F.col("_differs") == 1).alias("changed"))


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, parent: str) -> DataFrame:
    """The next snapshot of children: those of changed parents come from ``new``."""
    return old.join(changed, parent, "left_anti").unionByName(new.join(changed, parent, "left_semi").select(*old.columns))


def fenced(batch: DataFrame, executions: DataFrame, current: DataFrame, key: str = "notice_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, superseded) rows of a batch (key, execution_token, source_revision).

    A row is accepted if its token is the latest registered for the key and
    its revision is the notice's current one.
    """
    latest = executions.groupBy(key).agg(F.max("execution_token").alias("latest_token"))
    checked = batch.join(latest, key, "left").join(current.select(key, "content_revision"), key, "left")
    passes = F.coalesce((F.col("execution_token") == F.col("latest_token")) & (F.col("source_revision") == F.col("content_revision")), F.lit(False))
    checked = checked.withColumn("passes", passes)
    drop = ("passes", "latest_token", "content_revision")
    return checked.filter("passes").drop(*drop), checked.filter("not passes").drop(*drop)


def lost_dates(old: DataFrame, new: DataFrame, key: str, kind: str, columns: tuple[str, ...]) -> DataFrame:
    """Keys and kinds whose coverage is less in ``new``: fewer rows, or fewer that have one of the columns."""
    count = lambda df, p: df.groupBy(key, kind).agg(F.count("*").alias(f"{p}_rows"), *[F.count(c).alias(f"{p}_{c}") for c in columns])
    a, b = count(old, "old"), count(new, "new")
    joined = a.join(b.withColumnsRenamed({key: "k", kind: "d"}), F.expr(f"{key} <=> k and {kind} <=> d"), "left")
    fewer = [F.coalesce(F.col(f"new_{c}"), F.lit(0)) < F.col(f"old_{c}") for c in ("rows", *columns)]
    return joined.filter(reduce(lambda x, y: x | y, fewer)).select(key, kind, "old_rows", F.coalesce("new_rows", F.lit(0)).alias("new_rows"))


def lost_fields(old: Column, new: Column, uncertain: Column) -> Column:
    """Evidence fields that the old result has, the new one lacks, and no uncertainty explains."""
    return F.array_sort(F.array_except(F.array_except(old, F.coalesce(new, F.array().cast("array<string>"))), uncertain))


def clear_changed_summaries(summaries: DataFrame, old: DataFrame, new: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """The next snapshot of summaries (notice_id, status, result, category, category_code, deadline_on, updated_at) after notices went from old to new.

    Where a notice's revision moved, what was made of its former text goes and
    a finished summary has to be looked at again.
    """
    moved = new.select(F.col(key).alias("notice_id"), "content_revision").join(old.select(F.col(key).alias("notice_id"), F.col("content_revision").alias("_before")), "notice_id").filter("content_revision <> _before").select("notice_id", F.lit(True).alias("_moved"))
    gone = ("result", "category", "category_code", "deadline_on")
    joined = summaries.join(moved, "notice_id", "left")
    holds = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in gone])
    cleared = F.coalesce(F.col("_moved") & holds, F.lit(False))
    values = {c: F.when(~cleared, F.col(c)) for c in gone} | {"status": F.when(cleared & (F.col("status") == "summarized"), "needs_review").otherwise(F.col("status")), "updated_at": F.when(cleared, now).otherwise(F.col("updated_at"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in summaries.columns])


def file_conflicts(new: DataFrame, parent: str = "notice_id") -> DataFrame:
    """Parents with two different files of one key and kind; such a set is refused whole."""
    rest = [c for c in new.columns if c not in (parent, "file_key", "kind")]
    return new.groupBy(parent, "file_key", "kind").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(*rest)).alias("m")).filter("m > 1").select(parent).distinct()


def save_file_sets(notices: DataFrame, old: DataFrame, new: DataFrame, given: DataFrame, now: Column, parent: str = "notice_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next notices, next files, refused parents) after file sets were read.

    given: the parents whose set was read, even if it is empty; others keep
    theirs. A set that differs replaces the stored one whole; its parent counts
    as modified, and each deleted and each inserted file adds one to its
    revision. Parents that aren't stored, and sets with a conflict, are refused.
    """
    identity = tuple(c for c in new.columns if c != parent)
    stored = notices.select(F.col("id").alias(parent))
    refused = file_conflicts(new, parent).unionByName(given.join(stored, parent, "left_anti")).unionByName(new.select(parent).distinct().join(given, parent, "left_anti")).distinct()
    read = given.join(refused, parent, "left_anti")
    mine, theirs = old.join(read, parent, "left_semi"), new.join(read, parent, "left_semi").dropDuplicates([parent, *identity])
    side = lambda df, a, b: df.select(parent, *identity, F.lit(a).alias("_old"), F.lit(b).alias("_new"))
    each = side(mine, 1, 0).unionByName(side(theirs, 0, 1)).groupBy(parent, *identity).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    changed = each.groupBy(parent).agg(F.sum("_old").alias("n_deleted"), F.sum("_new").alias("n_inserted"), F.max((F.col("_old") != F.col("_new")).cast("int")).alias("differs")).filter("differs = 1").drop("differs")
    counted = notices.join(changed.withColumnRenamed(parent, "id"), "id", "left")
    events = F.coalesce(F.col("n_deleted") + F.col("n_inserted"), F.lit(0))
    values = {"content_revision": (F.col("content_revision") + events).cast("long"), "is_modified": F.col("is_modified") | (events > 0), "content_updated_at": F.when(events > 0, now).otherwise(F.col("content_updated_at"))}
    return counted.select(*[values.get(c, F.col(c)).alias(c) for c in notices.columns]), replace_children(old, theirs, changed.select(parent), parent), refused


CONTENT_COLUMNS = ("status", "result", "source_hash")


def save_corrections(current: DataFrame, batch: DataFrame, now: Column, by_source: bool = True, content: tuple[str, ...] = CONTENT_COLUMNS) -> DataFrame:
    """The next snapshot of summaries after candidates that needed correction (notice_id, content, attempt_count, last_error_code).

    A stored result stays (``by_source``: if it is of the same source), else the
    candidate is stored; error, attempts and time are recorded either way.
    """
    joined = current.alias("t").join(batch.alias("b"), F.col("t.notice_id") == F.col("b.notice_id"), "full_outer")
    asked = F.col("b.notice_id").isNotNull()
    stays = F.col("t.result").isNotNull() & (F.col("t.source_hash").eqNullSafe(F.col("b.source_hash")) if by_source else F.lit(True))
    return joined.select(
        F.coalesce("t.notice_id", "b.notice_id").alias("notice_id"), *[F.when(~asked | F.coalesce(stays, F.lit(False)), F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in content],
        (F.coalesce("t.attempt_count", F.lit(0)) + F.coalesce("b.attempt_count", F.lit(0))).cast("int").alias("attempt_count"),
        F.when(asked, F.col("b.last_error_code")).otherwise(F.col("t.last_error_code")).alias("last_error_code"), F.when(asked, now).otherwise(F.col("t.updated_at")).alias("updated_at"),
    )


# A result's fields that a later one of the same source has to keep, and its cards.
RESULT_FIELDS = ("category_code", "publisher", "applicable_area", "audience", "action", "location", "status_detail", "notice_update", "changed_details", "summary")
CARDS = ("audience", "deadline", "action", "notes")


def loses_information(old: Column, new: Column, old_deadline: Column, new_deadline: Column) -> Column:
    """Whether a new result (struct) has less than the old one.

    Fields, cards, notes and topics, dates of each kind (their number, and how
    many have each part), evidence for a field that isn't named as uncertain,
    or the deadline.
    """
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    gone = [~blank(old[f]) & blank(new[f]) for f in RESULT_FIELDS] + [~blank(old["card_summaries"][c]) & blank(new["card_summaries"][c]) for c in CARDS]
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    fewer = [size(new[c]) < size(old[c]) for c in ("notes", "topics")]
    parts = (None, "start_date", "end_date", "start_time", "end_time")
    n = lambda dates, kind, part: size(F.filter(dates, lambda d: d["kind"].eqNullSafe(kind) & (d[part].isNotNull() if part else F.lit(True))))
    dates = F.exists(old["dates"], lambda d: reduce(lambda a, b: a | b, [n(new["dates"], d["kind"], p) < n(old["dates"], d["kind"], p) for p in parts]))
    evidence = size(lost_fields(old["evidence"], new["evidence"], F.coalesce(new["uncertainties"], F.array().cast("array<string>")))) > 0
    return F.coalesce(reduce(lambda a, b: a | b, [*gone, *fewer, F.coalesce(dates, F.lit(False)), evidence, old_deadline.isNotNull() & new_deadline.isNull()]), F.lit(False))


def save_summaries(current: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of summaries (notice_id, status, result, source_hash, attempt_count, last_error_code, updated_at).

    batch rows also have ``outcome``: result, failure or pending, and ``loses``
    (the candidate has less than the stored result). A result of the same
    source that loses information keeps the stored content and records
    summary_information_loss; a failure keeps the content if the source is the
    same, else clears it; pending only counts the attempt.
    """
    joined = current.alias("t").join(batch.alias("b"), F.col("t.notice_id") == F.col("b.notice_id"), "full_outer")
    same = F.coalesce(F.col("t.source_hash") == F.col("b.source_hash"), F.lit(False))
    guarded = (F.col("b.outcome") == "result") & same & F.col("t.result").isNotNull() & F.coalesce("b.loses", F.lit(False))
    is_new, writes = F.col("t.notice_id").isNull(), (F.col("b.outcome") == "result") & ~guarded
    clears = (F.col("b.outcome") == "failure") & ~same
    pick = lambda c: F.when(F.coalesce(writes, F.lit(False)), F.col(f"b.{c}")).when(F.coalesce(clears, F.lit(False)), None).otherwise(F.col(f"t.{c}"))
    status = F.when(F.coalesce(writes, F.lit(False)), F.col("b.status")).when(F.coalesce(clears, F.lit(False)), "failed").when(is_new, "pending").otherwise(F.col("t.status"))
    error = F.when(F.coalesce(guarded, F.lit(False)), "summary_information_loss").when(F.coalesce(writes, F.lit(False)), None).otherwise(F.coalesce("b.last_error_code", "t.last_error_code"))
    return joined.select(
        F.coalesce("b.notice_id", "t.notice_id").alias("notice_id"), status.alias("status"), pick("result").alias("result"),
        F.when(F.coalesce(writes | clears, F.lit(False)) | is_new, F.col("b.source_hash")).otherwise(F.col("t.source_hash")).alias("source_hash"),
        (F.coalesce("t.attempt_count", F.lit(0)) + F.coalesce("b.attempt_count", F.lit(0))).cast("int").alias("attempt_count"),
        error.alias("last_error_code"), F.when(F.col("b.notice_id").isNotNull(), now).otherwise(F.col("t.updated_at")).alias("updated_at"),
    )
