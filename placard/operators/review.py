"""Rules on summaries: review decision, deadline, attachments, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date kinds that a reader has to act by.
DEADLINE_KINDS = ("application", "submission", "payment")


def deadline(dates: Column) -> Column:
    """The latest end date of the kinds that ask for action; dates: array of kind, end_date."""
    return F.array_max(F.transform(F.filter(dates, lambda d: d["kind"].isin(*DEADLINE_KINDS)), lambda d: d["end_date"]))


def attachment_status(n_files: Column, n_read: Column) -> Column:
    return F.when(n_files == 0, "none").when(n_read == 0, "unread").when(n_read < n_files, "partial").otherwise("all_read")


def display_status(status: Column, n_omissions: Column | None = None) -> Column:
    """What a list shows: none without a summary, else its state; one that left files out has to be looked at."""
    shown = F.when(status.isin("pending", "failed", "summarized", "needs_review"), status).otherwise("none")
    return shown if n_omissions is None else F.when((status == "summarized") & (n_omissions > 0), "needs_review").otherwise(shown)


def requires_review(category: Column, code: Column, uncertainties: Column, attachments: Column, evidence: Column, required: Column) -> Column:
    """Whether a person has to look: unknown category, doubts, unread files, evidence that isn't matched text, or a required field without evidence."""
    weak = F.exists(evidence, lambda e: (e["source_type"] != "text") | (e["verification"] != "text_matched"))
    missing = F.size(F.array_except(required, F.transform(evidence, lambda e: e["field"]))) > 0
    return F.coalesce((category == "unknown") | code.isNull() | (F.size(uncertainties) > 0) | attachments.isin("partial", "unread") | weak | missing, F.lit(True))


def status_violations(row: str = "") -> dict[str, Column]:
    """The summary state's rules: name and a column that is true where a row breaks one."""
    c = lambda name: F.col(f"{row}{name}")
    s = c("status")
    return {
        "summarized_needs_result": (s == "summarized") & (c("result").isNull() | c("category").isNull() | c("category_code").isNull()),
        "needs_review_has_no_deadline": (s == "needs_review") & c("deadline_on").isNotNull(),
        "unfinished_is_blank": s.isin("pending", "failed") & (c("result").isNotNull() | c("category").isNotNull() | c("category_code").isNotNull() | c("deadline_on").isNotNull()),
        "failed_needs_code": (s == "failed") & c("last_error_code").isNull(),
        "generated_at_iff_done": s.isin("pending", "failed") != c("generated_at").isNull(),
    }


def window_status(now: Column, start: Column, end: Column) -> Column:
    """upcoming, open or closed by the clock; a missing start is long past, a missing end never comes."""
    return F.when(start.isNotNull() & (now < start), "upcoming").when(end.isNotNull() & (now > end), "closed").otherwise("open")


def status_fits(status: Column, category: Column, now: Column, dates: Column) -> Column:
    """Whether a status agrees with the clock in Korea: now against the first start, the last end, or one whole range.

    dates: array of kind, start_date, end_date, start_time, end_time as text. A
    day without a clock begins at 00:00 and ends at the last microsecond.
    """
    kind = F.when(category == "application", "application").otherwise("event")
    own = F.filter(dates, lambda d: d["kind"] == kind)
    at = lambda day, clock, whole: F.try_to_timestamp(F.concat_ws(" ", day, F.coalesce(F.concat(clock, F.lit(":00.000000")), F.lit(whole))), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    start, end = (lambda d: at(d["start_date"], d["start_time"], "00:00:00.000000")), (lambda d: at(d["end_date"], d["end_time"], "23:59:59.999999"))
    here = F.from_utc_timestamp(now, "Asia/Seoul")
    first = F.array_min(F.transform(F.filter(own, lambda d: d["start_date"].isNotNull()), start))
    last = F.array_max(F.transform(F.filter(own, lambda d: d["end_date"].isNotNull()), end))
    within = F.exists(own, lambda d: d["start_date"].isNotNull() & d["end_date"].isNotNull() & (start(d) <= here) & (here <= end(d)))
    allowed = F.when(category == "application", status.isin("upcoming", "open", "closed")).otherwise(status.isin("upcoming", "ongoing", "ended"))
    by_clock = F.when(status == "upcoming", F.coalesce(here < first, F.lit(False))).when(status.isin("closed", "ended"), F.coalesce(here > last, F.lit(False))).otherwise(F.coalesce(within, F.lit(False)))
    return F.when(status.isin("unknown", "check_required", "not_applicable") | ~category.isin("application", "event"), True).otherwise(F.coalesce(allowed & by_clock, F.lit(False)))


def date_text(d: Column) -> Column:
    """A date entry (label, text, start_date, start_time, end_date, end_time) in one line; null if it says nothing."""
    end = lambda name, day, clock: F.concat(F.lit(f"{name}: "), F.nullif(F.concat_ws(" ", F.replace(day, F.lit("-"), F.lit(".")), clock), F.lit("")))
    return F.nullif(F.concat_ws(" · ", d["label"], d["text"], end("시작", d["start_date"], d["start_time"]), end("종료", d["end_date"], d["end_time"])), F.lit(""))


def matched_retries(previous: DataFrame, current: DataFrame, key: str = "notice_id") -> DataFrame:
    """(key, old, new): which item of a retry corrects which of the first answer, one to one; where it isn't clear there is no row.

    Both have key, pos, kind, label, start_date, start_time, end_date and text.
    Items of the same kind and label are scored by what they share, and a match
    has to be the only best one for both.
    """
    facts = ("start_date", "start_time", "end_date", "text")
    side = lambda df, n: df.select(key, "kind", "label", F.col("pos").alias(n), F.struct(*facts).alias(f"{n}_f"))
    group = lambda df, n: df.groupBy(key, "kind", "label").agg(F.count("*").alias(f"{n}_n"))
    day = lambda df, n: df.groupBy(key, "kind", "label", "start_date").agg(F.count("*").alias(f"{n}_day")).withColumnRenamed("start_date", "_day")
    pairs = side(previous, "old").join(side(current, "new"), [key, "kind", "label"]).join(group(previous, "old"), [key, "kind", "label"]).join(group(current, "new"), [key, "kind", "label"])
    pairs = pairs.withColumn("_day", F.col("old_f.start_date")).join(day(previous, "old"), [key, "kind", "label", "_day"], "left").join(day(current, "new"), [key, "kind", "label", "_day"], "left")
    o, n = (lambda c: F.col(f"old_f.{c}")), (lambda c: F.col(f"new_f.{c}"))
    differ, same_day = (lambda c: F.coalesce(o(c) != n(c), F.lit(False))), F.coalesce(o("start_date") == n("start_date"), F.lit(False))
    sessions = same_day & (F.greatest(F.coalesce("old_day", F.lit(0)), F.coalesce("new_day", F.lit(0))) > 1)
    shared = sum((F.when(F.coalesce(o(c) == n(c), F.lit(False)), w).otherwise(0) for c, w in (("start_date", 4), ("start_time", 2), ("end_date", 1), ("text", 3))), F.lit(0))
    score = F.when(F.col("old_f").eqNullSafe(F.col("new_f")), 100).when((F.col("old_n") == 1) & (F.col("new_n") == 1), 1).when(differ("start_date") | (differ("start_time") & (sessions | ~same_day)), 0).otherwise(shared)
    scored = pairs.select(key, "old", "new", score.alias("score")).filter("score > 0")
    best = lambda a, b: scored.groupBy(key, a).agg(F.max(F.struct("score", b)).alias("m")).select(key, a, F.col("m.score").alias("score")).join(scored, [key, a, "score"]).groupBy(key, a).agg(F.count("*").alias("n"), F.min(b).alias(b)).filter("n = 1").select(key, a, b)
    return best("old", "new").join(best("new", "old"), [key, "old", "new"])


def cards(fields: dict[str, Column], guidance: dict[str, str]) -> Column:
    """Array of (name, text) in the given order; a blank text takes its guidance."""
    return F.array(*[F.struct(F.lit(k).alias("name"), F.when(F.trim(F.coalesce(v, F.lit(""))) == "", guidance[k]).otherwise(v).alias("text")) for k, v in fields.items()])
