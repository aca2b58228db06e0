"""The dictionary: responses as rows, cache leases, links of a notice, and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.spans import changes_in_order
from placard.operators.jobs import cache_status, fold_status, wait_seconds

VIEW = "channel struct<total: long, item: struct<target_code: string, word_info: struct<word: string, pos_info: array<struct<pos_code: string, pos: string, comm_pattern_info: array<struct<sense_info: array<struct<sense_code: string, definition: string>>>>>>>>>"
LEASE_SECONDS, LONG_COOLDOWN, SHORT_COOLDOWN = 180, 60, 5


def entries(responses: DataFrame) -> DataFrame:
    """responses (query_word, body) to one row for each sense of entries whose headword is the query's, marks aside."""
    item = responses.withColumn("v", F.from_json("body", VIEW)).select("query_word", F.col("v.channel.item").alias("item"))
    word = F.regexp_replace("item.word_info.word", r"[-^ㆍ]|\d+$", "")
    whole = item.filter(word == F.col("query_word")).select("query_word", F.col("item.target_code").alias("target_code"), F.posexplode("item.word_info.pos_info").alias("pos_no", "p"))
    patterns = whole.select("query_word", "target_code", "pos_no", F.col("p.pos").alias("pos"), F.posexplode("p.comm_pattern_info").alias("pattern_no", "c"))
    senses = patterns.select("query_word", "target_code", "pos_no", "pos", "pattern_no", F.posexplode("c.sense_info").alias("sense_no", "s"))
    return senses.select("query_word", "target_code", "pos", "pos_no", "pattern_no", "sense_no", F.col("s.sense_code").alias("sense_code"), F.col("s.definition").alias("definition"))


def response_errors(responses: DataFrame, page_size: int = 100) -> DataFrame:
    """query_word and error of searches (query_word, page, total, codes: the entries' numbers of one page): total_changed, page_short, code_repeated; null where whole."""
    each = responses.groupBy("query_word").agg(F.min("total").alias("low"), F.max("total").alias("high"), F.sum(F.size("codes")).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("distinct"))
    error = F.when(F.col("low") != F.col("high"), "total_changed").when(F.col("n") != F.col("high"), "page_short").when(F.col("distinct") != F.col("n"), "code_repeated")
    return each.select("query_word", error.alias("error"), F.ceil(F.col("high") / page_size).alias("pages"))


def mapped(candidates: DataFrame) -> DataFrame:
    """candidates (notice_id, start, end, changes: array of start, end, replacement in order, easy_text, rewritten) with easy_start, easy_end, easy_expression and mapping_status.

    A change that reaches over a candidate's end leaves nothing to point at;
    nor does a rewrite, which isn't aligned with the original at all.
    """
    grown = lambda upto: F.aggregate(F.filter("changes", upto), F.lit(0).cast("long"), lambda d, c: d + F.length(c["replacement"]) - (c["end"] - c["start"]))
    touching = F.filter("changes", lambda c: (c["start"] < F.col("end")) & (c["end"] > F.col("start")))
    crossing = F.exists(touching, lambda c: (c["start"] < F.col("start")) | (c["end"] > F.col("end"))) | F.coalesce("rewritten", F.lit(False))
    start, end = F.col("start") + grown(lambda c: c["end"] <= F.col("start")), F.col("end") + grown(lambda c: c["start"] < F.col("end"))
    placed = candidates.withColumns({"easy_start": F.when(~crossing, start), "easy_end": F.when(~crossing, end), "mapping_status": F.when(crossing, "original_only").when(F.size(touching) > 0, "replaced").otherwise("unchanged")})
    return placed.withColumn("easy_expression", F.expr("substr(easy_text, cast(easy_start + 1 as int), cast(easy_end - easy_start as int))"))


def save_links(current: DataFrame, batch: DataFrame, easy_texts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, refused rows) of links (notice_id, easy_text_token, candidates, generated_at).

    A row is taken if its easy text still has the token that was read, and its
    candidates are those that the stored text gives (easy_texts: notice_id, token, candidates).
    """
    known = easy_texts.select("notice_id", F.col("token").alias("_token"), F.col("candidates").alias("_candidates"))
    judged = batch.join(known, "notice_id", "left").withColumn("_taken", F.coalesce((F.col("easy_text_token") == F.col("_token")) & F.col("candidates").eqNullSafe(F.col("_candidates")), F.lit(False)))
    taken = judged.filter("_taken").withColumn("generated_at", now).select(*current.columns)
    return current.join(taken.select("notice_id"), "notice_id", "left_anti").unionByName(taken), judged.filter("not _taken").select(*batch.columns)


def due_notices(resolved: DataFrame, links: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the next notices whose dictionary is to be completed, one row: how many aren't complete).

    resolved: as of ``notice_dictionary``; links: notice_id, generated_at. Never
    linked ones come first; one that waits for a lease or cooldown isn't due.
    """
    open_ = resolved.filter(F.col("status").isin("pending", "partial"))
    ready = F.col("candidates").isNull() | F.exists("candidates", lambda c: c["cache_state"] == "unprocessed")
    due = open_.filter(ready).join(links.select("notice_id", "generated_at").distinct(), "notice_id", "left").orderBy(F.col("generated_at").asc_nulls_first(), "notice_id").limit(limit).select("notice_id")
    return due, open_.agg(F.count("*").alias("incomplete"))


def aligned(text: Column, title: Column, candidates: Column) -> Column:
    """Whether candidates (start, end, original, query_word, lookup_status) can be shown in title and body: in order, after the title, where they say. Nothing is guessed: one that doesn't fit spoils all."""
    offset = F.length(title) + 1
    here = F.forall(candidates, lambda c: (F.substr(text, (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int")) == c["original"]) & (c["original"] != "") & (c["query_word"] != "") & c["lookup_status"].isin("found", "not_found", "pending", "failed") & (c["start"] >= offset))
    return F.coalesce(here & changes_in_order(candidates, F.length(text).cast("long")), F.lit(False))


def shown_status(status: Column, text: Column, title: Column, candidates: Column) -> Column:
    """What an app shows: failed where candidates don't fit, partial if one failed, pending if one waits while the rest is complete."""
    some = lambda s: F.exists(candidates, lambda c: c["lookup_status"] == s)
    return F.when(candidates.isNull(), F.when(status == "complete", "failed").otherwise(status)).when(~aligned(text, title, candidates), "failed").when(some("failed"), "partial").when(some("pending") & (status == "complete"), "pending").otherwise(status)


def result_valid(query_word: Column, version: Column, status: Column, entries: Column, asked: Column, contract: str = "stdict-v1") -> Column:
    """Whether a stored result is the asked word's, of this contract, and found just if it has entries (target_code, word, senses), each with a number and a sense."""
    whole = F.forall(entries, lambda e: (F.trim(e["target_code"]) != "") & (F.trim(e["word"]) != "") & (F.size(e["senses"]) > 0) & F.forall(e["senses"], lambda x: F.trim(x) != ""))
    return F.coalesce((query_word == asked) & (version == contract) & status.isin("found", "not_found") & ((status == "found") == (F.size(entries) > 0)) & whole, F.lit(False))


def claim_lookups(cache: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """cache (cache_key, result, lease_token, lease_expires_at, retry_after_at) after leases for wanted keys (cache_key, token) that have no result, live lease or cooldown."""
    joined = cache.alias("c").join(wanted.alias("w"), F.col("c.cache_key") == F.col("w.cache_key"), "full_outer")
    free = F.col("c.result").isNull() & ~F.coalesce(F.col("c.lease_expires_at") > now, F.lit(False)) & ~F.coalesce(F.col("c.retry_after_at") > now, F.lit(False))
    takes = F.col("w.cache_key").isNotNull() & free
    return joined.select(
        F.coalesce("c.cache_key", "w.cache_key").alias("cache_key"), F.col("c.result").alias("result"), F.when(takes, F.col("w.token")).otherwise(F.col("c.lease_token")).alias("lease_token"),
        F.when(takes, F.timestamp_add("SECOND", F.lit(LEASE_SECONDS), now)).otherwise(F.col("c.lease_expires_at")).alias("lease_expires_at"), F.when(takes, None).otherwise(F.col("c.retry_after_at")).alias("retry_after_at"),
    )


def finish_lookups(cache: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """cache after done rows (cache_key, token, result, error): only the lease's holder may write; an error starts a cooldown."""
    joined = cache.alias("c").join(done.alias("d"), F.col("c.cache_key") == F.col("d.cache_key"), "left")
    holds = F.coalesce(F.col("c.lease_token") == F.col("d.token"), F.lit(False))
    wait = F.when(F.col("d.error").isin("permanent", "rate_limited"), LONG_COOLDOWN).otherwise(SHORT_COOLDOWN)
    return joined.select(
        "c.cache_key", F.when(holds & F.col("d.error").isNull(), F.col("d.result")).otherwise(F.col("c.result")).alias("result"), F.when(holds, None).otherwise(F.col("c.lease_token")).alias("lease_token"),
        F.when(holds, None).otherwise(F.col("c.lease_expires_at")).alias("lease_expires_at"), F.when(holds & F.col("d.error").isNotNull(), F.timestamp_add("SECOND", wait, now)).otherwise(F.col("c.retry_after_at")).alias("retry_after_at"),
    )


def notice_dictionary(notices: DataFrame, links: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """notices (notice_id) with status, candidates in order with their state, and retry_after seconds.

    links: notice_id, ordinal, cache_key; cache: cache_key, n_entries,
    lease_expires_at, retry_after_at. A notice without links is unprocessed.
    """
    stated = cache_status(links, cache, ["cache_key"], now)
    wait = F.max(wait_seconds(F.coalesce("retry_after_at", "lease_expires_at"), now))
    grouped = stated.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "cache_key", "cache_state"))).alias("candidates"), wait.alias("retry_after"))
    status = F.when(F.col("candidates").isNull(), "unprocessed").otherwise(fold_status(F.transform("candidates", lambda c: c["cache_state"])))
    return notices.select("notice_id").join(grouped, "notice_id", "left").withColumn("status", status)
