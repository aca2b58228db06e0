"""The work queue: who needs work, who may be claimed, when to try again, and the dictionary cache's states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.identity import contract_key, revision_hash
from placard.operators.rewrite import candidates_valid, preserves_title

STATES = ("pending", "running", "succeeded", "skipped", "blocked", "retry_wait", "exhausted")


def due(now: Column) -> Column:
    """Whether a job's own state lets it be worked on."""
    state = F.col("state")
    return state.isin("pending", "succeeded") | ((state == "retry_wait") & (F.col("next_attempt_at") <= now)) | ((state == "running") & (F.col("lease_expires_at") <= now))


def inputs(notices: DataFrame, summaries: DataFrame, easy_texts: DataFrame, summary: tuple[str, str], easy: tuple[str, str]) -> DataFrame:
    """notice_id, feature, input_version, contract_key and ready of every visible notice and feature.

    summary and easy are (model, prompt version). A summary is ready if it is
    finished and made of the notice's revision by this model and prompt; an easy
    text also has to be complete and keep title and candidates in place.
    """
    shown = notices.filter("is_visible").select("id", "title", "body_html", "content_revision")
    key = lambda c: contract_key(F.lit(c[0]), F.lit(c[1]))
    made = lambda c: (F.col("model") == c[0]) & (F.col("prompt_version") == c[1])
    done = summaries.select(F.col("notice_id").alias("id"), (F.col("status").isin("summarized", "needs_review") & F.col("result").isNotNull() & made(summary)).alias("_done"), "source_revision")
    first = shown.join(done, "id", "left").select(
        F.col("id").alias("notice_id"), F.lit("summary").alias("feature"), F.col("content_revision").cast("string").alias("input_version"), key(summary).alias("contract_key"),
        F.coalesce(F.col("_done") & (F.col("source_revision") == F.col("content_revision")), F.lit(False)).alias("ready"),
    )
    revision = revision_hash(F.col("title"), F.col("body_html"))
    whole = F.col("dictionary_candidates").isNotNull() & F.col("easy_result").isNotNull() & F.col("body_text_present") & ~F.col("attachment_content_included")
    kept = preserves_title(F.col("title"), F.col("original_text"), F.col("easy_text"), F.col("changes")) & candidates_valid(F.col("original_text"), F.col("dictionary_candidates"), F.length("title") + 1)
    second = shown.join(easy_texts.withColumnRenamed("notice_id", "id"), "id", "left").select(
        F.col("id").alias("notice_id"), F.lit("easy_text").alias("feature"), revision.alias("input_version"), key(easy).alias("contract_key"),
        F.coalesce((F.col("notice_revision") == revision) & made(easy) & whole & kept, F.lit(False)).alias("ready"),
    )
    return first.unionByName(second)


def candidates(inputs: DataFrame, jobs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """inputs (notice_id, feature, input_version, contract_key, ready) that need work, in the queue's order.

    An unknown readiness counts as not ready. A job counts as stale if its
    input or contract is another one.
    """
    queued = jobs.select("notice_id", "feature", "state", "next_attempt_at", "lease_expires_at", "updated_at", F.col("input_version").alias("job_version"), F.col("contract_key").alias("job_contract"))
    joined = inputs.filter(~F.coalesce("ready", F.lit(False))).join(queued, ["notice_id", "feature"], "left")
    stale = (F.col("job_version") != F.col("input_version")) | (F.col("job_contract") != F.col("contract_key"))
    chosen = joined.filter(F.col("state").isNull() | stale | F.coalesce(due(now), F.lit(False)))
    ordered = chosen.withColumn("since", F.coalesce("next_attempt_at", "updated_at")).orderBy(F.col("since").asc_nulls_first(), "notice_id", "feature")
    return (ordered.limit(limit) if limit else ordered).select("notice_id", "feature", "input_version", "contract_key", "state")


def enqueue(jobs: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of jobs: chosen ones are pending; attempts start anew if input or contract changed or a success vanished."""
    old, new = jobs.alias("j"), chosen.select("notice_id", "feature", "input_version", "contract_key").alias("c")
    joined = old.join(new, (F.col("j.notice_id") == F.col("c.notice_id")) & (F.col("j.feature") == F.col("c.feature")), "full_outer")
    asked, fresh = F.col("c.notice_id").isNotNull(), F.col("j.notice_id").isNull()
    anew = asked & (fresh | (F.col("j.input_version") != F.col("c.input_version")) | (F.col("j.contract_key") != F.col("c.contract_key")) | (F.col("j.state") == "succeeded"))
    reset = F.coalesce(anew, F.lit(False))
    return joined.select(
        *[F.coalesce(f"c.{c}", f"j.{c}").alias(c) for c in ("notice_id", "feature", "input_version", "contract_key")],
        F.when(reset, "pending").otherwise(F.col("j.state")).alias("state"),
        F.when(reset, 0).otherwise(F.col("j.attempts")).alias("attempts"),
        *[F.when(reset, None).otherwise(F.col(f"j.{c}")).alias(c) for c in ("next_attempt_at", "lease_expires_at", "last_error_code")],
        F.when(asked, now).otherwise(F.col("j.updated_at")).alias("updated_at"),
    )


def claim(jobs: DataFrame, now: Column, lease_seconds: int, most_attempts: int, limit: int | None = None, run: str = "", ready: DataFrame | None = None) -> DataFrame:
    """jobs after a claim: the first ``limit`` due ones that may still be tried are running, with a lease and the run's token.

    Due are pending jobs, retries whose time has come and runs whose lease ended,
    in the order of that time (or of their last update), notice and feature. A due job whose
    result is there (ready: notice_id, feature) has succeeded; one at the cap of attempts is exhausted.
    """
    marked = jobs.join(ready.select("notice_id", "feature", F.lit(True).alias("_ready")).distinct(), ["notice_id", "feature"], "left") if ready is not None else jobs.withColumn("_ready", F.lit(None).cast("boolean"))
    asked = marked.withColumn("_due", F.coalesce(due(now) & (F.col("state") != "succeeded"), F.lit(False))).withColumn("_tries", F.col("_due") & F.col("_ready").isNull() & (F.col("attempts") < most_attempts))
    chosen = asked.filter("_tries").orderBy(F.coalesce("next_attempt_at", "updated_at").asc_nulls_last(), "notice_id", "feature")
    taken = (chosen.limit(limit) if limit is not None else chosen).select("notice_id", "feature", F.lit(True).alias("_taken"))
    joined = asked.join(taken, ["notice_id", "feature"], "left")
    runs, settled = F.coalesce("_taken", F.lit(False)), F.col("_due") & ~F.col("_tries")
    reason = F.when(F.col("state") == "running", "processing_lease_expired").otherwise(F.coalesce("last_error_code", F.lit("processing_attempts_exhausted")))
    token = F.sha2(F.concat_ws(":", F.lit(run), F.col("notice_id").cast("string"), "feature"), 256)
    pick = lambda name, running, closed: F.when(runs, running).when(settled, closed).otherwise(F.col(name)).alias(name)
    new = {
        "state": pick("state", F.lit("running"), F.when(F.col("_ready"), "succeeded").otherwise("exhausted")), "attempts": F.when(runs, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        "lease_expires_at": pick("lease_expires_at", F.timestamp_add("SECOND", F.lit(lease_seconds), now), F.lit(None)), "next_attempt_at": pick("next_attempt_at", F.lit(None), F.lit(None)),
        "claim_token": pick("claim_token", token, F.lit(None)) if "claim_token" in jobs.columns else F.when(runs, token).alias("claim_token"),
        "last_error_code": pick("last_error_code", F.col("last_error_code"), F.when(F.col("_ready"), None).otherwise(reason)), "updated_at": pick("updated_at", now, now),
    }
    return joined.select(*[new.pop(c, F.col(c)) for c in jobs.columns], *[new[c] for c in ("claim_token",) if c in new])


def retry_seconds(attempts: Column) -> Column:
    """Seconds to wait after so many attempts, before any jitter: 30, 60, 120 and so on up to an hour."""
    return F.least(F.lit(3600), F.lit(30) * F.pow(F.lit(2), F.least(attempts - 1, F.lit(10)))).cast("long")


def wait_seconds(until: Column, now: Column) -> Column:
    """Whole seconds until a time, rounded up, from 0 to 3600; null without one."""
    return F.when(until.isNotNull(), F.least(F.lit(3600), F.greatest(F.lit(0), F.ceil((F.unix_micros(until) - F.unix_micros(now)) / 1_000_000)))).cast("long")


def state_counts(jobs: DataFrame, states: tuple[str, ...] = STATES, column: str = "state") -> DataFrame:
    """state and n, with a row for each state."""
    every = jobs.sparkSession.createDataFrame([(s,) for s in states], "state string")
    counted = jobs.groupBy(F.col(column).alias("state")).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(counted.filter(F.col("state").isin(*states))), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cache_status(candidates: DataFrame, cache: DataFrame, key: list[str], now: Column) -> DataFrame:
    """candidates with cache_state: found, not_found, waiting (leased), cooling or unprocessed."""
    joined = candidates.join(cache, key, "left")
    state = (
        F.when(F.col("n_entries") > 0, "found").when(F.col("n_entries") == 0, "not_found").when(F.col("lease_expires_at") > now, "waiting")
        .when(F.col("retry_after_at") > now, "cooling").otherwise("unprocessed")
    )
    return joined.withColumn("cache_state", state)


def fold_status(states: Column) -> Column:
    """unprocessed, pending, partial or complete: what the candidates' states come to."""
    done = F.size(F.filter(states, lambda s: s.isin("found", "not_found")))
    waits = F.exists(states, lambda s: s.isin("waiting", "cooling"))
    return F.when(done == F.size(states), "complete").when(done > 0, "partial").when(waits, "pending").otherwise("unprocessed")


def report(transitions: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """One row: a run's report as JSON, with how many jobs came to each state, sorted reasons of failures, and whether all went well."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in states]
    failed = F.col("state").isin("blocked", "exhausted", "retry_wait")
    sums = transitions.agg(F.count("*").alias("processed"), *counts, F.array_sort(F.collect_set(F.when(failed, F.col("reason_code")))).alias("reasons"), (F.count_if(failed) == 0).alias("complete"))
    return sums.select(F.to_json(F.struct(*sums.columns)).alias("report"))
