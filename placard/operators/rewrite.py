"""Easy texts: checks of a rewrite against its source, and guarded saves."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placard.functions.text import link_tokens, number_tokens

# The limits of a rewrite, the symbols it may not use outside quotes, and how far it may copy.
LIMITS = {"sentence": 80, "heading_low": 2, "heading_high": 25, "intro": 3, "sections": 6, "sentences": 8}
FORBIDDEN, QUOTED = "[「」·*※]", r"'[^'\n]*'|‘[^’\n]*’"
LEAST_EVIDENCE, LEAST_BODY, COPIED_SENTENCE = 5, 100, 10
COPY_RATIO, SENTENCE_RATIO = 0.8, 0.9


@F.pandas_udf(T.DoubleType())
def copy_ratio(text: pd.Series, source: pd.Series) -> pd.Series:
    """How much of two texts is the same in the same order, from 0 to 1 (no built-in function matches blocks)."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(text, source, strict=True)])


@F.pandas_udf(T.DoubleType())
def most_copied(sentences: pd.Series, evidence: pd.Series) -> pd.Series:
    """The greatest copy ratio of a sentence and one of its own excerpts."""
    pairs = lambda ss, es: (SequenceMatcher(None, s, e).ratio() for s, own in zip(ss, es, strict=True) for e in own)
    return pd.Series([max(pairs(s, e), default=0.0) for s, e in zip(sentences, evidence, strict=True)])


def rewrite_errors(body: Column, others: Column, sentences: Column, least_body: int = LEAST_BODY) -> Column:
    """Sorted codes of what is wrong with a rewrite of a body; the rewrite is refused whole.

    sentences: array of text and evidence (array of excerpts); others: the
    headline, headings and hint.
    """
    whole = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    evidence = F.flatten(F.transform(sentences, lambda s: s["evidence"]))
    texts = F.transform(sentences, lambda s: s["text"])
    beyond = lambda text, source: F.size(F.array_except(number_tokens(text), number_tokens(source))) > 0
    rewritten = F.array_join(texts, "\n")
    long = F.length(body) >= least_body
    codes = {
        "quote_short": F.exists(evidence, lambda q: (F.length(q) < LEAST_EVIDENCE) & (q != whole)),
        "quote_not_in_source": F.exists(evidence, lambda q: ~F.contains(body, q)),
        "number_added": F.exists(sentences, lambda s: beyond(s["text"], F.array_join(s["evidence"], " "))) | F.exists(others, lambda t: beyond(t, body)),
        "symbol": F.exists(F.concat(others, texts), lambda t: F.regexp_replace(t, QUOTED, "").rlike(FORBIDDEN)),
        "copied": long & ((copy_ratio(rewritten, body) >= COPY_RATIO) | F.exists(texts, lambda t: (F.length(t) >= COPIED_SENTENCE) & F.contains(body, t)) | (most_copied(texts, F.transform(sentences, lambda s: s["evidence"])) >= SENTENCE_RATIO)),
        "longer_than_source": long & (F.length(rewritten) > F.length(body)),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in codes.items()])))


def unsupported(text: Column, body: Column, quotes: Column) -> Column:
    """Sorted codes of the second check of a text: quotes that aren't in the body, and numbers or links that it lacks."""
    codes = {
        "quote_not_in_source": F.exists(quotes, lambda q: ~F.contains(body, q)), "number_added": F.size(F.array_except(number_tokens(text), number_tokens(body))) > 0,
        "link_added": F.size(F.array_except(link_tokens(text), link_tokens(body))) > 0,
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in codes.items()])))


def structure_errors(intro: Column, sections: Column) -> Column:
    """Sorted codes of limits that a rewrite's structure breaks; sections: array of heading, style, sentences."""
    long = lambda xs: F.exists(xs, lambda x: F.length(x) > LIMITS["sentence"])
    heading = F.exists(sections, lambda s: ~F.length(s["heading"]).between(LIMITS["heading_low"], LIMITS["heading_high"]) | ~s["heading"].endswith("?"))
    codes = {
        "intro": F.size(intro) > LIMITS["intro"], "sections": ~F.size(sections).between(1, LIMITS["sections"]), "heading": heading, "style": F.exists(sections, lambda s: ~s["style"].isin("paragraph", "steps")),
        "sentences": F.exists(sections, lambda s: ~F.size(s["sentences"]).between(1, LIMITS["sentences"])), "sentence": long(intro) | F.exists(sections, lambda s: long(s["sentences"])),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in codes.items()])))


def save_easy_texts(current: DataFrame, batch: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, refused rows) of easy texts (notice_id, notice_revision, source_hash, easy_text, model, prompt_version, generated_at, token).

    A row is taken if its revision is the notice's and its hash is that of the
    notice's own text, and if nothing is stored, or the stored row is of another
    revision, or is older and of the same generation (model and prompt), or is
    of another generation and still has the token that the writer read
    (expected_token). Where a writer read one, the token has to be that in any case.
    """
    facts = notices.select("notice_id", "content_revision", F.sha2("original_text", 256).alias("true_hash"))
    stored = current.select("notice_id", *[F.col(c).alias(f"old_{c}") for c in ("notice_revision", "model", "prompt_version", "generated_at", "token")])
    joined = batch.join(facts, "notice_id", "left").join(stored, "notice_id", "left")
    own = (F.col("notice_revision") == F.col("content_revision")) & (F.col("source_hash") == F.col("true_hash"))
    generation = (F.col("old_model") == F.col("model")) & (F.col("old_prompt_version") == F.col("prompt_version"))
    holds = F.col("old_token") == F.col("expected_token")
    wins = (F.col("old_notice_revision") != F.col("notice_revision")) | (generation & (F.col("old_generated_at") < F.col("generated_at"))) | (~generation & holds)
    taken_if = F.col("old_notice_revision").isNull() | (F.coalesce(wins, F.lit(False)) & (F.col("expected_token").isNull() | F.coalesce(holds, F.lit(False))))
    judged = joined.withColumn("_taken", F.coalesce(own & taken_if, F.lit(False)))
    taken = judged.filter("_taken").select(*current.columns)
    return current.join(taken.select("notice_id"), "notice_id", "left_anti").unionByName(taken), judged.filter("not _taken").select(*batch.columns)


def fill_scopes(current: DataFrame, asked: DataFrame, notices: DataFrame) -> DataFrame:
    """current easy texts with body_text_present and attachment_content_included where they weren't known.

    Only rows that asked (notice_id, expected_token) still knows, of the
    notice's own revision and text (notices: notice_id, revision, title, body),
    with a body, are filled; others stay.
    """
    text = F.concat_ws("\n", "title", F.nullif("body", F.lit("")))
    own = notices.filter("coalesce(body, '') <> ''").select("notice_id", F.col("revision").alias("_revision"), text.alias("_text"))
    joined = current.join(asked.select("notice_id", F.col("expected_token").alias("_token")), "notice_id", "left").join(own, "notice_id", "left")
    fits = (F.col("token") == F.col("_token")) & (F.col("notice_revision") == F.col("_revision")) & (F.col("original_text") == F.col("_text")) & F.col("body_text_present").isNull() & F.col("attachment_content_included").isNull()
    fills = F.coalesce(fits, F.lit(False))
    values = {"body_text_present": F.when(fills, True).otherwise(F.col("body_text_present")), "attachment_content_included": F.when(fills, False).otherwise(F.col("attachment_content_included"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in current.columns])


def preserves_title(title: Column, original: Column, easy: Column, changes: Column) -> Column:
    """Whether an easy text keeps its title: both texts begin with it and go on, and no change (start) reaches into it."""
    prefix = F.concat(title, F.lit("\n"))
    goes_on = lambda text: text.startswith(prefix) & F.substr(text, F.length(prefix) + 1).rlike(r"\S")
    return F.coalesce(goes_on(original) & goes_on(easy) & F.forall(changes, lambda c: c["start"] >= F.length(prefix)), F.lit(False))


def candidates_valid(original: Column, candidates: Column, body_start: Column) -> Column:
    """Whether dictionary candidates (original, query_word, context, start, end) stand in order, where they say and in their context; null is valid."""
    sized = lambda x, most: F.length(x).between(1, most)
    here = lambda c: F.substr(original, (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int")) == c["original"]
    begin = lambda c: c["start"] - F.instr(c["context"], c["original"]) + 1
    around = lambda c: (F.instr(c["context"], c["original"]) > 0) & (begin(c) >= body_start) & (F.substr(original, (begin(c) + 1).cast("int"), F.length(c["context"])) == c["context"])
    shaped = F.forall(candidates, lambda c: sized(c["original"], 100) & sized(c["query_word"], 100) & sized(c["context"], 100_000) & (F.trim(c["original"]) != "") & (F.trim(c["query_word"]) != "") & here(c) & around(c))
    last = F.aggregate(candidates, body_start.cast("long"), lambda at, c: F.when((at >= 0) & (c["start"] >= at) & (c["end"] > c["start"]) & (c["end"] <= F.length(original)), c["end"]).otherwise(F.lit(-1).cast("long")))
    return F.when(candidates.isNull(), True).otherwise(F.coalesce((last >= 0) & shaped, F.lit(False)))


def clear_stale(old: DataFrame, new: DataFrame, key: str, derived: tuple[str, ...], basis: tuple[str, ...]) -> DataFrame:
    """new with derived columns set to null where a basis column changed and the derived one did not."""
    before = old.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_old_{c}") for c in (*derived, *basis)])
    joined = new.join(before, F.col(key) == F.col("_key"), "left")
    changed = F.lit(False)
    for c in basis:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    stale = F.col("_key").isNotNull() & changed
    return joined.select(*[F.when(stale & F.col(c).eqNullSafe(F.col(f"_old_{c}")), None).otherwise(F.col(c)).alias(c) if c in derived else F.col(c) for c in new.columns])
