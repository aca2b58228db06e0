"""Audits of what summary cards say against the source: sets of facts, compared for each notice and card.

A card and its source text become sets of dates, times, sums and ages; the
reason codes are differences of these sets. A grounded date is one whose kind
the source names next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.extract import age_bounds, age_values, date_tokens, money_tokens, time_tokens

# The words by which a source names a schedule's kind, and other rule words.
KIND_WORDS = {
    "application": "신청|접수|모집", "event": "행사|축제|공연|개최|일시|캠프|전시|체험", "operation": "수업|운영|교육|강좌", "payment": "납부|결제|입금", "submission": "제출|보완|서류",
    "effective": "시행|적용|개정", "disruption": "통제|휴관|중단", "result": "결과|발표|선정|합격",
}
FREE = r"(?:무료|무상)(?!\s*(?:가|는|이)?\s*(?:아니|아닌|아님))|비용\s*(?:이|은)?\s*없"
WAIVER = "무료|무상|면제|감면|지원"
FEE_WORD = "참가비|수강료|이용료|비용|요금|회비|납부|지원금|지원액|수당|보조금"
REQUIRED = "반드시|필수|의무"
OPTIONAL = r"선택(?!\s*(?:이|은|이)?\s*(?:아니|아닌|아님))|하지\s*않아도|안\s*해도|생략(?:할\s*수|해도)"
NOT_REQUIRED = r"필수(?:가|는|로)?\s*(?:아니|아님)|의무(?:가|는)?\s*(?:아니|없)"
CLAUSE_END, PARTICLE = r"[\n.!?;；]", r"(?:은|는|이|가|을|를|에|의|와|과|도)$"
#: Words of a requirement that name no document or action.
GENERIC = ("신청", "신청자", "참여", "참여자", "제출", "준비", "필수", "의무", "반드시", "할일", "사람", "대상자", "해야", "필요", "여부", "행동")
POLITE = r"(?:니다|세요|십시오|까요|어요|아요|예요|이에요)[.!?]?$"


def with_facts(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """rows with the text's dates, times, sums and ages under the prefix."""
    t = F.coalesce(text, F.lit(""))
    return rows.withColumns({f"{prefix}_dates": date_tokens(t), f"{prefix}_times": time_tokens(t, bare=True), f"{prefix}_sums": money_tokens(t), f"{prefix}_ages": age_values(t), f"{prefix}_bounds": age_bounds(t)})


def _more(left: str, right: str) -> Column:
    return F.size(F.array_except(left, right)) > 0


def _bound_changed() -> Column:
    """Whether the card bounds an age that the source bounds, but otherwise."""
    age = lambda b: F.regexp_extract(b, "[0-9]+", 0)
    return F.exists(F.array_except("card_bounds", "source_bounds"), lambda c: F.exists("source_bounds", lambda s: age(s) == age(c)))


def _weakened(card: Column, source: Column) -> Column:
    """Whether the card makes optional what the source requires: in a clause on one of the source's own nouns, or where it requires nothing else."""
    weak = F.filter(F.split(card, CLAUSE_END), lambda c: c.rlike(NOT_REQUIRED) | c.rlike(OPTIONAL))
    words = F.transform(F.regexp_extract_all(source, F.lit("[가-힣]{2,}"), F.lit(0)), lambda w: F.regexp_replace(w, PARTICLE, ""))
    nouns = F.filter(F.array_except(words, F.array(*map(F.lit, GENERIC))), lambda w: w != "")
    named = F.exists(nouns, lambda n: F.exists(weak, lambda c: F.contains(c, n)))
    return source.rlike(REQUIRED) & (F.size(weak) > 0) & (named | ~card.rlike(REQUIRED))


def _false_free(card: Column, source: Column, sums: Column) -> Column:
    """Whether the card says that what costs something is free, and the source tells of no waiver at all."""
    return source.rlike(FEE_WORD) & F.exists(sums, lambda s: s > 0) & card.rlike(FREE) & ~source.rlike(WAIVER)


def audit_cards(cards: DataFrame) -> DataFrame:
    """cards (notice_id, card, card_text, source_text) with reasons: sorted codes of what the card adds, omits or changes.

    source_text is the card's own matched evidence; a card without any is
    reported as such only.
    """
    rows = with_facts(with_facts(cards, "card_text", "card"), "source_text", "source")
    card = F.col("card")
    fee, free = F.col("source_text").rlike(FEE_WORD), F.col("card_text").rlike(FREE)
    # That something is free says as much as a sum of zero.
    stated = F.when(free & F.array_contains("source_sums", F.lit(0).cast("decimal(28,4)")), F.array_append("card_sums", F.lit(0).cast("decimal(28,4)"))).otherwise(F.col("card_sums"))
    checks = {
        "age_added": card.isin("audience", "notes") & _more("card_ages", "source_ages"),
        "age_omitted": card.isin("audience", "notes") & _more("source_ages", "card_ages"),
        "age_bound_changed": card.isin("audience", "notes") & _bound_changed(),
        "date_added": (card == "deadline") & _more("card_dates", "source_dates"),
        "time_added": (card == "deadline") & _more("card_times", "source_times"),
        "end_time_omitted": (card == "deadline") & (F.size("card_times") > 0) & (F.size("source_times") > F.size("card_times")),
        "range_reversed": (card == "deadline") & (F.size("card_dates") > 1) & F.exists("card_dates", lambda d: d < F.get("card_dates", F.lit(0))),
        "amount_added": _more("card_sums", "source_sums") & ((card == "action") | (card == "notes") & (fee | F.col("card_text").rlike(FEE_WORD))),
        "amount_omitted": (card == "notes") & fee & (F.size(F.array_except("source_sums", stated)) > 0),
        "required_weakened": (card == "action") & _weakened(F.col("card_text"), F.col("source_text")),
        "false_free": (card == "notes") & _false_free(F.col("card_text"), F.col("source_text"), F.col("source_sums")),
    }
    codes = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.concat(F.lit("card_"), card, F.lit(f"_{name}"))) for name, c in checks.items()])
    missing = F.trim(F.coalesce("source_text", F.lit(""))) == ""
    reasons = F.when(missing, F.array(F.concat(F.lit("card_"), card, F.lit("_source_missing")))).otherwise(F.array_sort(F.array_compact(codes)))
    return rows.withColumn("reasons", reasons).select(*cards.columns, "reasons")


def missing_cards(summaries: DataFrame, key: str, needed: tuple[str, ...], evidence: str) -> DataFrame:
    """key and the needed fields for which a summary has no evidence."""
    return summaries.select(key, F.array_sort(F.array_except(F.array(*map(F.lit, needed)), F.transform(evidence, lambda e: e["field"]))).alias("missing"))


#: Fields that a notice's title may prove.
BY_TITLE = ("summary", "category", "category_code")


def valid_evidence(evidence: Column, body: Column, title: Column, media: Column) -> Column:
    """Those of evidence (field, excerpt, source_type, source_id) that hold: text that stands in the body, or for some fields in the title; files that were sent (media: array of ids)."""
    stated = lambda e: F.trim(e["excerpt"]) != ""
    in_text = lambda e: (e["source_type"] == "text") & e["source_id"].isNull() & (F.contains(body, e["excerpt"]) | (e["field"].isin(*BY_TITLE) & F.contains(title, e["excerpt"])))
    in_file = lambda e: e["source_type"].isin("document", "image") & F.array_contains(media, e["source_id"])
    return F.filter(evidence, lambda e: F.coalesce(stated(e) & (in_text(e) | in_file(e)), F.lit(False)))


def ground_dates(dates: DataFrame) -> DataFrame:
    """dates (notice_id, kind, start_date, end_date, block) with verdict.

    block is the source's schedule line. ok needs both ends among the block's
    dates and, if the block names kinds at all, the date's own kind among them.
    """
    found = dates.withColumn("_in", date_tokens(F.coalesce("block", F.lit(""))))
    here = lambda c: F.col(c).isNull() | F.array_contains("_in", F.col(c))
    named = F.array_compact(F.array(*[F.when(F.col("block").rlike(w), k) for k, w in KIND_WORDS.items()]))
    verdict = (
        F.when(F.col("end_date") < F.col("start_date"), "reversed").when(~(here("start_date") & here("end_date")), "date_not_in_source")
        .when((F.size(named) > 0) & ~F.array_contains(named, F.col("kind")), "kind_not_in_source").otherwise("ok")
    )
    return found.withColumn("verdict", F.coalesce(verdict, F.lit("date_not_in_source"))).drop("_in")


def is_polite(text: Column) -> Column:
    """Whether every sentence ends politely; quoted parts don't count."""
    plain = F.regexp_replace(text, "\"[^\"]*\"|'[^']*'|“[^”]*”|‘[^’]*’", "")
    sentences = F.filter(F.split(plain, r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s) != "")
    return (F.size(sentences) > 0) & F.forall(sentences, lambda s: F.regexp_replace(s, r"\s+$", "").rlike(POLITE))
