"""What readers see: list and detail views by role, keyset pages, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.identity import revision_hash
from placard.operators.review import display_status
from placard.operators.rewrite import candidates_valid, preserves_title

#: Columns that a reader without a role may select.
PUBLIC_LIST = ("id", "source_board", "title", "registered_on", "display_status", "category_code", "deadline_on")
EXCLUDED_GROUP = "other"


#: The columns that each role may select of a notice's own rows; what isn't named here is private to the service.
ROLES = {
    "reader": ("id", "category", "source_board", "dong_group", "is_pinned", "post_sn", "title", "department", "registered_on", "url", "body_text", "license_type", "is_modified", "content_updated_at"),
    "service": None,
}
#: Category codes that an app may ask for; None asks for notices without one.
CODES = tuple(range(1, 8))
MOST_IDS = 20


def for_role(notices: DataFrame, role: str) -> DataFrame:
    """The rows and columns of notices that a role sees: a reader visible notices and public columns, the service everything."""
    if role not in ROLES:
        raise ValueError(f"no role {role!r}")
    if ROLES[role] is None:
        return notices
    return visible(notices).select(*[c for c in ROLES[role] if c in notices.columns])


def filtered(view: DataFrame, source: str | None = None, code: int | None | str = "any", ids: list[int] | None = None, codes: tuple[int, ...] = CODES) -> DataFrame:
    """The app's filters: a source, a category code (None: notices without one, "any": all), a few ids. A code that isn't allowed is refused, not searched for."""
    if code not in (*codes, None, "any"):
        raise ValueError(f"category code {code!r} isn't allowed")
    if ids is not None and len(ids) > MOST_IDS:
        raise ValueError(f"at most {MOST_IDS} ids at a time")
    if source is not None:
        view = view.filter(F.col("source_board") == source)
    if code != "any":
        view = view.filter(F.col("category_code").isNull() if code is None else F.col("category_code") == code)
    return view if ids is None else view.filter(F.col("id").isin(*ids))


def visible(notices: DataFrame) -> DataFrame:
    """Visible notices, those of other districts left out; a null group stays."""
    return notices.filter(F.col("is_visible") & ~F.col("dong_group").eqNullSafe(F.lit(EXCLUDED_GROUP)))


def list_view(notices: DataFrame, summaries: DataFrame) -> DataFrame:
    """The public list: deadline only where the summary is done."""
    joined = visible(notices).join(summaries.withColumnRenamed("notice_id", "id").select("id", "status", "category_code", "deadline_on"), "id", "left")
    done = F.col("status") == "summarized"
    return joined.withColumn("display_status", display_status(F.col("status"))).withColumn("deadline_on", F.when(done, F.col("deadline_on"))).select(*PUBLIC_LIST)


LIST = ("id", "source", "dong_group", "is_pinned", "title", "department", "registered_on", "content_updated_at", "is_modified", "summary_status", "display_status", "notice_type", "category_code", "deadline_on", "headline", "card_summaries", "attachment_status", "has_easy_text")
NOTICE_FACTS, SUMMARY_FACTS = ("url", "license_type", "body_text"), ("result", "generated_at", "file_references", "preparation_omissions")
EASY_FACTS = {"original_text": "easy_original_text", "easy_text": "easy_text", "changes": "easy_changes", "body_text_present": "easy_body_text_present", "attachment_content_included": "easy_attachment_content_included", "generated_at": "easy_generated_at", "easy_result": "easy_result"}


def readable_easy_texts(easy_texts: DataFrame, notices: DataFrame) -> DataFrame:
    """Easy texts that readers may see: of visible notices, of their revision, with title and candidates in place."""
    shown = notices.filter("is_visible").select(F.col("id").alias("notice_id"), F.col("title").alias("_title"), revision_hash(F.col("title"), F.col("body_html")).alias("_revision"))
    kept = preserves_title(F.col("_title"), F.col("original_text"), F.col("easy_text"), F.col("changes")) & candidates_valid(F.col("original_text"), F.col("dictionary_candidates"), F.length("_title") + 1)
    return easy_texts.join(shown, "notice_id").filter((F.col("notice_revision") == F.col("_revision")) & kept).select(*easy_texts.columns)


def app_list(notices: DataFrame, summaries: DataFrame, easy_texts: DataFrame) -> DataFrame:
    """The app's list: every column it may select, the headline from the result's JSON, and whether there is an easy text."""
    facts = summaries.select(
        F.col("notice_id").alias("id"), F.col("status").alias("summary_status"), display_status(F.col("status"), F.size(F.coalesce("preparation_omissions", F.array()))).alias("display_status"),
        F.col("category").alias("notice_type"), "category_code", "deadline_on", F.get_json_object("result", "$.summary").alias("headline"), "card_summaries", "attachment_status",
    )
    easy = easy_texts.select(F.col("notice_id").alias("id"), F.lit(True).alias("_easy")).distinct()
    joined = visible(notices).withColumn("source", F.col("category")).join(facts, "id", "left").join(easy, "id", "left")
    return joined.withColumns({"display_status": F.coalesce("display_status", F.lit("none")), "has_easy_text": F.coalesce("_easy", F.lit(False))}).select(*LIST)


def app_detail(view: DataFrame, notices: DataFrame, summaries: DataFrame, easy_texts: DataFrame, files: DataFrame) -> DataFrame:
    """The list's columns with address, body, result, files in order and easy text."""
    s = summaries.select(F.col("notice_id").alias("id"), *SUMMARY_FACTS)
    e = easy_texts.select(F.col("notice_id").alias("id"), *[F.col(c).alias(n) for c, n in EASY_FACTS.items()])
    return with_files(view.join(notices.select("id", *NOTICE_FACTS), "id").join(s, "id", "left").join(e, "id", "left"), files)


def with_files(view: DataFrame, files: DataFrame) -> DataFrame:
    """view (id) with files (file, kind, url) in order of id; no files is an empty array."""
    grouped = files.groupBy(F.col("notice_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("file"), "kind", "url"))).alias("files"))
    return view.join(grouped, "id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<struct<file:long,kind:string,url:string>>")))


def detail_view(view: DataFrame, notices: DataFrame, files: DataFrame) -> DataFrame:
    """The list's columns, the body, and the files."""
    return with_files(view.join(notices.select("id", "body_text"), "id"), files)


# Names of categories and providers, and what the app says in place of what is missing.
CATEGORIES = {21: "교통", 22: "안전", 23: "주택", 24: "경제", 25: "환경", 26: "문화", 27: "복지", 30: "행정"}
PROVIDERS = {"dong": "월계1동 주민센터", "nowon": "노원구청", "seoul": "서울시"}
MISSING_CARD, OTHER_CATEGORY, NO_PROVIDER = "원문에서 확인", "기타", "정보제공처 미표시"
UNSUPPORTED_FILE, UNREAD_FILE = "지원하지 않는 파일 형식으로 요약에 포함되지 않았어요. 파일 원문을 확인해 주세요.", "읽지 못한 첨부 내용이 요약에서 빠져 있어요. 파일 원문을 확인해 주세요."
MESSAGES = {"needs_review": "원문 확인 요함", "pending": "요약을 준비하고 있습니다.", "failed": "요약을 생성하지 못했습니다. 원문을 확인하세요."}
OMITTED = "읽지 못한 자료가 있어요. 원문을 확인하세요."
CARDS = {"audience": "audience", "task": "action", "deadline": "deadline", "caution": "notes"}


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def category_name(code: Column) -> Column:
    return F.coalesce(_lookup(CATEGORIES, code.cast("int")), F.lit(OTHER_CATEGORY))


def http_url(url: Column) -> Column:
    """The address if it is plain http(s) without a user, else null."""
    return F.when(url.rlike(r"(?i)^https?://[^/?#@\s]+(?:[/?#]|$)"), url)


def app_notices(rows: DataFrame) -> DataFrame:
    """Rows of the app's views as the app shows them; error is "contract" where a row can't be shown.

    rows: id, source, title, department, registered_on (text), display_status,
    category_code, deadline_on (text), headline, card_summaries (struct).
    """
    broken = ~F.coalesce((F.col("id") > 0) & (F.col("title") != "") & F.col("registered_on").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col("display_status").isin("none", "pending", "failed", "summarized", "needs_review"), F.lit(False))
    available = F.col("display_status").isin("summarized", "needs_review")
    card = lambda key: F.when(available & F.col("card_summaries").isNotNull(), F.coalesce(F.nullif(F.col(f"card_summaries.{key}"), F.lit("")), F.lit(MISSING_CARD))).otherwise("")
    provider = F.coalesce(F.nullif("department", F.lit("")), _lookup(PROVIDERS, F.col("source")), F.lit(NO_PROVIDER))
    due = F.when((F.col("display_status") == "summarized") & F.col("deadline_on").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("deadline_on"))
    return rows.select(
        F.col("id").cast("string").alias("id"), "title", category_name(F.col("category_code")).alias("category"), provider.alias("provider"), F.replace("registered_on", F.lit("-"), F.lit(".")).alias("published_at"),
        F.when(available, F.coalesce("headline", F.lit(""))).otherwise("").alias("description"), *[card(k).alias(n) for n, k in CARDS.items()], due.alias("deadline_date"), F.col("display_status").alias("summary_status"), F.when(broken, "contract").alias("error"),
    )


def summary_rows(audience: Column, task: Column, deadline: Column, caution: Column) -> Column:
    """Array of (label, value) of the cards that say something."""
    rows = F.array(*[F.struct(F.lit(label).alias("label"), value.alias("value")) for label, value in (("대상", audience), ("할 일", task), ("기한", deadline), ("유의사항", caution))])
    return F.filter(rows, lambda r: F.coalesce(r["value"].rlike(r"(?U)\S"), F.lit(False)))


def omission_message(reason: Column) -> Column:
    return F.when(reason == "unsupported_type", UNSUPPORTED_FILE).otherwise(UNREAD_FILE)


def public_summary(status: Column, result: Column, needs_review: Column, evidence: Column, references: Column, omissions: Column) -> Column:
    """What readers get of a stored summary: struct of status, message, content, file_references and preparation_omissions.

    pending and failed show no content. A result that needs review, or leaves
    files out, keeps its content with a message. Of the references (source_id and
    more) only those that the result's evidence (source_type, source_id) cites are shown.
    """
    done = status.isin("summarized", "needs_review") & result.isNotNull()
    shown = F.when(done & (status == "summarized") & ~needs_review, "summarized").when(status.isin("pending", "failed"), status).otherwise("needs_review")
    left_out = done & (F.coalesce(F.size(omissions), F.lit(0)) > 0)
    cited = F.transform(F.filter(evidence, lambda e: e["source_type"].isin("document", "image") & e["source_id"].isNotNull()), lambda e: e["source_id"])
    files = F.when(done, F.filter(references, lambda r: F.array_contains(cited, r["source_id"])))
    return F.struct(
        F.when(left_out, "needs_review").otherwise(shown).alias("status"), F.when(left_out, OMITTED).otherwise(_lookup(MESSAGES, shown)).alias("message"), F.when(done, result).alias("content"),
        F.coalesce(files, F.slice(references, F.lit(1), F.lit(0))).alias("file_references"), F.when(left_out, omissions).alias("preparation_omissions"),
    )


def reminder(notice_id: Column, day: Column, clock: Column, days_before: Column) -> Column:
    """Struct of identifier and time of a reminder, days_before a day and clock given as text; null unless both are real and not before 2000."""
    at = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & clock.rlike(r"^([01]\d|2[0-3]):[0-5]\d$") & (day >= "2000"), F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("yyyy-MM-dd HH:mm")))
    moved = F.timestamp_add("DAY", -days_before, at)
    return F.when((notice_id > 0) & at.isNotNull(), F.struct(F.concat(F.lit("notice-deadline-v1:"), notice_id.cast("string")).alias("identifier"), moved.alias("at")))


def keyset_page(view: DataFrame, after: tuple[str, int] | None = None, newest_first: bool = True, size: int = 20, day: str = "registered_on", key: str = "id") -> DataFrame:
    """One page, after the row (day, key); the order is total, so pages neither overlap nor skip."""
    d, k = F.col(day), F.col(key)
    if after is not None:
        last, last_key = F.lit(after[0]).cast("date"), F.lit(after[1])
        view = view.filter((d < last) | ((d == last) & (k < last_key)) if newest_first else (d > last) | ((d == last) & (k > last_key)))
    order = (d.desc_nulls_last(), k.desc()) if newest_first else (d.asc_nulls_last(), k.asc())
    return view.orderBy(*order).limit(size)


def search(view: DataFrame, keyword: str, *columns: str) -> DataFrame:
    """Rows with the keyword in one of the columns, upper and lower case alike; a blank keyword finds all."""
    word = keyword.strip().lower()
    if not word:
        return view
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(word), F.lit(False))
    return view.filter(found)


def saved(view: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """The rows of a bookmark list, with their place in it."""
    kept = list(dict.fromkeys(ids))
    return view.filter(F.col(key).isin(*kept)).withColumn("position", F.array_position(F.lit(kept), F.col(key)).cast("long")).orderBy("position")


def expired(deadline: Column, today: Column) -> Column:
    return F.coalesce(deadline < today, F.lit(False))


def public_children(children: DataFrame, notices: DataFrame, key: str = "notice_id") -> DataFrame:
    """Child rows of visible notices."""
    return children.join(visible(notices).select(F.col("id").alias(key)), key, "left_semi")
