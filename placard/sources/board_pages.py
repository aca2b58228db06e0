"""Pages of a district's board: the list with its proof, details, and pages that say the post is gone.

A page or row that can't be trusted isn't dropped: it carries an error code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.operators.collect import page_proof, pinned_or_regular
from placard.sources.html_tree import elements, has

# How the board marks its pages.
PINNED, DISTRICT, GONE = "공지", "월계1동", 'alert("데이터가 존재하지 않습니다.")'
POST_URL = r"^(?:https://www\.nowon\.kr)?/dong/user/bbs/BD_selectBbs\.do\?(?:[^#]*&)?q_bbscttSn=([0-9]+)(?:[&#]|$)"
BOARD_PARAMETER = r"[?&]q_bbsCode=1042(?:&|#|$)"
SHOWN, DAY = r"\(([0-9]+)/([0-9]+)page\)", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
LICENSE = r"^[^?#]*/licenseType([1-4])\.do(?:[?#]|$)"


def _each(pages: DataFrame, key: str, *tags: str, inner: str = "") -> DataFrame:
    return pages.select(key, F.explode(elements(*tags, inner=inner)("html")).alias("e"))


def _first(value: str, where: Column) -> Column:
    return F.min_by(value, F.when(where, F.col("e.at")))


def post_number(href: Column) -> Column:
    """The post's number in a link to it; null where the link isn't one."""
    once = F.size(F.regexp_extract_all(href, F.lit("[?&]q_bbscttSn="), F.lit(0))) == 1
    found = F.regexp_extract(href, POST_URL, 1)
    return F.when(once & href.rlike(BOARD_PARAMETER) & (found != ""), found)


def list_rows(pages: DataFrame, key: str = "page") -> DataFrame:
    """pages (key, html) as board rows: number, post_sn, title, department, registered_on, is_pinned, pos, error."""
    each = _each(pages, key, "tr", "td", "th", "a", "span", "div", "p").filter(has("e", ".table-list", "tbody") & F.col("e.row").isNotNull())
    cell = lambda name: _first("e.text", F.array_contains("e.classes", name))
    link = has("e", ".cell-subject", "a") & (F.col("e.tag") == "a") & F.col("e.attrs").getItem("href").isNotNull()
    rows = each.groupBy(key, F.col("e.row").alias("pos")).agg(
        cell("cell-no").alias("number"), _first("e.attrs", link).alias("a"), _first("e.text", link).alias("title"), cell("cell-part").alias("department"), cell("cell-date").alias("registered_on")
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    pinned = F.col("number") == PINNED
    error = (
        F.when(blank("number"), "cell").when(~pinned & ~F.col("number").rlike("^[0-9]+$"), "number").when(F.col("a").isNull(), "link").when(post_number(F.col("a")["href"]).isNull(), "post")
        .when(blank("department") | blank("registered_on"), "cell").when(~pinned & ~F.col("department").startswith(DISTRICT), "other_district")
        .when(~F.col("registered_on").rlike(DAY), "date").when(blank("title"), "title")
    )
    return rows.select(key, "pos", "number", post_number(F.col("a")["href"]).alias("post_sn"), "title", "department", "registered_on", pinned.alias("is_pinned"), error.alias("error"))


def board_list(rows: DataFrame) -> DataFrame:
    """One row for each post of list rows: pinned if any of its rows is; conflict where they differ."""
    return pinned_or_regular(rows.filter("error is null"))


def board_pages(pages: DataFrame) -> DataFrame:
    """pages (page: the one asked for, html) with what they show and valid: range, counts and rows agree."""
    each = _each(pages, "page", "p", "strong", "input")
    named = lambda name: _first("e.attrs", (F.col("e.tag") == "input") & (F.col("e.attrs").getItem("name") == name))["value"].try_cast("int")
    label = _first("e.text", (F.col("e.tag") == "p") & F.array_contains("e.classes", "total"))
    shown = each.groupBy("page").agg(
        F.replace(_first("e.text", (F.col("e.tag") == "strong") & has("e", "p", ".total")), F.lit(","), F.lit("")).try_cast("int").alias("total_count"),
        named("q_currPage").alias("current_page"), named("q_rowPerPage").alias("page_size"),
        F.regexp_extract(label, SHOWN, 1).try_cast("int").alias("shown_page"), F.regexp_extract(label, SHOWN, 2).try_cast("int").alias("total_pages"),
    )
    rows = list_rows(pages).groupBy("page").agg(F.count_if(~F.col("is_pinned")).alias("n_regular"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    joined = pages.select("page").join(shown, "page", "left").join(rows, "page", "left")
    here = (F.col("current_page") == F.col("page")) & (F.col("shown_page") == F.col("page")) & F.col("page").between(1, F.col("total_pages")) & (F.col("n_errors") == 0) & (F.col("page_size") > 0)
    return page_proof(joined).withColumn("valid", F.coalesce(F.col("valid") & here, F.lit(False)))


def detail_pages(entries: DataFrame) -> DataFrame:
    """entries (post_sn, is_pinned, url, html: the post's page) as raw notices with error.

    error: missing (the board says the post is gone; not a failure), article,
    post, parts, title, value, date, other_district, license; null where whole.
    """
    each = _each(entries, "post_sn", "input", "h1", "table", "th", "td", "a", inner="article-body").withColumn("in_table", has("e", ".article-view", ".table-article"))
    article = has("e", ".article-view")
    facts = each.groupBy("post_sn").agg(
        F.max(article).alias("article"), F.collect_list(F.when((F.col("e.tag") == "input") & (F.col("e.attrs").getItem("name") == "q_bbscttSn"), F.col("e.attrs").getItem("value"))).alias("numbers"),
        _first("e.text", article & (F.col("e.tag") == "h1") & F.array_contains("e.classes", "article-subject")).alias("title"),
        F.max((F.col("e.tag") == "table") & F.col("in_table")).alias("table"), _first("e.inner", article & F.array_contains("e.classes", "article-body")).alias("body_html"),
        F.array_distinct(F.collect_list(F.when((F.col("e.tag") == "a") & F.col("e.attrs").getItem("href").contains("licenseType"), F.regexp_extract(F.col("e.attrs").getItem("href"), LICENSE, 1)))).alias("licenses"),
    )
    # A label's value is the next cell of its row.
    heads = each.filter("in_table and e.tag = 'th'").select("post_sn", F.col("e.text").alias("label"), F.col("e.row").alias("row"), F.col("e.at").alias("head")).filter(F.col("label").isin("부서/팀", "등록일"))
    cells = each.filter("in_table and e.tag = 'td'").select("post_sn", F.col("e.row").alias("row"), F.col("e.at").alias("at"), F.col("e.text").alias("text"))
    values = heads.join(cells, ["post_sn", "row"]).filter("at > head").groupBy("post_sn", "label", "head").agg(F.min_by("text", "at").alias("text")).filter("text <> ''")
    pick = lambda label: F.min_by("text", F.when(F.col("label") == label, F.col("head")))
    named = values.groupBy("post_sn").agg(pick("부서/팀").alias("department"), pick("등록일").alias("registered_on"))
    joined = entries.join(facts, "post_sn", "left").join(named, "post_sn", "left")
    gone = F.contains("html", F.lit(GONE))
    own = F.col("department").startswith(DISTRICT)
    error = (
        F.when(gone, "missing").when(~F.coalesce("article", F.lit(False)), "article").when(~F.coalesce(F.col("numbers") == F.array("post_sn"), F.lit(False)), "post")
        .when(F.col("title").isNull() | ~F.col("table") | F.col("body_html").isNull(), "parts").when(F.col("title") == "", "title").when(F.col("department").isNull() | F.col("registered_on").isNull(), "value")
        .when(~F.col("registered_on").rlike(DAY), "date").when(~F.col("is_pinned") & ~own, "other_district").when((F.size("licenses") > 1) | F.array_contains("licenses", ""), "license")
    )
    license_type = F.concat(F.lit("KOGL-"), F.get("licenses", F.lit(0)))
    whole = lambda c: F.when(F.col("error").isNull(), c)
    return joined.withColumn("error", error).select(
        "post_sn", "is_pinned", "url", "error", whole(F.lit("dong")).alias("category"), whole(F.lit("1042")).alias("source_board"), whole(F.when(own, "wolgye1").otherwise("other")).alias("dong_group"),
        whole(F.col("title")).alias("title"), whole(F.col("department")).alias("department"), whole(F.col("registered_on")).alias("registered_on"), whole(F.nullif("body_html", F.lit(""))).alias("body_html"), whole(license_type).alias("license_type"),
    )
