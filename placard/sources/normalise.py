"""Raw notices of the three sources as records: real dates, one form of address, blank bodies as null.

A row that breaks a rule isn't dropped: its error names the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.text import strip

# The sources' addresses and boards.
DISTRICT_URL, DONG_URL = r"^https?://www\.nowon\.kr(?::(?:80|443))?(/www/user/bbs/BD_selectBbs\.do)\?([^#]+)$", r"^https://www\.nowon\.kr/dong/user/bbs/BD_selectBbs\.do\?([^#]+)$"
CITY_BOARDS = {"21": "traffic", "22": "safe", "23": "citybuild", "24": "economy", "25": "env", "26": "culture", "27": "welfare", "30": "gov"}


def body_or_none(html: Column) -> Column:
    """The body, or null if it has neither text nor an image or link with an address."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>|&nbsp;|&#160;", "")
    addressed = html.rlike(r"(?i)<img\b[^>]*\ssrc\s*=\s*(?:[\"']\s*[^\s\"'>]|[^\s\"'>])") | html.rlike(r"(?i)<a\b[^>]*\shref\s*=\s*(?:[\"']\s*[^\s\"'>]|[^\s\"'>])")
    return F.when((strip(text) != "") | addressed, html)


def real_day(day: Column) -> Column:
    """The date of a strict yyyy-mm-dd, else null."""
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(day, "yyyy-MM-dd"))


def _once(query: Column, name: str, value: Column) -> Column:
    found = F.regexp_extract_all(query, F.lit(rf"(?:^|&){name}=([^&]*)"), F.lit(1))
    return (F.size(found) == 1) & (F.get(found, F.lit(0)) == value)


def _record(rows: DataFrame, category: str, group: Column, pinned: Column, url: Column, day: Column, license_type: Column, error: Column) -> DataFrame:
    made = {"category": F.lit(category), "dong_group": group, "is_pinned": pinned, "url": url, "registered_on": day, "license_type": license_type, "body_html": body_or_none(F.col("body_html"))}
    return rows.withColumn("error", error).withColumns(made)


def district(rows: DataFrame) -> DataFrame:
    """Notices of the district office (source_board, post_sn, title, department, url, registered, body_html, license_type)."""
    query = F.regexp_extract("url", DISTRICT_URL, 2)
    own = (query != "") & _once(query, "q_bbsCode", F.lit("1001")) & _once(query, "q_bbscttSn", F.col("post_sn"))
    day = real_day(F.col("registered"))
    error = F.when(~F.col("license_type").eqNullSafe(F.lit("KOGL-4")), "license").when(day.isNull(), "date").when(~F.coalesce(own, F.lit(False)), "url")
    url = F.when(own, F.concat(F.lit("https://www.nowon.kr"), F.regexp_extract("url", DISTRICT_URL, 1), F.lit("?"), query))
    return _record(rows, "nowon", F.lit(None).cast("string"), F.lit(False), url, day, F.col("license_type"), error)


def dong(rows: DataFrame) -> DataFrame:
    """Notices of a neighbourhood office (also dong_group and is_pinned); those of other offices only if pinned."""
    query = F.regexp_extract("url", DONG_URL, 1)
    own = (query != "") & _once(query, "q_bbsCode", F.lit("1042")) & _once(query, "q_bbscttSn", F.col("post_sn")) & _once(query, "q_deptCode", F.lit("1047"))
    day = real_day(F.col("registered"))
    group = F.col("dong_group")
    error = F.when(~F.coalesce(group.isin("wolgye1", "other"), F.lit(False)), "group").when((group == "other") & ~F.col("is_pinned"), "other_regular").when(day.isNull(), "date").when(~F.coalesce(own, F.lit(False)), "url")
    return _record(rows, "dong", group, F.col("is_pinned"), F.when(own, F.col("url")), day, F.col("license_type"), error)


def city(rows: DataFrame) -> DataFrame:
    """Notices of the city: the day of a timestamp, trimmed names, an address made of board and number."""
    stamp = F.col("registered").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")
    day = F.when(stamp, F.to_date(F.try_to_timestamp("registered", F.lit("yyyy-MM-dd HH:mm:ss"))))
    slug = F.create_map(*[F.lit(x) for pair in CITY_BOARDS.items() for x in pair])[F.col("source_board")]
    error = F.when(slug.isNull(), "board").when(day.isNull(), "date").when(~F.col("post_sn").rlike("^[0-9]+$"), "key").when(~F.coalesce("post_status", F.lit("publish")).isin("publish"), "status")
    none = F.lit(None).cast("string")
    url = F.concat(F.lit("https://news.seoul.go.kr/"), slug, F.lit("/archives/"), F.col("post_sn"))
    named = rows.withColumns({"title": strip(F.col("title")), "department": F.nullif(strip(F.col("department")), F.lit(""))})
    return _record(named, "seoul", none, F.lit(False), url, day, none, error)
