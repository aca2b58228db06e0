"""Pages of the open APIs' XML, read from text: rows, result codes, and whether a page is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("ID", "TITLE", "LINK", "PUBDATE", "DEPARTMENT", "MANAGER", "DESCRIPTION")
CITY_FIELDS = ("BLOG_ID", "BLOG_NAME", "POST_ID", "POST_TITLE", "THUMB_URI", "POST_EXCERPT", "PUBLISH_DATE", "MODIFY_DATE", "POST_STATUS", "POST_CONTENT", "MANAGER_DEPT")
REQUIRED = ("ID", "TITLE", "LINK", "PUBDATE", "DEPARTMENT")
CITY_REQUIRED = ("BLOG_ID", "POST_ID", "POST_TITLE", "PUBLISH_DATE", "POST_STATUS")
MOST_ROWS, SAMPLE_ROWS = 1000, 5


def _schema(fields: tuple[str, ...]) -> str:
    # Arrays, so that a field which a row has twice is seen.
    return f"list_total_count long, RESULT array<struct<CODE: string, MESSAGE: string>>, row array<struct<{', '.join(f'{f}: array<string>' for f in fields)}>>"


def ranges(total: int, size: int = MOST_ROWS, overlap: int = 10, sample: bool = False) -> list[tuple[int, int]]:
    """The index ranges (from 1, inclusive) that read a list whole, each overlapping the one before; a sample key gets five rows only."""
    if not 1 <= size <= MOST_ROWS or not 0 <= overlap < size:
        raise ValueError("a page has 1 to 1000 rows, and its overlap fewer")
    if sample:
        return [(1, min(total, SAMPLE_ROWS))] if total else []
    return [(start, min(total, start + size - 1)) for start in range(1, max(1, total - overlap) + 1, size - overlap)] if total else []


def parse_pages(pages: DataFrame, fields: tuple[str, ...] = FIELDS, required: tuple[str, ...] = REQUIRED, board: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """pages (start, end, xml, and columns to keep) with total, rows and error.

    error: range, entities, malformed, result (not one), server (to be tried
    again), code, duplicate_field, blank_field, other_board (``board`` names the
    one asked for), row_count; null where the page is whole. INFO-200 is an
    empty page.
    """
    parsed = pages.withColumn("p", F.from_xml("xml", _schema(fields), {"mode": "PERMISSIVE", "rowTag": "ROOT"}))
    empty = F.array().cast(f"array<struct<{', '.join(f'{f}: array<string>' for f in fields)}>>")
    code, raw = F.get("p.RESULT", F.lit(0))["CODE"], F.coalesce("p.row", empty)
    any_of = lambda row, names, test: F.array_contains(F.array(*[test(row[c]) for c in names]), True)
    twice = F.exists(raw, lambda r: any_of(r, fields, lambda v: F.coalesce(F.size(v), F.lit(0)) > 1))
    blank = F.exists(raw, lambda r: any_of(r, required, lambda v: F.trim(F.coalesce(F.get(v, F.lit(0)), F.lit(""))) == ""))
    foreign = F.exists(raw, lambda r: F.get(r["BLOG_ID"], F.lit(0)) != board) if board is not None else F.lit(False)
    expected = F.greatest(F.lit(0), F.least(F.col("end"), F.col("p.list_total_count")) - F.col("start") + 1)
    error = (
        F.when((F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") - F.col("start") >= MOST_ROWS), "range").when(F.col("xml").rlike(r"(?i)<!(DOCTYPE|ENTITY)"), "entities")
        .when(F.col("p").isNull() | F.col("p.RESULT").isNull(), "malformed").when(F.size("p.RESULT") != 1, "result").when(code.isin("ERROR-500", "ERROR-600"), "server").when(~code.isin("INFO-000", "INFO-200"), "code")
        .when(twice, "duplicate_field").when(blank, "blank_field").when(foreign, "other_board").when((code == "INFO-000") & (F.size(raw) != expected), "row_count")
    )
    rows = F.transform(raw, lambda r: F.struct(*[F.get(r[f], F.lit(0)).alias(f) for f in fields]))
    return parsed.select(*keep, "start", "end", F.col("p.list_total_count").alias("total"), rows.alias("rows"), error.alias("error"))


def parse_city_pages(pages: DataFrame, board: str) -> DataFrame:
    """The city's pages of one board; a row of another board is an error."""
    return parse_pages(pages, CITY_FIELDS, CITY_REQUIRED, board)


def notice_rows(parsed: DataFrame) -> DataFrame:
    """One row for each listed notice of whole pages, with page and position."""
    whole = parsed.filter("error is null")
    return whole.select(F.col("start").alias("page"), F.posexplode("rows").alias("pos", "r")).select("page", "pos", F.col("r.ID").alias("post_sn"), F.col("r.TITLE").alias("title"), F.col("r.LINK").alias("url"), F.col("r.PUBDATE").alias("registered"), F.col("r.DEPARTMENT").alias("department"), F.col("r.DESCRIPTION").alias("body_html"))


def city_rows(parsed: DataFrame) -> DataFrame:
    """One row for each notice of the city's whole pages, with page and position."""
    r = lambda f, name: F.col(f"r.{f}").alias(name)
    named = (r("BLOG_ID", "source_board"), r("POST_ID", "post_sn"), r("POST_TITLE", "title"), r("PUBLISH_DATE", "registered"), r("MANAGER_DEPT", "department"), r("POST_STATUS", "post_status"), r("POST_CONTENT", "body_html"))
    return parsed.filter("error is null").select(F.col("start").alias("page"), F.posexplode("rows").alias("pos", "r")).select("page", "pos", *named)


def one(rows: DataFrame, post_sn: str) -> DataFrame:
    """The first row of one post."""
    return rows.filter(F.col("post_sn") == post_sn).orderBy("page", "pos").limit(1)
