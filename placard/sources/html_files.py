"""File references in notices: links and images of a body, rows of files on a page, and links whose ids are masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.identity import file_key
from placard.sources.html_tree import elements, has

# The sites' addresses, and what counts as a file or as decoration there.
NOWON, DOWNLOAD, EDITOR = "www.nowon.kr", "/component/file/ND_fileDownload.do", "/webcontent/crosseditor/images/"
EDITOR_SUFFIX = r"(?i)\.(png|jpe?g|webp)$"
PAGE_SUFFIX = r"(?i)\.(pdf|hwpx?|png|jpe?g|webp|docx?|xlsx?|pptx?|zip)$"
CITY_SUFFIX = r"(?i)\.(pdf|hwpx?|docx?|xlsx?|pptx?|zip|png|jpe?g|gif|webp|svg)$"
CITY_NEWS, CITY_THEME, CITY_CULTURE = "news.seoul.go.kr", "/wp-content/themes/", "culture.seoul.go.kr"
CITY_DECORATION = (
    "/_ui/images/main/cnl-common/nLc-logo-culture.png",
    "/_ui/images/main/cnl-common/nLc-top-facebook.png",
    "/_ui/images/main/cnl-common/nLc-top-instargram.png",
    "/_ui/images/main/cnl-common/nLc-top-blog.png",
)
FILE_ROW, NO_FILES = "첨부파일", "첨부파일이 없습니다"


#: An address's scheme, authority, path and query; and an authority's user, host and port.
ADDRESS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
AUTHORITY = r"^(?:(.*)@)?(\[[0-9A-Fa-f:.]+\]|[^:\[\]@]*)(?::([0-9]*))?$"


def _parts(address: Column) -> Column:
    """Struct of scheme, authority, path and query (with its mark) of an address; what is missing is empty."""
    part = lambda n: F.regexp_extract(address, ADDRESS, n)
    return F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("authority"), part(3).alias("path"), part(4).alias("query"))


def _without_dots(path: Column) -> Column:
    """A path whose . and .. steps are taken."""
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")
    walked = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, step: F.when(step == ".", acc).when(step == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, step)),
    )
    ends = F.element_at(steps, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(ends, F.array_append(walked, F.lit(""))).otherwise(walked), "/"))


def _decoded(text: Column, plus: bool) -> Column:
    """Percent signs decoded; plus: a plus sign is a space. Left as it is where it can't be."""
    return F.coalesce(F.try_url_decode(text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))), F.replace(text, F.lit("+"), F.lit(" ")) if plus else text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _sorted_query(query: Column) -> Column:
    """A download's parameters in one order, the serial number first; blank and repeated ones stay."""
    given = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    named = F.transform(given, lambda p: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1), True).alias("name"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1), True).alias("value")))
    ordered = F.array_sort(F.transform(named, lambda p: F.struct((p["name"] != "q_fileSn").alias("later"), p["name"].alias("name"), p["value"].alias("value"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")


def addressed(rows: DataFrame, base: Column, reference: Column, city: bool) -> DataFrame:
    """rows with a: url, path (decoded) and host of a reference as its page resolves it, in one form and without fragment.

    url is empty where it isn't http(s), and null where it can't be read; the
    city's pages take neither, nor an address with a user or another port. The
    site's own addresses become https without port; a null reference has no a.
    """
    empty = F.lit("")
    rows = rows.withColumns({"_r": _parts(F.trim(reference)), "_b": _parts(F.coalesce(base, empty))})
    r, b = (lambda c: F.col(f"_r.{c}")), (lambda c: F.col(f"_b.{c}"))
    own, rooted = (r("scheme") != "") & (r("scheme") != b("scheme")) | (r("authority") != ""), r("path").startswith("/")
    merged = F.when(rooted, r("path")).otherwise(F.concat(F.regexp_replace(b("path"), "[^/]*$", ""), r("path")))
    path = F.when(own, r("path")).when(r("path") == "", b("path")).otherwise(_without_dots(merged))
    query = F.when(own | (r("path") != "") | (r("query") != ""), r("query")).otherwise(b("query"))
    rows = rows.withColumns({"_s": F.coalesce(F.nullif(r("scheme"), empty), b("scheme")), "_a": F.when(own, r("authority")).otherwise(b("authority")), "_p": path, "_q": F.when(query == "?", "").otherwise(query)})
    part = lambda n: F.regexp_extract("_a", AUTHORITY, n)
    port, host = F.nullif(part(3), empty).try_cast("int"), F.lower(part(2))
    readable = F.col("_a").rlike(AUTHORITY) & ((part(3) == "") | F.coalesce(port.between(0, 65535), F.lit(False)))
    plain = ~F.contains("_a", F.lit("@")) & (port.isNull() | port.isin(80, 443))
    web = F.col("_s").isin("http", "https") & (F.col("_a") != "")
    home = CITY_NEWS if city else NOWON
    sorted_ = F.lit(False) if city else F.col("_p") == DOWNLOAD
    asked = F.when(sorted_, F.concat(F.lit("?"), _sorted_query(F.col("_q")))).otherwise(F.col("_q"))
    canonical = F.concat(F.lit(f"https://{home}"), F.col("_p"), F.when(asked == "?", "").otherwise(asked))
    as_is = F.concat("_s", F.lit("://"), "_a", "_p", "_q")
    url = F.when(~readable, None).when(~web, None if city else "").when(~plain & F.lit(city), None).when((host == home) & plain, canonical).otherwise(as_is)
    known = url.isNotNull() & (url != "")
    a = F.when(reference.isNotNull(), F.struct(url.alias("url"), F.when(known, _decoded(F.col("_p"), False)).alias("path"), F.when(known, host).alias("host")))
    return rows.withColumn("a", a).drop("_r", "_b", "_s", "_a", "_p", "_q")


def _identity(url: Column) -> tuple[Column, Column, Column]:
    """(serial number, id, whether the address has either but not both of them once and trimmed)."""
    values = lambda name: F.regexp_extract_all(url, F.lit(rf"[?&]{name}=([^&#]*)"), F.lit(1))
    plain = lambda v: F.url_decode(F.get(v, F.lit(0)))
    serial, file_id = values("q_fileSn"), values("q_fileId")
    whole = lambda v: (F.size(v) == 1) & (plain(v) != "") & ~plain(v).rlike(r"(?U)^\s|\s$")
    both, none = whole(serial) & whole(file_id), (F.size(serial) == 0) & (F.size(file_id) == 0)
    return F.when(both, plain(serial)), F.when(both, plain(file_id)), ~none & ~both


def _references(notices: DataFrame, key: str, html: str) -> DataFrame:
    each = notices.select(key, "url", F.explode(elements("a", "img")(html)).alias("e"))
    reference = F.when(F.col("e.tag") == "a", F.col("e.attrs").getItem("href")).otherwise(F.col("e.attrs").getItem("src"))
    kind = F.when(F.col("e.tag") == "a", "attachment").otherwise("inline_image")
    return each.select(key, F.col("url").alias("base"), F.col("e.at").alias("pos"), kind.alias("kind"), F.trim(reference).alias("reference"), F.col("e.attrs").getItem("download").alias("download"), F.col("e.text").alias("text")).filter("reference <> ''")


def _columns(key: str) -> tuple[str, ...]:
    return (key, "pos", "kind", "file_sn", "file_id", "file_key", "file_name", "url", "error")


def district_files(notices: DataFrame, key: str, html: str = "body_html") -> DataFrame:
    """Files in the bodies of district notices (key, url, html): links with an identity, and images with one or from the editor's folder.

    error: invalid_file_url or invalid_file_identity; such rows name no file.
    """
    found = addressed(_references(notices, key, html), F.col("base"), F.col("reference"), city=False).filter("a is null or a.url is null or a.url <> ''")
    serial, file_id, broken = _identity(F.col("a.url"))
    named = found.withColumns({"file_sn": serial, "file_id": file_id, "error": F.when(F.col("a.url").isNull(), "invalid_file_url").when(broken, "invalid_file_identity")})
    editor = (F.col("kind") == "inline_image") & F.col("a.url").startswith(f"https://{NOWON}{EDITOR}") & F.lower("a.path").rlike(EDITOR_SUFFIX)
    kept = named.filter(F.col("error").isNotNull() | F.col("file_id").isNotNull() | editor)
    name = F.when(F.col("kind") == "attachment", F.coalesce(F.nullif(F.trim("download"), F.lit("")), F.nullif("text", F.lit(""))))
    return kept.select(key, "pos", "kind", "file_sn", "file_id", file_key(F.col("file_id"), F.col("a.url")).alias("file_key"), name.alias("file_name"), F.col("a.url").alias("url"), "error")


def city_files(notices: DataFrame, key: str, html: str = "body_html") -> DataFrame:
    """Files in the bodies of city notices: links with a file's suffix, and images but known decoration."""
    found = addressed(_references(notices, key, html).filter("not startswith(reference, '#')"), F.col("base"), F.col("reference"), city=True)
    is_file = (F.col("kind") == "inline_image") | F.coalesce(F.col("a.path").rlike(CITY_SUFFIX), F.lit(True))
    decorative = (F.col("kind") == "inline_image") & F.coalesce(decoration(F.col("a.host"), F.col("a.path")), F.lit(False))
    error = F.when(F.col("a.url").isNull(), "invalid_file_url").when(~is_file, "download_without_suffix")
    kept = found.filter(~decorative & (is_file | F.col("download").isNotNull())).withColumn("error", error)
    none = F.lit(None).cast("string")
    return kept.select(key, "pos", "kind", none.alias("file_sn"), none.alias("file_id"), file_key(none, F.col("a.url")).alias("file_key"), F.nullif(F.regexp_extract("a.path", "([^/]*)/?$", 1), F.lit("")).alias("file_name"), F.col("a.url").alias("url"), "error")


def decoration(host: Column, path: Column) -> Column:
    """Whether an image is known furniture of the city's sites."""
    return ((host == CITY_NEWS) & path.contains(CITY_THEME)) | ((host == CITY_CULTURE) & path.isin(*CITY_DECORATION))


def page_files(pages: DataFrame, key: str) -> DataFrame:
    """The files in a page's file row (key, url, html).

    A page without any is a row without url whose error says why:
    attachment_section_missing, attachment_list_missing, or null where the page
    says that it has none. Other errors are those of single files.
    """
    each = pages.select(key, "url", F.explode(elements("tr", "th", "a")("html")).alias("e")).filter("e.row is not null")
    heads = each.filter((F.col("e.tag") == "th") & F.contains("e.text", F.lit(FILE_ROW))).select(key, F.col("e.row").alias("row")).distinct()
    one = heads.groupBy(key).agg(F.count("*").alias("n"), F.min("row").alias("row"))
    row_text = each.filter("e.tag = 'tr'").select(key, F.col("e.row").alias("row"), F.col("e.text").alias("row_text"))
    links = each.filter((F.col("e.tag") == "a") & has("e", "ul", ".file-list") & F.col("e.attrs").getItem("href").isNotNull()).select(key, F.col("e.row").alias("row"), F.struct(F.col("e.at").alias("at"), F.trim(F.col("e.attrs").getItem("href")).alias("href"), F.col("e.text").alias("text")).alias("l"))
    state = pages.select(key, F.col("url").alias("base")).join(one, key, "left").join(row_text, [key, "row"], "left").join(links, [key, "row"], "left")
    found = addressed(state, F.col("base"), F.col("l.href"), city=False)
    serial, file_id, broken = _identity(F.col("a.url"))
    error = (
        F.when(F.coalesce("n", F.lit(0)) != 1, "attachment_section_missing").when(F.col("l").isNull() & F.contains("row_text", F.lit(NO_FILES)), None).when(F.col("l").isNull(), "attachment_list_missing")
        .when(F.col("l.href") == "", "empty_file_url").when(F.coalesce("a.url", F.lit("")) == "", "invalid_file_url").when(broken, "invalid_file_identity").when(file_id.isNull() & ~F.col("a.path").rlike(PAGE_SUFFIX), "missing_file_identity")
    )
    named = found.withColumns({"file_sn": serial, "file_id": file_id, "error": error})
    return named.select(key, F.col("l.at").alias("pos"), F.when(F.col("l").isNotNull(), "attachment").alias("kind"), "file_sn", "file_id", F.when(F.col("a.url").isNotNull(), file_key(F.col("file_id"), F.col("a.url"))).alias("file_key"), F.nullif("l.text", F.lit("")).alias("file_name"), F.col("a.url").alias("url"), "error")


def unique_files(files: DataFrame, key: str) -> DataFrame:
    """One row for each key, file_key and kind, the first; conflict where they have different addresses."""
    whole = files.filter("error is null and file_key is not null")
    rest = [c for c in whole.columns if c not in (key, "file_key", "kind", "error")]
    grouped = whole.groupBy(key, "file_key", "kind").agg(F.min_by(F.struct(*rest), "pos").alias("f"), (F.count_distinct("url") > 1).alias("conflict"))
    return grouped.select(key, "file_key", "kind", "f.*", "conflict")


def merged_files(body: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """Files of body and page together; of one in both the page's row counts, and a conflict within either stays one."""
    both = unique_files(body, key).withColumn("rank", F.lit(1)).unionByName(unique_files(page, key).withColumn("rank", F.lit(0)))
    rest = [c for c in both.columns if c not in (key, "file_key", "kind", "rank", "conflict")]
    return both.groupBy(key, "file_key", "kind").agg(F.min_by(F.struct(*rest), "rank").alias("f"), F.max("conflict").alias("conflict")).select(key, "file_key", "kind", "f.*", "conflict")


def unmasked(masked: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """masked (key, url, file_sn, file_id with runs of stars) with found: the one original (key, url, file_sn, file_id) that fits, and error.

    A run of stars stands for hex digits and hyphens, and the original's id is
    a UUID. error: masked_file_unresolved (none fits) or masked_file_ambiguous.
    """
    literal = F.regexp_replace("file_id", r"[^A-Za-z0-9*-]", "")
    pattern = F.concat(F.lit("^"), F.regexp_replace(literal, r"\*+", "[0-9a-fA-F-]+"), F.lit("$"))
    asked = masked.withColumn("pattern", F.when(literal == F.col("file_id"), pattern))
    uuid = F.col("original_id").rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
    known = originals.select(key, "file_sn", F.col("file_id").alias("original_id"), F.col("url").alias("original_url")).filter(uuid)
    fits = asked.join(known, [key, "file_sn"], "left").withColumn("fit", F.when(F.expr("rlike(original_id, pattern)"), F.col("original_url")))
    counted = fits.groupBy(key, "file_sn", "file_id", "url").agg(F.count_distinct("fit").alias("n"), F.min("fit").alias("fit"))
    return counted.select(key, "file_sn", "file_id", "url", F.when(F.col("n") == 1, F.col("fit")).alias("found"), F.when(F.col("n") == 0, "masked_file_unresolved").when(F.col("n") > 1, "masked_file_ambiguous").alias("error"))


def body_images(files: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """Images of bodies by what they show: files (of kind inline_image) and contents (url, content), one row for each digest of a notice, with its addresses."""
    images = files.filter("kind = 'inline_image' and error is null").select(key, "pos", "url")
    digested = images.join(contents.select("url", F.sha2("content", 256).alias("digest")), "url")
    return digested.groupBy(key, "digest").agg(F.array_sort(F.collect_set("url")).alias("urls"), F.min("pos").alias("pos"))
