"""URLs of notices and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds that a reader can preview.
IMAGE_SUFFIX, PDF_SUFFIX = r"(?i)\.(png|jpe?g|gif|webp)$", r"(?i)\.pdf$"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def canonical(url: Column, first: str = "") -> Column:
    """https, host in lower case, no fragment, parameters sorted by name, ``first`` before the others."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    ranked = F.concat(F.filter(parts, lambda p: p.startswith(first + "=")), F.filter(parts, lambda p: ~p.startswith(first + "="))) if first else parts
    joined = F.array_join(ranked, "&")
    return F.concat(F.lit("https://"), host(url), path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def allowed(url: Column, *hosts: str) -> Column:
    """Whether a URL is plain http(s) to one of the hosts: no user, port or fragment."""
    return url.rlike(r"^https?://[^/?#@:]+(?:[/?][^#]*)?$") & host(url).isin(*hosts)


def parameter(url: Column, name: str) -> Column:
    """A query parameter that appears just once and isn't blank; else null."""
    found = F.regexp_extract_all(url, F.lit(rf"[?&]{name}=([^&#]*)"), F.lit(1))
    return F.when((F.size(found) == 1) & (F.trim(F.get(found, F.lit(0))) != ""), F.get(found, F.lit(0)))


def file_identity(url: Column) -> Column:
    """Struct of serial number and id of a file's URL; null unless it has both."""
    serial, file_id = parameter(url, "q_fileSn"), parameter(url, "q_fileId")
    return F.when(serial.isNotNull() & file_id.isNotNull(), F.struct(serial.alias("file_sn"), file_id.alias("file_id")))


def preview_kind(mime: Column, name: Column) -> Column:
    """image, pdf or none, by media type, else by name."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    return F.when(kind.startswith("image/"), "image").when(kind.startswith("application/pdf"), "pdf").when(
        kind.isin("", "application/octet-stream") & name.rlike(IMAGE_SUFFIX), "image"
    ).when(kind.isin("", "application/octet-stream") & name.rlike(PDF_SUFFIX), "pdf").otherwise("none")
