"""Budgets of bytes for a notice's files and body images, and what a file's first bytes say that it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of files by their first bytes, in hex; WEBP and plain RIFF differ from the ninth byte on.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "474946383[79]61", "webp": "52494646.{8}57454250", "pdf": "255044462D", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1"}
MIME = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf"}
#: Suffixes whose files are archives or compound documents within.
WITHIN = {"zip": ("zip", "hwpx", "docx", "xlsx", "pptx"), "ole": ("hwp", "doc", "xls", "ppt")}
MOST_IMAGE, MOST_TOTAL = 10 << 20, 30 << 20


def sniffed(content: Column) -> Column:
    """The kind that a file's first bytes say, or null."""
    head = F.hex(F.substring(content, 1, 16))
    return F.coalesce(*[F.when(head.rlike(f"^{bytes_}"), name) for name, bytes_ in MAGIC.items()])


def file_error(content: Column, declared: Column, suffix: Column, most: int = MOST_IMAGE) -> Column:
    """Why a file can't be used: empty, too_large, unknown_type, type_mismatch (its bytes aren't what type and suffix say); null if it can."""
    kind, name = sniffed(content), F.lower(suffix)
    by_suffix = F.coalesce(*[F.when(name.isin(k, "jpg" if k == "jpeg" else k), k) for k in MIME], *[F.when(name.isin(*names), k) for k, names in WITHIN.items()])
    by_type = F.coalesce(*[F.when(F.lower(F.trim(F.split(declared, ";")[0])) == mime, k) for k, mime in MIME.items()])
    differs = (by_suffix != kind) | (by_type != kind)
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty").when(F.octet_length(content) > most, "too_large").when(kind.isNull(), "unknown_type").when(F.coalesce(differs, F.lit(False)), "type_mismatch")


def read_files(spark, folder: str) -> DataFrame:
    """path, suffix, length, kind and content of the files under a folder; Spark's file source passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("suffix"), "length", sniffed(F.col("content")).alias("kind"), "content")


def within_budget(images: DataFrame, most_image: int = MOST_IMAGE, most_total: int = MOST_TOTAL) -> DataFrame:
    """images (notice_id, pos, url, digest, bytes; bytes null where it couldn't be fetched) with outcome, as its page's order decides.

    included; again (the address is in already); same (other address, bytes that
    are in already, which cost nothing); fetch_failed; too_large;
    total_size_limit (what is left doesn't hold it; smaller ones may still
    come). A repeated reference repeats its failure. A page's images are one
    group: as many as references on one page, of a few short columns.
    """
    one = F.struct("pos", "url", "digest", "bytes")
    ordered = images.groupBy("notice_id").agg(F.array_sort(F.collect_list(one)).alias("images"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("seen"), F.array().cast("array<string>").alias("digests"), F.array().cast("array<struct<pos:bigint,outcome:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        left, before = F.lit(most_total) - acc["total"], F.element_at(acc["seen"], x["url"])
        held = F.array_contains(acc["digests"], x["digest"])
        fresh = (
            F.when(left <= 0, "total_size_limit").when(x["bytes"].isNull(), "fetch_failed").when((x["bytes"] > F.least(F.lit(most_image), left)) & (left < most_image), "total_size_limit")
            .when(x["bytes"] > most_image, "too_large").when(held, "same").otherwise("included")
        )
        outcome = F.when(before.isin("included", "same"), "again").otherwise(F.coalesce(before, fresh))
        is_new, counts = before.isNull(), before.isNull() & (fresh == "included")
        return F.struct(
            (acc["total"] + F.when(counts, x["bytes"]).otherwise(0)).cast("long").alias("total"),
            F.when(is_new, F.map_concat(acc["seen"], F.map_from_arrays(F.array(x["url"]), F.array(fresh)))).otherwise(acc["seen"]).alias("seen"),
            F.when(counts, F.array_append(acc["digests"], x["digest"])).otherwise(acc["digests"]).alias("digests"),
            F.array_append(acc["out"], F.struct(x["pos"].cast("long").alias("pos"), outcome.alias("outcome"))).alias("out"),
        )

    return ordered.select("notice_id", F.inline(F.aggregate("images", start, step, lambda acc: acc["out"])))
