"""Keys and fingerprints of notices, files and contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_key(file_id: Column, url: Column) -> Column:
    """id:<file_id>, or url:<sha256 of the url> where the file has no id."""
    return F.when(file_id.isNotNull(), F.concat(F.lit("id:"), file_id)).otherwise(F.concat(F.lit("url:"), F.sha2(url, 256)))


def _json_string(text: Column) -> Column:
    """A JSON string as a compact writer makes it: non-ASCII kept, control characters in lower-case hex."""
    inner = F.to_json(F.array(text))
    for code in (*range(0x0B, 0x0C), *range(0x0E, 0x20)):
        inner = F.replace(inner, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return inner


def revision_hash(title: Column, body: Column) -> Column:
    """sha256 of the compact JSON array [title, body]; a null stays null in it."""
    parts = [F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(_json_string(c), r"^\[|\]$", "")) for c in (title, body)]
    return F.sha2(F.concat(F.lit("["), parts[0], F.lit(","), parts[1], F.lit("]")), 256)


def contract_key(model: Column, prompt_version: Column) -> Column:
    """Compact JSON with sorted keys, at most 1024 characters; null where longer."""
    key = F.to_json(F.struct(model.alias("model"), prompt_version.alias("prompt_version")))
    return F.when(F.length(key) <= 1024, key)
