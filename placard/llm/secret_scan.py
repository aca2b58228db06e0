"""Secrets in texts: fixed patterns, and windows of high entropy.

The base kinds are patterns. The entropy scan adds to them: candidate strings
are runs of letters, digits and +/_=-; within one, each class of characters
(hex digits; letters and digits; all of them) has its own runs, window of
``WINDOW`` characters and least Shannon entropy. A window slides by one
character at a time, and only the counts of the character that leaves and the
one that enters change. Overlapping windows at or over the limit form a span.
An allow-list suppresses what isn't a secret: plain words, numbers, UUIDs,
paths of words and the like. A span within a base span isn't reported twice.

Edge cases: a null text counts as empty and has no spans; very long texts are
scanned whole, in one pass; each of repeated rows gets its own result; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import only, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
#: Runs that can hold an access key, a hex string or a candidate; the shortest of these has 16 characters.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
WINDOW = 20
#: Each class: its characters and the least entropy, in bits a character, of a window.
CLASSES = ((re.compile(r"[0-9a-fA-F]{20,}"), 3.1), (re.compile(r"[A-Za-z0-9]{20,}"), 3.7), (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9))
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[0-9]+",
        r"[A-Za-z]?[a-z]+|[A-Z]+",  # a word
        r"(?:[A-Z][a-z]+){2,}|[a-z]+(?:[A-Z][a-z]+)+",  # camel case
        r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
        r"(.{1,4})\1{4,}.{0,4}",  # a short pattern again and again
    )
)
#: What joins words and numbers in names, slugs and paths, and what may stand between; the first part is never empty.
JOINT, PART = re.compile(r"[-_/=+]"), re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+")
_PLOGP = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def suppressed(run: str) -> bool:
    """Whether the allow-list takes a string for no secret; in time linear in its length."""
    if any(a.fullmatch(run) for a in ALLOWED):
        return True
    first, *rest = JOINT.split(run)
    return bool(first and rest) and all(PART.fullmatch(p) for p in (first, *rest))


def high_entropy(run: str, least: float) -> list[tuple[int, int]]:
    """The spans of a run that windows of at least this entropy cover."""
    if len(run) < WINDOW:
        return []
    counts: dict[str, int] = {}
    for c in run[:WINDOW]:
        counts[c] = counts.get(c, 0) + 1
    total, most = sum(_PLOGP[n] for n in counts.values()), WINDOW * (math.log2(WINDOW) - least)
    spans: list[tuple[int, int]] = []
    for start in range(len(run) - WINDOW + 1):
        if start:
            old, new = run[start - 1], run[start + WINDOW - 1]
            n = counts[old]
            total += _PLOGP[n - 1] - _PLOGP[n]
            counts[old] = n - 1
            n = counts.get(new, 0)
            total += _PLOGP[n + 1] - _PLOGP[n]
            counts[new] = n + 1
        if total <= most + 1e-9:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], start + WINDOW)
            else:
                spans.append((start, start + WINDOW))
    return spans


def entropy_spans(run: str) -> list[tuple[int, int]]:
    """The spans of a candidate string that no class's allow-list suppresses; spans that overlap are joined."""
    if suppressed(run):
        return []
    found = []
    for characters, least in CLASSES:
        for match in characters.finditer(run):
            if not suppressed(match[0]):
                found += [(match.start() + a, match.start() + b) for a, b in high_entropy(match[0], least)]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span of a text, in order."""
    text, base, more = text or "", [], []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):
        at, candidate = run.start(), run[0]
        base += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(candidate) if len(m[0]) >= 16]
        base += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(candidate)]
        if len(candidate) >= WINDOW:
            more += [(at + a, 3, at + b) for a, b in entropy_spans(candidate)]
    if more and base:
        more = [m for m in more if not any(b[0] <= m[0] and m[2] <= b[2] for b in base)]
    return sorted(base + more)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, SPANS)], ["doc_id", "spans"])

    SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each span's text replaced; overlapping spans become one mark.

    Null texts stay null, empty ones empty; every row is redacted by itself, so
    null and repeated doc_ids make no difference; other columns stay as they are.
    """

    def cut(text: str | None) -> str | None:
        out, at = [], 0
        for a, _, b in scan(text):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return text if text is None else "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(cut, na_action="ignore")

    return docs.withColumn("text", clean("text"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
