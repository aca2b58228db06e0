"""URL filter: rules first, then naive Bayes over the words of host and path.

Names in hosts are often words strung together. A unigram model gives each word
its share of all words met in URLs; the Viterbi path over a name's cuts is the
likeliest split into words. A multinomial naive Bayes model with Laplace
smoothing then scores the words of host and path.

The unigram counts cover all paths, the text of all pages where there is html,
and the parts of host names. A host's parts may be words strung together, so
they count once for each further host that has them, however many rows a host
has; a name of one host only isn't evidence for itself. All counts stay in a
Spark table: each distinct name is split by what that table says of its own
substrings. The classifier is fitted on ``sample_rows`` distinct URLs (those of
least hash) labelled by seed words: a URL whose host's words, after the split,
name one is a block example. Log odds are whole millionths, so a score doesn't
depend on the order of its sum.

Up to ``BROADCAST_NAMES`` distinct names, their words are broadcast; beyond,
names and words are joined, with the same result.

Edge cases: a null url, or one without "://", has an empty host and path and
takes the model's verdict on no words, which is the prior; repeated rows are
judged one by one; an empty table gives an empty result; further columns but
html are ignored; a very long name is split in linear time, words of up to 24 letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import checkpointed, only, table

#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words that mark a URL as a block example when the model is fitted.
BLOCK_SEEDS = ("spam", "casino", "pills", "bets", "adult", "ads", "porn", "viagra", "poker", "xxx")
LONGEST = 24
BROADCAST_NAMES = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null where none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def split_name(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The likeliest words of a name of letters. An unknown word costs ``unknown`` and as much again for each letter."""
    best, cut = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            options.append((best[start] + cost.get(word, unknown * (1 + len(word))), start))
        value, start = min(options)
        best.append(value)
        cut.append(start)
    words, end = [], len(name)
    while end:
        words.append(name[cut[end] : end])
        end = cut[end]
    return words[::-1]


@dataclass(frozen=True)
class Model:
    """Unigram counts (word, count) of ``total`` words in all, and the classifier's log odds in millionths."""

    counts: DataFrame
    total: int
    odds: dict[str, int]
    prior: int


def _names(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def word_counts(urls: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(word, count) of urls (host, path) and of texts (text)."""
    counted = urls.select(F.explode(_names(F.col("path"))).alias("word")).groupBy("word").count()
    hosts = urls.select("host").distinct().select(F.explode(F.array_distinct(_names(F.col("host")))).alias("word")).groupBy("word").agg((F.count("*") - 1).alias("count"))
    counted = counted.unionByName(hosts)
    if texts is not None:
        counted = counted.unionByName(texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter(F.col("word").rlike("^[a-z]+$")).groupBy("word").count())
    return checkpointed(counted.groupBy("word").agg(F.sum("count").alias("count")).filter("count > 0"))


def split_names(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(name, words) of distinct names (name): the Viterbi split of each, from the counts of its substrings."""
    cuts = f"flatten(transform(sequence(1, length(name)), i -> transform(sequence(1, least({LONGEST}, length(name) - i + 1)), n -> substring(name, i, n))))"
    pieces = names.selectExpr("name", f"explode(array_distinct({cuts})) as word")
    known = pieces.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "count")).alias("known"))
    unknown = math.log(total + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist(), strict=True):
                found.append(split_name(name, {k["word"]: unknown - math.log(k["count"]) for k in known or ()}, unknown))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.list_(pa.string()))], ["name", "words"])

    return checkpointed(names.join(known, "name", "left").mapInArrow(run, "name string, words array<string>"))


def url_words(urls: DataFrame, counts: DataFrame, total: int, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """urls (host, path and more) with words: the split words of host and path, those of the path marked by a slash."""
    parts = {"of_host": _names(F.col("host")), "of_path": _names(F.col("path"))}
    names = urls.select(F.explode(F.array_distinct(F.concat(*parts.values()))).alias("name")).distinct()
    split = split_names(names, counts, total)
    if split.count() <= broadcast_names:
        shared = urls.sparkSession.sparkContext.broadcast({r.name: r.words for r in split.collect()})

        @F.pandas_udf("array<string>")
        def words(of_host: pd.Series, of_path: pd.Series) -> pd.Series:
            known = shared.value
            return pd.Series([[w for n in h for w in known[n]] + ["/" + w for n in p for w in known[n]] for h, p in zip(of_host, of_path, strict=True)], dtype=object)

        return urls.withColumn("words", words(*parts.values()))
    marked = F.concat(F.transform(parts["of_host"], lambda n: F.struct(F.lit("").alias("mark"), n.alias("name"))), F.transform(parts["of_path"], lambda n: F.struct(F.lit("/").alias("mark"), n.alias("name"))))
    each = urls.select("host", "path").distinct().select("host", "path", F.posexplode(marked).alias("at", "n")).select("host", "path", "at", "n.*")
    found = each.join(split, "name").select("host", "path", F.struct("at", F.transform("words", lambda w: F.concat("mark", w)).alias("words")).alias("w"))
    grouped = found.groupBy("host", "path").agg(F.flatten(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["words"])).alias("words"))
    return urls.join(grouped, ["host", "path"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def fit(urls: DataFrame, sample_rows: int = 20_000, seeds: tuple[str, ...] = BLOCK_SEEDS, texts: DataFrame | None = None) -> Model:
    """The model of urls (host, path), with the words of texts (text). ``sample_rows`` bounds the labelled examples, and with them what the driver gets."""
    counts = word_counts(urls, texts)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first().n
    sample = urls.groupBy("host", "path").agg(F.lit(1)).orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample_rows).select("host", "path")
    seeded = F.exists("words", lambda w: w.isin(*seeds))  # words of the path are marked
    examples = checkpointed(url_words(checkpointed(sample), counts, total).select(seeded.cast("int").alias("block"), "words"))
    uses = examples.select("block", F.explode("words").alias("word")).groupBy("word").agg(F.sum("block").alias("b"), F.sum(1 - F.col("block")).alias("a")).collect()
    size = examples.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    blocks, allows = (sum(r[k] for r in uses) + len(uses) + 1 for k in (1, 2))
    odds = {r.word: round(1e6 * (math.log((r.b + 1) / blocks) - math.log((r.a + 1) / allows))) for r in uses}
    return Model(counts, total, odds, round(1e6 * (math.log(size.b + 1) - math.log(size.n - size.b + 1))))


def page_text(html: Column) -> Column:
    """The text of a page, without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: Model | None = None, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """page_id, host, path, rule, verdict, words and score (millionths) of every row of pages (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    parts = only(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    texts = pages.select(page_text(F.col("html")).alias("text")) if "html" in pages.columns else None
    model = model or fit(parts.select("host", "path"), texts=texts)
    shared = pages.sparkSession.sparkContext.broadcast(model.odds)

    @F.pandas_udf("long")
    def odds(words: pd.Series) -> pd.Series:
        known = shared.value
        return words.map(lambda ws: sum(known.get(w, 0) for w in ws))

    split = url_words(parts, model.counts, model.total, broadcast_names)
    ruled = split.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", F.lit(model.prior) + odds("words"))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") > 0, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "words", "score")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
