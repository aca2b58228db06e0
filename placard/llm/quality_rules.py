"""Quality rules whose cutoffs adapt to each language and source.

Every document gets integer measures (symbols for each 1000 words, repeated
lines for each 1000 lines, repeated words for each 1000 words, tenths of
characters for each word). A quantile sketch of a group is the number of its
documents in each bin of a measure; bins are exact up to 128 and within 1/64
above, so a sketch has a bounded size, and sketches merge by adding up, in any
order, to the same result. They are built for each (language, source), and
merged to languages and to the corpus. A group's fences lie at its quartiles
plus or minus ``reach`` times the quartile distance, or times a measure's least
spread where the quartiles nearly meet. A group of fewer than ``least_docs``
documents takes its language's fences, a language of fewer the corpus's.
The fences are joined to the documents, and what lies outside one is rejected.

All of it is DataFrame expressions; the counts are combined before the shuffle
and the sketches of all groups are small.

Edge cases: a null or empty text has no words and fails the base rules; a null
language or source is a group of its own; repeated rows are judged one by one;
an empty table gives an empty result; further columns stay out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import SPACE, checkpointed, only, packed, small, staged, table, words

SYMBOLS = "#*$%&|<>"
#: Each measure: the expression, its least quartile distance, and whether low values count too.
MEASURES = {
    "symbols": ("1000 * n_symbols div n_words", 20, False),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 150, False),
    "repeats": ("1000 * n_repeat_words div n_words", 100, False),
    "word_length": ("10 * word_chars div n_words", 10, True),
}
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def bin_of(value: str) -> str:
    """A value's bin: the value itself up to 128, then rounded down to 7 leading bits."""
    return f"{value} - {value} % shiftleft(1L, greatest(0, length(bin({value})) - 7))"


def _duck_bin_of(value: str) -> str:
    steps = " ".join(f"when {value} < {1 << k} then {value} - {value} % {1 << (k - 7)}" for k in range(8, 40))
    return f"case when {value} < 128 then {value} {steps} else {1 << 39} end"


def base_measures(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, lang, source and the counts of every text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    # Each word is hashed once; a window's hash combines those of its words.
    tokens = only(docs, *carried, "lang", "source", "text").withColumn("words", words(F.col("text"))).withColumn("each", F.transform("words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    hashed = F.transform(F.slice("each", F.lit(1), F.size("each") - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *[F.get("each", i + k) for k in range(1, WINDOW)]))
    counted = tokens.select(
        *carried, "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("words") > WINDOW, hashed).alias("windows"),
    )
    # Only texts with a repeated window need their places: sorted, equal hashes are neighbours.
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spotted = counted.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn(
        "placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)
    ).drop("lines", "windows")

    def repeated(x: Column, k: Column) -> Column:
        same = lambda other: F.coalesce(F.get("placed", other)["h"] == x["h"], F.lit(False))
        return F.when(same(k - 1) | same(k + 1), x["i"])

    starts = F.array_sort(F.filter(F.transform("placed", repeated), lambda i: i.isNotNull()))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    return spotted.withColumn("starts", starts).withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("placed", "starts")


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """q1, q3 and n of each group of sketches, merged to these keys."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n")).withColumn("all", F.lit(True))
    by = ", ".join([*keys, "all", "measure"])
    return merged.selectExpr("*", f"sum(n) over (partition by {by} order by bin) as upto", f"sum(n) over (partition by {by}) as total").groupBy(*keys, "measure").agg(
        F.expr("min(case when 4 * upto >= total then bin end)").alias("q1"), F.expr("min(case when 4 * upto >= 3 * total then bin end)").alias("q3"), F.max("total").alias("n")
    )


def fences(measured: DataFrame, reach: int = 3, least_docs: int = 30) -> DataFrame:
    """lang, source and a low and a high fence for each measure; one row for each (language, source)."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(bin_of(f"({e})")).cast("long").alias("bin")) for m, (e, _, _) in MEASURES.items()])
    sketch = checkpointed(measured.filter("n_words > 0").select("lang", "source", F.explode(each).alias("m")).groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n")))
    own, lang, corpus = (_quantiles(sketch, keys).alias(name) for keys, name in ((["lang", "source"], "own"), (["lang"], "lang_"), ([], "corpus")))
    joined = own.join(lang, F.expr("own.lang <=> lang_.lang and own.measure = lang_.measure"), "left").join(corpus, F.expr("own.measure = corpus.measure"), "left")
    pick = lambda q: f"case when own.n >= {least_docs} then own.{q} when lang_.n >= {least_docs} then lang_.{q} else corpus.{q} end"
    picked = joined.selectExpr("own.lang as lang", "own.source as source", "own.measure as measure", f"{pick('q1')} as q1", f"{pick('q3')} as q3")
    spread = " ".join(f"when measure = '{m}' then {least}" for m, (_, least, _) in MEASURES.items())
    fenced = picked.selectExpr("lang", "source", "measure", f"{reach} * greatest(q3 - q1, case {spread} end) as margin", "q1", "q3")
    out = [F.expr(f"max(case when measure = '{m}' then q3 + margin end)").alias(f"{m}_high") for m in MEASURES]
    out += [F.expr(f"max(case when measure = '{m}' then q1 - margin end)").alias(f"{m}_low") for m, (_, _, low) in MEASURES.items() if low]
    return fenced.groupBy("lang", "source").agg(*out)


def _judged(measured: DataFrame, reach: int, least_docs: int) -> DataFrame:
    limits = small(checkpointed(fences(measured.select("lang", "source", *COUNTS), reach, least_docs))).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    outside = [f"({e}) > {m}_high" for m, (e, _, _) in MEASURES.items()] + [f"({e}) < {m}_low" for m, (e, _, low) in MEASURES.items() if low]
    joined = measured.join(limits, F.expr("lang <=> of_lang and source <=> of_source"), "left")
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return joined.withColumn("base_failed", failed).withColumn("kept", F.expr(f"case when base_failed then false else not ({' or '.join(outside)}) end")).drop("of_lang", "of_source")


def judge(docs: DataFrame, reach: int = 3, least_docs: int = 30) -> DataFrame:
    """Every row's counts, base_failed and kept."""
    return _judged(checkpointed(base_measures(docs, "doc_id")), reach, least_docs)


def keep_good(docs: DataFrame, reach: int = 3, least_docs: int = 30) -> DataFrame:
    """docs without the rejected rows; each row is judged by itself, so null and repeated doc_ids make no difference."""
    measured = staged(base_measures(packed(docs, "lang", "source", "text"), "row"))
    return _judged(measured, reach, least_docs).filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")



def _duck(expression: str) -> str:
    return expression.replace(" div ", " // ")


def _duck_quantiles(name: str, keys: list[str]) -> str:
    by = ", ".join([*keys, "measure"])
    return f"""{name} as (select {by}, min(case when 4 * upto >= total then bin end) as q1, min(case when 4 * upto >= 3 * total then bin end) as q3, max(total) as n
  from (select *, sum(n) over (partition by {by} order by bin) as upto, sum(n) over (partition by {by}) as total
        from (select {by}, bin, sum(n) as n from sketch group by {by}, bin)) group by {by})"""


def _pick(q: str) -> str:
    return f"case when o.n >= 30 then o.{q} when l.n >= 30 then l.{q} else g.{q} end"


_OUTSIDE = " or ".join(f"(j.measure = '{m}' and ({_duck(e)} > q3 + margin{f' or {_duck(e)} < q1 - margin' if low else ''}))" for m, (e, _, low) in MEASURES.items())
OP5_SQL = f"""
with w as (select doc_id, lang, source, coalesce(text, '') as text,
                  list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') as ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
g as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as h from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) > 8)),
r as (select doc_id, i, count(*) over (partition by doc_id, h) as n from g),
c as (select doc_id, count(distinct i + d) as n_repeat_words from r, (select unnest(range(8)) as d) where n > 1 group by doc_id),
m as (select w.doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
             (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols, len(ls)::bigint as n_lines,
             (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from w left join c using (doc_id)),
sketch as (select lang, source, measure, bin, count(*) as n from ({" union all ".join(f"select lang, source, '{m}' as measure, {_duck_bin_of(f'({_duck(e)})')} as bin from m where n_words > 0" for m, (e, _, _) in MEASURES.items())}) group by all),
{_duck_quantiles("own", ["lang", "source"])},
{_duck_quantiles("lng", ["lang"])},
{_duck_quantiles("corpus", [])},
j as (select lang, source, measure, q1, q3, 3 * greatest(q3 - q1, case {" ".join(f"when measure = '{m}' then {least}" for m, (_, least, _) in MEASURES.items())} end) as margin
      from (select o.lang, o.source, o.measure, {_pick("q1")} as q1, {_pick("q3")} as q3
            from own o left join lng l on o.lang is not distinct from l.lang and o.measure = l.measure left join corpus g on o.measure = g.measure)),
v as (select m.doc_id, bool_or({_OUTSIDE}) as outside from m join j on m.lang is not distinct from j.lang and m.source is not distinct from j.source where n_words > 0 group by m.doc_id)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not coalesce(outside, false) as kept
from m left join v using (doc_id)
"""
