"""Schedules in a notice's text: its blocks, the dates in each, and the kind that the source gives each date.

A text is cut into blocks at line ends, sentence ends, bullets and before the
label of another schedule; a line that is only a label belongs to the line
below. A date's kind is that of the last kind word before it in its block, else
what the words after it say, else that of a heading right above. All of this is
done within the row, by array functions: a text is never exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.functions.extract import DATE, TIME
from placard.operators.claims import KIND_WORDS

# What ends a block, what may follow a kind word in a label, what is a label by itself, and verbs that tell a kind after a date.
HARD_END = r"(?U)[;；]|(?<!\d)\.(?=\s|$)|[!?。](?=\s|$)|\s+/\s+|[•●○■□]"
ANY_KIND = "|".join(KIND_WORDS.values())
LABEL_AHEAD = rf"(?U)(?=(?:{ANY_KIND})(?:\s*(?:기간|일시|일정|시간|시작일|종료일|마감일))?\s*[:：])"
LABEL_WORDS = r"[가-힣 ]*(?:기간|일시|일정|일자|날짜|시간|시작일|종료일|마감일|접수|모집|행사|수업)"
GENERIC_LABEL = r"(?U)\s*(?:기간|일정|일자|날짜|시간)\s*[:：]?\s*"
VERBS = {
    "application": r"(?:신청|접수|모집)(?:합니다|하세요|해|받|하|중|할)",
    "event": r"개최|열립니다|열리|진행합니다",
    "operation": r"(?:수업|운영|교육|강좌)(?:합니다|을|를|하|중)",
    "payment": r"(?:납부|결제|입금)(?:합니다|하세요|하|해야)",
    "submission": r"(?:제출|보완)(?:합니다|하세요|하|해야)",
    "effective": r"(?:시행|적용|개정)(?:합니다|됩니다|하|되)",
    "disruption": r"(?:통제|휴관|중단)(?:합니다|됩니다|하|되)",
    "result": r"(?:발표|선정)(?:합니다|됩니다|하|되)",
}
#: A kind word; "신청 일시" keeps the word before 일시.
KIND_MARK = rf"(?U)({ANY_KIND})(?:\s*일시)?"
#: What every date, and every kind word and label, has in it: by these most lines are passed over.
DIGIT, HANGUL, MARKED = r"\p{Nd}", r"[가-힣]", r"[\p{Nd}가-힣]"
CUT, SOFT = "\x01", "\x02"
MOST_LABEL = 40

#: line and block (numbers from 0), text, above: kind of the headings right above, if they have one.
BLOCKS = "array<struct<line:int,block:int,text:string,above:string>>"


def _kind_of(word: Column) -> Column:
    return F.coalesce(*[F.when(word.rlike(f"^(?:{words})"), kind) for kind, words in KIND_WORDS.items()])


def _kinds_in(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(words), kind) for kind, words in KIND_WORDS.items()]))


def _dated(text: Column) -> Column:
    return text.rlike(DATE) | text.rlike(TIME)


def _cut_line(line: Column) -> Column:
    """The blocks of one line. A cut before a label counts only after something dated or labelled."""

    def joined(unit: Column) -> Column:
        full = lambda t: _dated(t) | (F.contains(t, F.lit(":")) & t.rlike(ANY_KIND))
        walked = F.aggregate(
            F.split(unit, SOFT),
            F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
            lambda acc, piece: F.when(full(acc["open"]), F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), piece.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], piece).alias("open"))),
        )
        return F.array_append(walked["done"], walked["open"])

    return F.flatten(F.transform(F.split(F.regexp_replace(F.regexp_replace(line, LABEL_AHEAD, SOFT), HARD_END, CUT), CUT), joined))


def _is_label(text: Column) -> Column:
    """Whether a block is a schedule's label without a date: short, with a kind word or a bare 기간 and the like, and nothing after it."""
    value = F.trim(text)
    named = value.rlike(ANY_KIND) | value.rlike(rf"^{GENERIC_LABEL}$")
    return (value != "") & (F.length(value) <= MOST_LABEL) & ~_dated(value) & named & (value.rlike("[:：]$") | value.rlike(f"^{LABEL_WORDS}$"))


def _heading(line: Column) -> Column:
    return (F.trim(line) != "") & line.rlike(ANY_KIND) & ~_dated(line)


def blocks(text: Column, dated: bool = False) -> Column:
    """BLOCKS of a text, blank ones left out; a null text has none. ``dated``: only those of lines with a date.

    A line without a date is then only cut if it may hold a label, and every
    label is in Hangul; no date reaches over a cut or from a label into the line
    below, so no date is lost.
    """
    has_date = lambda line: line.rlike(DIGIT) & line.rlike(DATE)

    def described(line: Column) -> Column:
        whole = lambda units, heading, kept: F.struct(line.alias("text"), units.alias("units"), heading.alias("heading"), kept.alias("kept"))
        if not dated:
            return whole(_cut_line(line), _heading(line), F.lit(True))
        units = F.when(has_date(line) | line.rlike(HANGUL), _cut_line(line)).otherwise(F.array(line))
        return F.when(line.rlike(MARKED), whole(units, _heading(line), has_date(line))).otherwise(whole(F.array(line), F.lit(False), F.lit(False)))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), described)

    def placed(line: Column, i: Column, all_lines: Column) -> Column:
        before = F.get(all_lines, i - 1)
        label = F.element_at(before["units"], -1)
        second = F.get(all_lines, i - 2)
        near = F.when(before["heading"], F.concat(_kinds_in(before["text"]), F.when(second["heading"], _kinds_in(second["text"])).otherwise(F.array().cast("array<string>"))))
        above = F.when(F.size(F.array_distinct(near)) == 1, near[0])
        placed_units = F.transform(
            line["units"],
            lambda unit, k: F.struct(
                i.alias("line"), k.alias("block"),
                F.when((k == 0) & (i > 0) & F.coalesce(_is_label(label), F.lit(False)) & (F.trim(unit) != ""), F.concat(label, F.lit("\n"), unit)).otherwise(unit).alias("text"),
                F.when(k == 0, above).alias("above"),
            ),
        )
        return F.when(line["kept"], placed_units).otherwise(F.array().cast(BLOCKS)) if dated else placed_units

    # Bound once, so the lines aren't cut again for each of them.
    found = F.transform(F.array(lines), lambda ls: F.flatten(F.transform(ls, lambda line, i: placed(line, i, ls))))[0]
    return F.filter(found, lambda b: F.trim(b["text"]) != "").cast(BLOCKS)


def block_dates(block: Column) -> Column:
    """Array of (day, kind) of a block (text, above), in order; day as yyyy-mm-dd, a year carried from the left; kind null where the source gives none."""
    return F.when(block["text"].rlike(DIGIT) & block["text"].rlike(DATE), _block_dates(block)).otherwise(F.array().cast("array<struct<day:string,kind:string>>"))


def _block_dates(block: Column) -> Column:
    text = block["text"]
    parts = lambda n: F.regexp_extract_all(text, F.lit(DATE), F.lit(n))
    around = F.split(text, DATE, -1)
    marks = F.transform(around, lambda t: F.regexp_extract_all(t, F.lit(KIND_MARK), F.lit(1)))
    after = F.transform(around, lambda t: F.array_compact(F.array(*[F.when(t.rlike(verb), kind) for kind, verb in VERBS.items()])))
    named = F.transform(around, _kinds_in)
    dates = F.arrays_zip(parts(1).alias("y"), parts(2).alias("m"), parts(3).alias("d"))
    days = F.aggregate(
        dates, F.struct(F.lit("").alias("year"), F.array().cast("array<string>").alias("out")),
        lambda acc, t: F.struct(
            F.when(t["y"] != "", t["y"]).otherwise(acc["year"]).alias("year"),
            F.array_append(acc["out"], F.concat_ws("-", F.when(t["y"] != "", t["y"]).otherwise(acc["year"]), F.lpad(t["m"], 2, "0"), F.lpad(t["d"], 2, "0"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    rest = lambda arrays, i: F.array_distinct(F.flatten(F.slice(arrays, i + 2, F.size(arrays))))

    def kind(i: Column) -> Column:
        before = F.flatten(F.slice(marks, F.lit(1), i + 1))
        verbs, kinds = rest(after, i), rest(named, i)
        one = lambda a: F.when(F.size(a) == 1, a[0])
        generic = F.when(F.array_join(F.slice(around, F.lit(1), i + 1), "").rlike(f"^{GENERIC_LABEL}$"), block["above"])
        return F.when(F.size(before) > 0, _kind_of(F.element_at(before, -1))).when(F.size(verbs) > 0, one(verbs)).when(F.size(kinds) > 0, one(kinds)).otherwise(generic)

    real = lambda d: F.date_format(F.try_to_date(d, "yyyy-MM-dd"), "yyyy-MM-dd")
    return F.filter(F.transform(days, lambda d, i: F.struct(F.when(d.rlike("^[0-9]{4}-"), real(d)).alias("day"), kind(i).alias("kind"))), lambda x: x["day"].isNotNull())


def schedule_dates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, block, day, kind: a row for each date that a text has."""
    rows = texts.select(key, F.inline(blocks(F.col(text), dated=True)))
    return rows.select(key, "line", "block", F.inline(block_dates(F.struct("text", "above"))))


def dates_by_block(text: Column) -> Column:
    """What ``block_dates`` finds, for each block with a date."""
    return F.transform(blocks(text, dated=True), lambda b: block_dates(b))


def ground_in_text(entries: DataFrame, text: str = "source", found: str | None = None) -> DataFrame:
    """entries (kind, start_date, end_date, and their source's text) with verdict.

    ``found`` names a column with ``dates_by_block`` of the text, where that is
    there already: entries of one text then share it.

    ok: some block has both ends, and gives one of them the entry's kind;
    kind_not_in_source: a block has both, but with other kinds or none;
    date_not_in_source: no block has them; reversed: the end is before the start.
    """
    has = lambda ds, day: day.isNull() | F.exists(ds, lambda x: x["day"] == day)
    start, end = F.col("start_date"), F.col("end_date")
    dated = lambda ds: has(ds, start) & has(ds, end) & (start.isNotNull() | end.isNotNull())
    kinded = lambda ds: F.exists(ds, lambda x: ((x["day"] == start) | (x["day"] == end)) & (x["kind"] == F.col("kind")))
    looked = entries.withColumn("_blocks", F.col(found) if found else dates_by_block(F.col(text)))
    verdict = (
        F.when(end < start, "reversed").when(F.exists("_blocks", lambda ds: F.coalesce(dated(ds) & kinded(ds), F.lit(False))), "ok")
        .when(F.exists("_blocks", lambda ds: F.coalesce(dated(ds), F.lit(False))), "kind_not_in_source").otherwise("date_not_in_source")
    )
    return looked.withColumn("verdict", verdict).drop("_blocks")
