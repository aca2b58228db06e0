"""Groups of a summary's notes that belong to one rule of the source, and a choice that cuts no group.

A rule that restricts something and names an exception may come back as several
notes. Notes are linked where the rule's text holds them, and where one
restricts and another permits an action of the rule. Links go through what is
shared (a rule, or an action within a notice), so no pairs of notes are made;
groups are the connected components within a notice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placard.sources.shared import shared_dir

# Words of restrictions, exceptions, actions, permissions and negations, what ends a rule, and how many notes are shown.
RESTRICTION = r"(?U)불가(?!피)|금지|할\s*수\s*없|하지\s*못"
EXCEPTION = r"(?U)불가피|예외|경우(?:에)?\s*한(?:하여|해)|다만|(?:^|\s)단\s*[,，:：]"
RULE_END = r"(?U)\n|[;；※•●○■□]|[!?。](?=\s|$)|(?<!\d)\.(?=\s|$)"
ACTION = r"취소|환불|반환|변경|접수|신청|예약|등록|제출|참여|입장|주차|수령|양도|납부|지급|발급|사용|이용|방문"
PERMISSION = r"(?U)가능|할\s*수\s*있|허용"
NEGATION = r"(?U)아니|아닙|않|없|못|불가(?!피)|금지"
MOST_NOTES = 5
#: Ends of rules with nothing but white space between them are one.
RULE_ENDS = rf"(?:{RULE_END})(?:\s*(?:{RULE_END}))*"
_CUT, _END = "\x01", "\x02"


def rules(text: Column) -> Column:
    """The parts of a text that restrict something and name an exception; one that begins with its exception's word belongs to the part before."""
    marked = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), RULE_ENDS, f"{_CUT}$0{_END}"), _CUT)
    pieces = F.transform(marked, lambda p: F.struct(F.regexp_extract(p, f"(?s)^([^{_END}]*){_END}", 1).alias("end"), F.regexp_replace(p, f"(?s)^[^{_END}]*{_END}", "").alias("text")))
    units = F.filter(pieces, lambda p: F.trim(p["text"]) != "")

    def joined(unit: Column, i: Column, all_units: Column) -> Column:
        after = F.get(all_units, i + 1)
        goes_on = ~unit["text"].rlike(EXCEPTION) & F.coalesce(F.regexp_replace(after["text"], r"(?U)^\s+", "").rlike(f"^(?:{EXCEPTION})"), F.lit(False))
        return F.when(unit["text"].rlike(RESTRICTION), F.when(goes_on, F.concat(unit["text"], after["end"], after["text"])).otherwise(unit["text"]))

    found = F.transform(F.array(units), lambda us: F.transform(us, lambda u, i: joined(u, i, us)))[0]
    return F.array_distinct(F.filter(found, lambda r: r.isNotNull() & r.rlike(EXCEPTION)))


def actions(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ACTION), F.lit(0)))


def permitted(note: Column) -> Column:
    """The actions that a note permits: one whose own clause, up to the next action, denies nothing and permits, or any such in a note of exceptions."""
    named, between = F.regexp_extract_all(note, F.lit(ACTION), F.lit(0)), F.split(note, ACTION, -1)
    clause = lambda i: F.get(between, i + 1)
    judged = F.transform(named, lambda a, i: F.when(~clause(i).rlike(NEGATION) & (clause(i).rlike(PERMISSION) | note.rlike(EXCEPTION)), a))
    return F.array_distinct(F.array_compact(judged))


def links(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """(notice_id, pos, hub): notes (notice_id, pos, note) and what links them; sources: notice_id, text.

    A note and a rule of its notice meet in one row each; a summary has few notes.
    """
    each = sources.select("notice_id", F.explode(rules(F.col("text"))).alias("rule")).distinct()
    allowed = each.select("notice_id", F.explode(actions(F.col("rule"))).alias("action")).distinct()
    restricts, permits = F.when(F.col("note").rlike(RESTRICTION), actions(F.col("note"))), permitted(F.col("note"))
    none = F.array().cast("array<string>")
    named = lambda found, side: F.transform(F.coalesce(found, none), lambda x: F.struct(x.alias("action"), F.lit(side).alias("side")))
    sides = notes.select("notice_id", "pos", F.explode(F.concat(named(restricts, "r"), named(permits, "p"))).alias("m")).select("notice_id", "pos", "m.*")
    meeting = sides.join(allowed, ["notice_id", "action"])
    both = meeting.groupBy("notice_id", "action").agg(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "p").alias("p"), F.min("pos").alias("low"), F.max("pos").alias("high")).filter("r > 0 and p > 0 and low < high")
    by_action = meeting.join(both.select("notice_id", "action"), ["notice_id", "action"]).select("notice_id", "pos", F.concat(F.lit("action:"), "action").alias("hub"))

    before = F.length(F.regexp_extract("rule", f"(?s)^(.*?)(?:{EXCEPTION})", 1))
    late = F.contains(F.expr("substr(rule, greatest(1, _before - length(note) + 2))"), F.col("note"))
    held = notes.join(each, "notice_id").filter("note <> '' and contains(rule, note)").withColumn("_before", before).withColumns({"_late": late, "hub": F.concat(F.lit("rule:"), F.sha2("rule", 256))})
    told = held.groupBy("notice_id", "hub").agg(F.bool_or(F.col("note").rlike(RESTRICTION)).alias("r"), F.bool_or("_late").alias("e")).filter("r and e")
    by_rule = held.join(told.select("notice_id", "hub"), ["notice_id", "hub"]).select("notice_id", "pos", "hub")
    return by_action.unionByName(by_rule).distinct()


def grouped(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """notes (notice_id, pos, note) with note_group: the least pos of the notes linked with it.

    Each round hands a hub's least group to its notes, until none changes.
    """
    shared_dir(notes.sparkSession)
    edges = links(notes, sources).withColumn("note_group", F.col("pos")).checkpoint()
    while True:
        low = edges.groupBy("notice_id", "hub").agg(F.min("note_group").alias("low"))
        best = edges.join(low, ["notice_id", "hub"]).groupBy("notice_id", "pos").agg(F.min("low").alias("best"))
        after = edges.join(best, ["notice_id", "pos"]).select("notice_id", "pos", "hub", F.col("best").alias("note_group"), (F.col("best") < F.col("note_group")).alias("moved")).checkpoint()
        edges = after.drop("moved")
        if after.filter("moved").isEmpty():
            found = edges.groupBy("notice_id", "pos").agg(F.min("note_group").alias("note_group"))
            return notes.join(found, ["notice_id", "pos"], "left").withColumn("note_group", F.coalesce("note_group", "pos"))


def chosen(groups: DataFrame, most: int = MOST_NOTES) -> DataFrame:
    """groups (notice_id, pos, note, note_group) with kept: all where a notice has at most so many notes, else whole groups while they fit, those of several notes first.

    Of each size only the first few groups can be chosen, so a notice's other groups aren't gathered.
    """
    sizes = groups.groupBy("notice_id", "note_group").agg(F.count("*").alias("size"))
    totals = sizes.groupBy("notice_id").agg(F.sum("size").alias("total")).filter(F.col("total") > most)
    fitting = sizes.filter(F.col("size") <= most).join(totals, "notice_id").withColumn("nth", F.expr("row_number() over (partition by notice_id, size order by note_group)")).filter(F.col("nth") <= most)
    ordered = fitting.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct((F.col("size") == 1).alias("single"), "note_group", F.col("size").cast("int").alias("size")))).alias("g"))
    picked = F.aggregate(
        "g", F.struct(F.lit(most).alias("left"), F.array().cast("array<bigint>").alias("taken")),
        lambda acc, x: F.when(x["size"] <= acc["left"], F.struct((acc["left"] - x["size"]).alias("left"), F.array_append(acc["taken"], x["note_group"].cast("bigint")).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"],
    )
    taken = totals.select("notice_id").join(ordered.select("notice_id", picked.alias("taken")), "notice_id", "left").withColumn("crowded", F.lit(True))
    fits = F.coalesce(~F.col("crowded"), F.lit(True)) | F.coalesce(F.array_contains("taken", F.col("note_group").cast("bigint")), F.lit(False))
    return groups.join(taken, "notice_id", "left").withColumn("kept", fits).drop("taken", "crowded")
