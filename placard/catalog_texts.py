"""Queries of schedules, places of quotes and terms, JSON shapes, budgets and SQL table functions, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placard.catalog import NOW, VIEW_SQL, _query, _table, _view, notices
from placard.functions import places, registry, shapes
from placard.operators import budgets, notes, schedules
from placard.plans import views


def _line(n: int):
    return F.coalesce(F.get(F.split("text", "\n"), F.lit(n)), F.lit(""))


def _noticed(spark, d) -> DataFrame:
    """documents with source: their lines, with a labelled schedule after the first and one under a heading after the second."""
    x, y = F.expr("n_chars % 20 + 1"), F.expr("n_chars % 28 + 1")
    heading = F.when(F.col("lang") == "en", "행사 안내").when(F.col("lang") == "de", "납부 안내").otherwise("안내")
    lines = [_line(0), F.concat(F.lit("접수 기간: 2026. 3. "), x, F.lit(". ~ 3. "), x + 4, F.lit(".")), _line(1), heading, F.concat(F.lit("기간: 2026. 5. "), y, F.lit(".")), F.lit(""), F.array_join(F.slice(F.split("text", "\n"), 3, 1 << 30), "\n")]
    return _table(spark, d, "documents").withColumn("source_text", F.concat_ws("\n", *lines)).withColumns({"x": x, "y": y})


@_query("""with e as (select doc_id, n_chars % 20 + 1 as x, n_chars % 28 + 1 as y, lang from documents)
select doc_id, '2026-03-' || lpad(d::varchar, 2, '0') as day, 'application' as kind from e, unnest([x, x + 4]) as u(d)
union all select doc_id, '2026-05-' || lpad(y::varchar, 2, '0'), case lang when 'en' then 'event' when 'de' then 'payment' end from e""")
def schedule_blocks(spark, d):
    """Each date of a text with the kind that its block, or the heading above, gives it."""
    return schedules.schedule_dates(_noticed(spark, d), "doc_id", "source_text").filter("startswith(day, '2026-')").select("doc_id", "day", "kind")


@_query("""with e as (select doc_id, n_chars, lang, source, n_chars % 20 + 1 as x, n_chars % 28 + 1 as y from documents),
a as (select doc_id, 0 as entry, case when source = 'src0' then 'payment' else 'application' end as kind, make_date(2026, 3, x::int) as s, case n_chars % 3 when 0 then date '2026-02-28' when 1 then make_date(2026, 3, (x + 4)::int) else make_date(2026, 3, (x + 5)::int) end as t, x, y, lang from e
  union all select doc_id, 1, 'event', make_date(2026, 5, (case when n_chars % 5 = 0 then y % 28 + 1 else y end)::int), null, x, y, lang from e)
select doc_id, entry, case when t < s then 'reversed'
  when entry = 0 then case when t <> make_date(2026, 3, (x + 4)::int) then 'date_not_in_source' when kind = 'application' then 'ok' else 'kind_not_in_source' end
  when s <> make_date(2026, 5, y::int) then 'date_not_in_source' when lang = 'en' then 'ok' else 'kind_not_in_source' end as verdict from a""")
def schedules_grounded(spark, d):
    """Whether a summary's dates stand in the source's blocks under their kind; the blocks are found in the text."""
    day = lambda month, n: F.concat(F.lit(f"2026-{month}-"), F.lpad(n.cast("string"), 2, "0"))
    x, y, n = F.col("x"), F.col("y"), F.col("n_chars")
    first = F.struct(F.lit(0).alias("entry"), F.when(F.col("source") == "src0", "payment").otherwise("application").alias("kind"), day("03", x).alias("start_date"), F.when(n % 3 == 0, "2026-02-28").when(n % 3 == 1, day("03", x + 4)).otherwise(day("03", x + 5)).alias("end_date"))
    second = F.struct(F.lit(1).alias("entry"), F.lit("event").alias("kind"), day("05", F.when(n % 5 == 0, y % 28 + 1).otherwise(y)).alias("start_date"), F.lit(None).cast("string").alias("end_date"))
    texts = _noticed(spark, d).withColumn("found", schedules.dates_by_block(F.col("source_text")))  # once for both entries
    return schedules.ground_in_text(texts.select("doc_id", "found", F.inline(F.array(first, second))), found="found").select("doc_id", "entry", "verdict")


@_query(r"""with q as (select doc_id, text, regexp_extract_all(substr(text, 1, 4000), '[A-Za-z]+') as w from documents),
p as (select doc_id, text, array_to_string(w[5:7], '[ \t\n\r]+') as loose from q where len(w) >= 7)
select doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 as n_exact,
  length(substr(text, 1, strpos(text, regexp_extract(text, loose)) - 1)) + length(regexp_replace(substr(text, 1, strpos(text, regexp_extract(text, loose)) - 1), '[^\x{10000}-\x{10FFFF}]', '', 'g')) as start16
from p where regexp_matches(text, loose)""")
def quotes_placed(spark, d):
    """In whole documents: how often "the" stands, and where first three words stand that are quoted with other white space."""
    words = F.regexp_extract_all(F.substring("text", 1, 4000), F.lit("[A-Za-z]+"), F.lit(0))
    q = _table(spark, d, "documents").withColumn("w", words).filter(F.size("w") >= 7)
    once, loose = places.quote_places(F.col("text"), F.lit("the")), places.quote_places(F.col("text"), F.array_join(F.slice("w", 5, 3), " \n\t "))
    found = q.select("doc_id", F.size(once["places"]).cast("long").alias("n_exact"), loose["places"].alias("p"))
    return found.filter(F.size("p") > 0).select("doc_id", "n_exact", F.col("p")[0]["start16"].cast("long").alias("start16"))


@_query(r"""with t as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) as term from benchmark), l as (select distinct length(term) as n from t),
d as (select doc_id, text, unnest(range(1, length(text) + 1)) as i from documents),
m as (select doc_id, i from d, l where i + n - 1 <= length(text) and substr(text, i, n) in (select term from t where length(term) = n))
select documents.doc_id, count(distinct i) as n_places from documents left join m using (doc_id) group by documents.doc_id""")
def terms_found(spark, d):
    """At how many places of each document some word of the benchmark's texts begins: thousands of terms, one pass over each text."""
    terms = _table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("term"))
    return places.mark_terms(_table(spark, d, "documents").select("doc_id", "text"), terms).select("doc_id", "n_places")


_CARDS = ("audience", "deadline", "action", "notes")


@_query(r"""with c as (select doc_id, n_chars % 9 as k, string_split(text, chr(10)) as l, lang, source from documents),
j as (select doc_id, case k
  when 0 then '{"audience": null, "deadline": "' || coalesce(source, 'x') || '", "action": null}' when 1 then '{"audience": null, "deadline": "d", "action": null, "notes": null, "' || coalesce(lang, 'x') || '": 1}'
  when 2 then '{"audience": ' || doc_id || ', "deadline": "d", "action": null, "notes": [1]}' when 3 then '{"audience": "　 ", "deadline": "d", "action": null, "notes": null}' when 4 then '{"audience": "a\nb", "deadline": "d", "action": null, "notes": null}'
  when 5 then '[' || doc_id || ']' when 6 then '{"audience": "a", "deadline": "' || coalesce(source, 'x') when 7 then null else '{"notes": null, "audience": "' || coalesce(lang, 'x') || '", "deadline": "d", "action": null}' end as j from c),
v as (select *, json_valid(j) as ok from j),
t as (select doc_id, j, ok, case when ok then json_type(j) end as kind, case when ok and json_type(j) = 'OBJECT' then json_keys(j) else [] end as keys,
  case when ok then [json_extract_string(j, '$.audience'), json_extract_string(j, '$.deadline'), json_extract_string(j, '$.action'), json_extract_string(j, '$.notes')] else [] end as texts,
  case when ok then [json_type(j, '$.audience'), json_type(j, '$.deadline'), json_type(j, '$.action'), json_type(j, '$.notes')] else [] end as kinds from v)
select doc_id, case when j is null then '' when not ok then 'malformed' when kind <> 'OBJECT' then 'not_object' else array_to_string(list_sort(list_filter([
  case when len(list_filter(keys, lambda x: x not in ('audience', 'deadline', 'action', 'notes'))) > 0 then 'extra_key' end, case when len(list_filter(['audience', 'deadline', 'action', 'notes'], lambda x: not list_contains(keys, x))) > 0 then 'missing_key' end,
  case when len(list_filter(kinds, lambda x: x not in ('NULL', 'VARCHAR'))) > 0 then 'type' end, case when len(list_filter(texts, lambda x: regexp_full_match(x, '[\s\x{3000}]*'))) > 0 then 'blank' end, case when len(list_filter(texts, lambda x: contains(x, chr(10)))) > 0 then 'line_break' end], lambda x: x is not null)), ',') end as errors from t""")
def card_shapes(spark, d):
    """What is wrong with a cards object in JSON, broken texts included."""
    k, c = F.col("n_chars") % 9, lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    lang, source, doc = F.coalesce("lang", F.lit("x")), F.coalesce("source", F.lit("x")), F.col("doc_id").cast("string")
    made = (
        F.when(k == 0, c('{"audience": null, "deadline": "', source, '", "action": null}')).when(k == 1, c('{"audience": null, "deadline": "d", "action": null, "notes": null, "', lang, '": 1}'))
        .when(k == 2, c('{"audience": ', doc, ', "deadline": "d", "action": null, "notes": [1]}')).when(k == 3, '{"audience": "\\u3000 ", "deadline": "d", "action": null, "notes": null}').when(k == 4, '{"audience": "a\\nb", "deadline": "d", "action": null, "notes": null}')
        .when(k == 5, c("[", doc, "]")).when(k == 6, c('{"audience": "a", "deadline": "', source)).when(k == 8, c('{"notes": null, "audience": "', lang, '", "deadline": "d", "action": null}'))
    )
    return _table(spark, d, "documents").select("doc_id", F.array_join(shapes.card_errors(made), ",").alias("errors"))


@_query("""with recursive i as (select l_orderkey as notice_id, l_linenumber as pos, (l_partkey % 3)::varchar as url, (l_suppkey % 4)::varchar as digest, case when l_returnflag = 'R' then null else (l_quantity * 10)::bigint end as bytes,
  row_number() over (partition by l_orderkey order by l_linenumber, (l_partkey % 3)::varchar, (l_suppkey % 4)::varchar, case when l_returnflag = 'R' then null else (l_quantity * 10)::bigint end nulls first) as k from lineitem),
f as (select notice_id, 0::bigint as k, 0::bigint as total, map([]::varchar[], []::varchar[]) as seen, []::varchar[] as digests, null::bigint as pos, null::varchar as outcome from i where k = 1
  union all
  select notice_id, k, total + case when b is null and fresh = 'included' then bytes else 0 end, case when b is null then map_concat(seen, map([url], [fresh])) else seen end, case when b is null and fresh = 'included' then list_append(digests, digest) else digests end, pos, case when b in ('included', 'same') then 'again' else coalesce(b, fresh) end
  from (select f.notice_id, i.k, total, seen, digests, i.pos, i.url, i.digest, i.bytes, seen[i.url] as b,
      case when 700 - total <= 0 then 'total_size_limit' when bytes is null then 'fetch_failed' when bytes > least(450, 700 - total) and 700 - total < 450 then 'total_size_limit' when bytes > 450 then 'too_large' when list_contains(digests, digest) then 'same' else 'included' end as fresh
    from f join i on i.notice_id = f.notice_id and i.k = f.k + 1))
select notice_id, pos::bigint as pos, outcome from f where outcome is not null""")
def image_budgets(spark, d):
    """Which of a page's images fit its budgets of bytes, in their order."""
    images = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 3).cast("string").alias("url"), (F.col("l_suppkey") % 4).cast("string").alias("digest"), F.when(F.col("l_returnflag") != "R", (F.col("l_quantity") * 10).cast("long")).alias("bytes"))
    return budgets.within_budget(images, most_image=450, most_total=700)


@_query("""select page_id, case when length(html) = 0 then 'empty' when page_id % 5 = 0 then 'unknown_type' when page_id % 5 = 4 then 'type_mismatch' end as error, case page_id % 5 when 1 then 'png' when 2 then 'pdf' when 3 then 'webp' when 4 then 'jpeg' end as kind from pages""")
def files_sniffed(spark, d):
    """What pages' bytes are, behind the first bytes of several kinds of files."""
    k = F.col("page_id") % 5
    head = F.when(k == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 2, F.encode(F.lit("%PDF-1.7"), "utf-8")).when(k == 3, F.concat(F.encode(F.lit("RIFF1234WEBP"), "utf-8"))).when(k == 4, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.encode(F.lit("<!"), "utf-8"))
    content = F.concat(head, F.encode("html", "utf-8"))
    named = F.when(k == 1, "PNG").when(k == 2, "pdf").when(k == 3, "webp").otherwise("gif")
    return _table(spark, d, "pages").select("page_id", budgets.file_error(content, F.when(k == 1, "image/png; q=1"), named).alias("error"), budgets.sniffed(content).alias("kind"))


@_query(f"""with c as (select o_orderkey as notice_id, l_linenumber as ordinal, 'w' || (l_partkey % 50) as word, l_partkey % 50 as w, l_suppkey % 4 = 3 as other from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 3 > 0),
s as (select notice_id, ordinal, word, case when other or w % 7 = 6 then 'unprocessed' when w % 7 < 3 then 'found' when w % 7 = 3 then 'not_found' when w % 7 = 4 then 'pending' else 'failed' end as state,
  case when other or w % 7 < 4 or w % 7 = 6 then 0 when w % 7 = 4 then 1 + w else least(3600, 100 * w) end as retry_after from c)
select notice_id, count(*) as n_candidates, case when count(*) filter (state = 'failed') > 0 then 'partial' when count(*) filter (state = 'pending') > 0 then 'pending' when count(*) filter (state = 'unprocessed') > 0 then 'unprocessed' else 'complete' end as status, max(retry_after)::bigint as retry_after from s group by notice_id""")
def dictionary_of_notices(spark, d):
    """The dictionary's state of each order's words, by a table function called from SQL."""
    lines = _table(spark, d, "orders").join(_table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).filter("o_orderkey % 3 > 0")
    links = lines.select(F.col("o_orderkey").alias("notice_id"), F.col("l_linenumber").cast("int").alias("ordinal"), F.concat(F.lit("w"), F.col("l_partkey") % 50).alias("query_word"), F.concat(F.lit("k"), F.col("l_partkey") % 50, F.when(F.col("l_suppkey") % 4 == 3, "-").otherwise("")).alias("cache_key"))
    w, never = F.col("p_partkey"), F.lit(None).cast("timestamp")
    later = lambda seconds: F.timestamp_add("SECOND", seconds.cast("int"), F.lit(NOW).cast("timestamp"))
    cache = _table(spark, d, "part").filter("p_partkey < 50").select(
        F.concat(F.lit("k"), w).alias("cache_key"), F.concat(F.lit("w"), w).alias("query_word"), F.when(w % 7 < 3, 2).when(w % 7 == 3, 0).alias("n_entries"), F.when(w % 7 == 4, later(1 + w)).otherwise(never).alias("lease_expires_at"),
        F.when(w % 7 == 5, later(100 * w)).otherwise(never).alias("retry_after_at"), F.when(w % 7 == 5, "dictionary_timeout").alias("last_error_code"),
    )
    registry.register_tables(links, cache, NOW)
    _table(spark, d, "orders").createOrReplaceTempView("dictionary_notices")
    return spark.sql("select n.o_orderkey as notice_id, e.n_candidates, e.status, e.retry_after from dictionary_notices n, lateral notice_dictionary(n.o_orderkey) e")


@_query(f"with {VIEW_SQL} select id, category, source_board, dong_group, post_sn, title, registered_on, sha256(body_text) as body from notices where is_visible and dong_group is distinct from 'other'", ("registered_on",))
def reader_notices(spark, d):
    """What a reader may see of notices: the rows and columns of their role."""
    seen = views.for_role(notices(spark, d), "reader")
    return seen.withColumn("body", F.sha2("body_text", 256)).drop("body_text")


@_query(f"with {VIEW_SQL} select id, source_board from view where id in (2, 3, 5, 7, 11, 13, 17)")
def notices_by_id(spark, d):
    return views.filtered(_view(spark, d), ids=[2, 3, 5, 7, 11, 13, 17]).select("id", "source_board")


@_query("""with recursive n as (select conv_id as notice_id, turn as pos, length(text) % 4 as a, length(text) % 3 as k, turn % 2 = 0 as told from conversations),
g as (select notice_id, a from n group by notice_id, a having bool_or(told) and bool_or(k = 0) and bool_or(k = 1)),
l as (select n.*, case when k < 2 and g.a is not null then min(case when k < 2 then pos end) over (partition by n.notice_id, n.a) else pos end as note_group from n left join g on g.notice_id = n.notice_id and g.a = n.a),
s as (select notice_id, note_group, count(*) as size, sum(count(*)) over (partition by notice_id) as total, row_number() over (partition by notice_id order by count(*) = 1, note_group) as i from l group by notice_id, note_group),
f as (select notice_id, 0::bigint as i, 5::bigint as room, null::bigint as note_group, false as kept from s where i = 1
  union all select s.notice_id, s.i, case when s.size <= room then room - s.size else room end, s.note_group, s.size <= room from f join s on s.notice_id = f.notice_id and s.i = f.i + 1)
select l.notice_id, pos, l.note_group, total <= 5 or f.kept as kept from l join s on s.notice_id = l.notice_id and s.note_group = l.note_group join f on f.notice_id = l.notice_id and f.note_group = l.note_group""")
def note_groups(spark, d):
    """A conversation's turns as notes on an action each; its even turns tell rules with exceptions."""
    turns, n = _table(spark, d, "conversations"), F.length("text")
    action = F.when(n % 4 == 0, "취소").when(n % 4 == 1, "환불").when(n % 4 == 2, "접수").otherwise("주차")
    said = F.when(n % 3 == 0, " 불가").when(n % 3 == 1, " 가능").otherwise(" 안내")
    all_notes = turns.select(F.col("conv_id").alias("notice_id"), F.col("turn").alias("pos"), F.concat(F.split("text", " ")[0], F.lit(" "), action, said).alias("note"))
    told = turns.filter("turn % 2 = 0").select(F.col("conv_id").alias("notice_id"), F.concat(F.split("text", " ")[0], F.lit("\n"), action, F.lit("는 불가합니다. 다만 사유가 있으면 가능")).alias("text"))
    return notes.chosen(notes.grouped(all_notes, told)).select("notice_id", "pos", "note_group", "kept")
