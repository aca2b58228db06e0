"""The reference queries over the driver's tables, and the SQL that checks them.

documents stand for notices (source is the board, lang the category, labels
decide visibility and summaries), lineitem for the files of orders, events for
executions and jobs, conversations for rewrite sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.functions import identity, spans, text, urls
from placard.operators import collect, jobs, merge, review
from placard.plans import views

NOW = "2024-01-20 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("source_board"), F.col("doc_id").cast("string").alias("post_sn"),
        F.when(F.col("lang") == "de", "other").when(F.col("lang") != "en", "wolgye").alias("dong_group"), F.split("text", "\n")[0].alias("title"),
        F.expr("date_add(date'2024-01-01', cast(n_chars % 365 as int))").alias("registered_on"), (F.coalesce("toxic", F.lit(0)) == 0).alias("is_visible"), F.col("text").alias("body_text"), "quality", "n_chars",
    )


NOTICES_SQL = """notices as (select doc_id as id, lang as category, source as source_board, doc_id::varchar as post_sn,
  case when lang = 'de' then 'other' when lang <> 'en' then 'wolgye' end as dong_group, string_split(text, chr(10))[1] as title,
  (date '2024-01-01' + (n_chars % 365)::int)::date as registered_on, coalesce(toxic, 0) = 0 as is_visible, text as body_text, quality, n_chars
  from documents left join labels using (doc_id))"""


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "labels").select(
        F.col("doc_id").alias("notice_id"), F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "summarized").otherwise("needs_review").alias("status"),
        F.when(F.col("quality") == 1, F.col("doc_id") % 7).alias("category_code"), F.expr("date_add(date'2024-06-01', cast(doc_id % 200 as int))").alias("deadline_on"),
    )


VIEW_SQL = f"""{NOTICES_SQL}, summaries as (select doc_id as notice_id, case when toxic = 1 then 'failed' when quality = 1 then 'summarized' else 'needs_review' end as status,
  case when quality = 1 then doc_id % 7 end as category_code, (date '2024-06-01' + (doc_id % 200)::int)::date as deadline_on from labels),
view as (select id, source_board, title, registered_on, coalesce(status, 'none') as display_status, category_code,
  case when status = 'summarized' then deadline_on end as deadline_on from notices left join summaries on id = notice_id
  where is_visible and dong_group is distinct from 'other')"""


def _view(spark: SparkSession, d: str) -> DataFrame:
    return views.list_view(notices(spark, d), summaries(spark, d))


QUERIES, ORACLE_SQL = {}, {}
DAYS = ("registered_on", "deadline_on", "category_code")


def _query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Registers a query under its name; ``days`` are columns (dates, and numbers that may be null) that the result gives as text."""

    def add(function):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return function(spark, d).withColumns({c: F.col(c).cast("string") for c in days})

        QUERIES[function.__name__] = run if days else function
        if sql is not None:
            ORACLE_SQL[function.__name__] = f"select * replace ({', '.join(f'{c}::varchar as {c}' for c in days)}) from ({sql})" if days else sql
        return function

    return add


@_query(f"with {VIEW_SQL} select * from view where registered_on < date '2024-09-01' or (registered_on = date '2024-09-01' and id < 500) order by registered_on desc, id desc limit 20", DAYS)
def notice_list_page(spark, d):
    return views.keyset_page(_view(spark, d), ("2024-09-01", 500))


@_query(f"with {VIEW_SQL} select * from view where registered_on > date '2024-02-01' or (registered_on = date '2024-02-01' and id > 10) order by registered_on, id limit 20", DAYS)
def notice_list_oldest(spark, d):
    return views.keyset_page(_view(spark, d), ("2024-02-01", 10), newest_first=False)


@_query(f"with {VIEW_SQL} select * from view where category_code = 3 and source_board in ('src1', 'src2', 'src3')", DAYS)
def category_filter(spark, d):
    return views.filtered(_view(spark, d), "src1", 3).unionByName(views.filtered(_view(spark, d), "src2", 3)).unionByName(views.filtered(_view(spark, d), "src3", 3))


@_query(f"with {VIEW_SQL} select * from view where category_code is null", DAYS)
def unclassified(spark, d):
    return views.filtered(_view(spark, d), code=None)


@_query(f"with {VIEW_SQL} select display_status, count(*) as n, count(deadline_on) as n_deadlines from view group by display_status")
def display_status(spark, d):
    return _view(spark, d).groupBy("display_status").agg(F.count("*").alias("n"), F.count("deadline_on").alias("n_deadlines"))


@_query("select o_orderkey, o_orderdate, o_orderstatus from orders order by o_orderdate desc, o_orderkey desc limit 1")
def latest_notice(spark, d):
    orders = _table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return views.keyset_page(orders, size=1, day="o_orderdate", key="o_orderkey")


@_query(f"with {VIEW_SQL} select *, case id when 42 then 1 when 7 then 2 when 199 then 3 when 3 then 4 when 100 then 5 end::bigint as position from view where id in (42, 7, 199, 3, 100)", DAYS)
def saved_notices(spark, d):
    return views.saved(_view(spark, d), [42, 7, 199, 7, 3, 100])


@_query(f"""with {VIEW_SQL}, h as (select view.*, case when display_status = 'summarized' then string_split(body_text, chr(10))[2] end as headline from view join notices using (id))
select * from h where contains(lower(title), 'there') or contains(lower(coalesce(headline, '')), 'there')""", DAYS)
def title_search(spark, d):
    """The keyword in the title or in the headline, for which a text's second line stands where the summary is done."""
    second = notices(spark, d).select("id", F.get(F.split("body_text", "\n"), F.lit(1)).alias("headline"))
    shown = _view(spark, d).join(second, "id").withColumn("headline", F.when(F.col("display_status") == "summarized", F.col("headline")))
    return views.search(shown, "  THERE ", "title", "headline")


@_query(f"with {VIEW_SQL} select id, deadline_on, coalesce(deadline_on < date '2024-09-15', false) as expired from view", ("deadline_on",))
def expired_notices(spark, d):
    return _view(spark, d).select("id", "deadline_on", views.expired(F.col("deadline_on"), F.lit("2024-09-15").cast("date")).alias("expired"))


@_query("""select o_orderkey, count(l_orderkey) as n_files, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' order by l_linenumber, l_partkey, l_suppkey), '') as files
from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def notice_detail_files(spark, d):
    lines = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("f"))
    joined = _table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    files = F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), ",")
    return joined.select("o_orderkey", F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("n_files"), F.coalesce(files, F.lit("")).alias("files"))


@_query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def visible_semi(spark, d):
    orders = _table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return _table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@_query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def hidden_anti(spark, d):
    large = _table(spark, d, "orders").filter("o_totalprice > 300000")
    return _table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def _stored(df: DataFrame) -> DataFrame:
    """A snapshot's columns; the body is known by its hash here."""
    none = F.lit(None).cast("string")
    return df.select("category", "source_board", "post_sn", "dong_group", "title", none.alias("department"), "registered_on", F.concat(F.lit("https://board.test/"), "post_sn").alias("url"), F.sha2("body_text", 256).alias("body_html"), none.alias("license_type"), (F.col("n_chars") % 2 == 0).alias("is_pinned"), "body_text")


def _merged(spark, d):
    base = notices(spark, d)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    target = _stored(base.filter("n_chars < 4000")).withColumns({"is_modified": F.lit(False), "is_visible": F.lit(False), "content_revision": F.lit(1).cast("long"), "content_updated_at": at, "updated_at": at})
    # Pins and the body as text aren't content: they change without a new revision.
    batch = _stored(base.filter("n_chars > 1000")).withColumn("is_pinned", ~F.col("is_pinned")).withColumn("body_text", F.concat("body_text", F.lit("\n"))).withColumn("title", F.when(F.length("title") > 60, F.concat("title", F.lit(" (edited)"))).otherwise(F.col("title")))
    return merge.upsert_notices(target, batch, F.lit(NOW).cast("timestamp"))


@_query(f"""with {NOTICES_SQL}, k as (select *, n_chars > 1000 as b, n_chars < 4000 as t, length(title) > 60 as edited from notices)
select category, source_board, post_sn, case when b and edited then title || ' (edited)' else title end as title, b and t and edited as is_modified, b as is_visible, (n_chars % 2 = 0) <> b as is_pinned, sha256(body_text || case when b then chr(10) else '' end) as body,
  (case when t and not (b and edited) then 1 when t then 2 else 1 end)::bigint as content_revision from k where b or t""")
def upsert_changed_rows(spark, d):
    return _merged(spark, d).select("category", "source_board", "post_sn", "title", "is_modified", "is_visible", "content_revision", "is_pinned", F.sha2("body_text", 256).alias("body"))


@_query(f"with {NOTICES_SQL} select category, source_board, post_sn, title from notices")
def insert_if_absent(spark, d):
    rows = notices(spark, d).select("category", "source_board", "post_sn", "title", "n_chars")
    batch = rows.filter("n_chars >= 500").withColumn("title", F.when(F.col("n_chars") < 2000, "second copy").otherwise(F.col("title")))
    return merge.insert_if_absent(rows.filter("n_chars < 2000"), batch).drop("n_chars")


@_query("""with o as (select distinct l_orderkey, l_partkey from lineitem where l_returnflag <> 'N'), n as (select distinct l_orderkey, l_partkey from lineitem where l_linestatus = 'O'),
e as (select coalesce(o.l_orderkey, n.l_orderkey) as l_orderkey, o.l_partkey is not null as io, n.l_partkey is not null as isn from o full join n on o.l_orderkey = n.l_orderkey and o.l_partkey = n.l_partkey),
g as (select l_orderkey, sum(io::int) as a, sum(isn::int) as b, bool_or(io <> isn) as changed from e group by l_orderkey having sum(isn::int) > 0)
select l_orderkey, case when changed then a else 0 end::bigint as n_deleted, case when changed then b else 0 end::bigint as n_inserted, changed from g""")
def file_set_diff(spark, d):
    lines = _table(spark, d, "lineitem")
    return merge.child_set_diff(lines.filter("l_returnflag <> 'N'"), lines.filter("l_linestatus = 'O'"), "l_orderkey", ("l_partkey",))


@_query("""with x as (select user_id, max(event_id) as latest from events where event_type in ('click', 'view') group by user_id),
c as (select user_id, count(*) % 3 as revision from events group by user_id)
select e.user_id as notice_id, event_id as execution_token, coalesce(event_id = latest and event_id % 3 = revision, false) as accepted
from events e left join x using (user_id) left join c using (user_id) where event_type = 'click'""")
def fenced_write(spark, d):
    events = _table(spark, d, "events").withColumn("notice_id", F.col("user_id"))
    runs = events.filter(F.col("event_type").isin("click", "view")).select("notice_id", F.col("event_id").alias("execution_token"))
    current = events.groupBy("notice_id").agg((F.count("*") % 3).alias("content_revision"))
    batch = events.filter("event_type = 'click'").select("notice_id", F.col("event_id").alias("execution_token"), (F.col("event_id") % 3).alias("source_revision"))
    good, late = merge.fenced(batch, runs, current)
    return good.withColumn("accepted", F.lit(True)).unionByName(late.withColumn("accepted", F.lit(False))).select("notice_id", "execution_token", "accepted")


def _jobs(spark, d) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "retry_wait").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "blocked").when(F.col("event_type") == "signup", "pending").otherwise("succeeded")
    last = _table(spark, d, "events").groupBy(F.col("user_id").alias("notice_id"), F.when(F.col("value") < 20, "summary").otherwise("easy_text").alias("feature")).agg(F.max_by(F.struct("event_type", "ts", "event_id"), "event_id").alias("e"), F.count_if(F.col("event_type") == "error").alias("attempts"))
    at = F.col("ts")
    return last.select("notice_id", "feature", "e.*", "attempts").select(
        "notice_id", "feature", F.col("event_type"), state.alias("state"), "attempts", F.when(state == "retry_wait", at).alias("next_attempt_at"), F.when(state == "running", at).alias("lease_expires_at"),
        at.alias("updated_at"), F.concat(F.lit("r"), F.col("event_id") % 2).alias("input_version"), F.lit("v1").alias("contract_key"),
    )


JOBS_SQL = """last as (select user_id as notice_id, case when value < 20 then 'summary' else 'easy_text' end as feature, arg_max(event_type, event_id) as event_type, arg_max(ts, event_id) as ts, max(event_id) as event_id, count(*) filter (where event_type = 'error') as attempts from events group by all),
jobs as (select *, case event_type when 'error' then 'retry_wait' when 'click' then 'running' when 'view' then 'blocked' when 'signup' then 'pending' else 'succeeded' end as state, 'r' || (event_id % 2) as version from last)"""


@_query(f"""with {JOBS_SQL}, inputs as (select distinct user_id as notice_id, f as feature, user_id % 2 as r from events, (values ('summary'), ('easy_text'), ('archive')) v(f))
select notice_id, feature, 'r1' as input_version, state from inputs left join jobs using (notice_id, feature)
where state is null or version <> 'r1' or state in ('pending', 'succeeded') or (state in ('retry_wait', 'running') and ts <= timestamp '{NOW}')
order by case when state = 'retry_wait' then ts else ts end nulls first, notice_id, feature limit 100""")
def job_candidates(spark, d):
    people = _table(spark, d, "events").select(F.col("user_id").alias("notice_id")).distinct()
    inputs = people.withColumn("feature", F.explode(F.array(*map(F.lit, ("summary", "easy_text", "archive"))))).withColumns({"input_version": F.lit("r1"), "contract_key": F.lit("v1"), "ready": F.lit(None).cast("boolean")})
    return jobs.candidates(inputs, _jobs(spark, d), F.lit(NOW).cast("timestamp"), 100).drop("contract_key")


@_query(f"""with {JOBS_SQL}, s as (select unnest(['pending', 'running', 'succeeded', 'skipped', 'blocked', 'retry_wait', 'exhausted']) as state)
select s.state, count(jobs.state) as n from s left join jobs on jobs.state = s.state group by s.state""")
def readiness_counts(spark, d):
    return jobs.state_counts(_jobs(spark, d))


@_query("""select user_id, count(*) as attempts, least(3600, 30 * 2 ** least(count(*) - 1, 10))::bigint as wait_seconds from events where event_type = 'error' group by user_id""")
def retry_backoff(spark, d):
    failed = _table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return failed.withColumn("wait_seconds", jobs.retry_seconds(F.col("attempts")))


@_query(f"""with k as (select event_type, user_id, min(ts) < timestamp '2024-01-02' as known, min(event_id) as pos from events group by event_type, user_id),
r as (select *, row_number() over (partition by event_type order by pos desc) as rank from k),
w as (select *, max(case when rank <= 10 then known::int end) over (partition by event_type) as head, max(case when rank > 10 then known::int end) over (partition by event_type order by rank) as tail from r)
select event_type, user_id, rank::bigint as rank from w where (rank <= 10 and not known) or (rank > 10 and coalesce(head, 0) = 0 and tail = 0)""")
def boundary_scan(spark, d):
    seen = _table(spark, d, "events").groupBy("event_type", "user_id").agg((F.min("ts") < F.lit("2024-01-02").cast("timestamp")).alias("known"), F.min("event_id").alias("pos"))
    ranked = collect.list_ranks(seen, ("event_type",), "pos")
    return collect.boundary_scan(ranked, 10, by=("event_type",)).select("event_type", "user_id", "rank")


@_query("""with p as (select source as post_sn, 1 as page, doc_id as pos, lang from documents where n_chars < 900 union all select source, 2, doc_id, lang from documents where n_chars > 700)
select post_sn, arg_min(lang, (page, pos)) as lang, count(*) as n_seen, count(distinct lang) > 1 as conflict from p group by post_sn""")
def page_dedup_conflict(spark, d):
    docs = _table(spark, d, "documents")
    page = lambda n, cut: docs.filter(cut).select(F.col("source").alias("post_sn"), F.lit(n).alias("page"), F.col("doc_id").alias("pos"), "lang")
    return collect.first_occurrences(page(1, "n_chars < 900").unionByName(page(2, "n_chars > 700")), "post_sn", ("page", "pos")).select("post_sn", "lang", "n_seen", "conflict")


@_query("""with o as (select l_orderkey, l_returnflag, count(*) as old_rows, count(case when l_discount > 0 then 1 end) as a from lineitem group by all),
n as (select l_orderkey, l_returnflag, count(*) as new_rows, count(case when l_discount > 0 then 1 end) as b from lineitem where l_quantity > 10 group by all)
select l_orderkey, l_returnflag, old_rows, coalesce(new_rows, 0) as new_rows from o left join n using (l_orderkey, l_returnflag) where coalesce(new_rows, 0) < old_rows or coalesce(b, 0) < a""")
def date_coverage_loss(spark, d):
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", F.when(F.col("l_discount") > 0, F.col("l_shipdate")).alias("start_date"))
    return merge.lost_dates(lines, lines.filter("l_quantity > 10"), "l_orderkey", "l_returnflag", ("start_date",))


@_query("select l_orderkey, max(case when l_returnflag in ('A', 'R') then l_shipdate end) as deadline from lineitem group by l_orderkey")
def deadline_max(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "application").when(F.col("l_returnflag") == "R", "payment").otherwise("event")
    dates = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("kind"), F.col("l_shipdate").alias("end_date"))).alias("dates"))
    return dates.select("l_orderkey", review.deadline(F.col("dates")).alias("deadline"))


@_query("""with r as (select conv_id, role, max(turn) as last from conversations group by all)
select c.conv_id, coalesce(string_agg(role, ',' order by role) filter (where last < 4), '') as lost from (select distinct conv_id from conversations) c left join r using (conv_id) group by c.conv_id""")
def information_loss_arrays(spark, d):
    roles = _table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("old"), F.collect_set(F.when(F.col("turn") >= 4, F.col("role"))).alias("new"))
    return roles.select("conv_id", F.array_join(merge.lost_fields(F.col("old"), F.col("new"), F.array().cast("array<string>")), ",").alias("lost"))


@_query("""select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:,[0-9]{3})*'), lambda x: replace(x, ',', '')::hugeint))), ' ') as numbers from documents""")
def numbers_subset(spark, d):
    found = text.number_tokens(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", F.array_join(F.transform(found, lambda x: x.cast("string")), " ").alias("numbers"))


@_query(r"""select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)(?:https?://|www\.)[^\s<>()\[\]{}]+'), lambda x: regexp_replace(x, '[.,;!?]+$', '')))), ' ') as links from documents""")
def links_subset(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.array_join(text.link_tokens(F.col("text")), " ").alias("links"))


@_query("""with q as (select conv_id, min(text) as quote, string_agg(text, chr(10) order by turn, role, text) as body from conversations group by conv_id)
select conv_id, case when strpos(body, quote) = 0 then 'not_found' when strpos(substr(body, strpos(body, quote) + 1), quote) > 0 or quote = '' then 'ambiguous' else 'matched' end as status,
case when quote <> '' and strpos(body, quote) > 0 and strpos(substr(body, strpos(body, quote) + 1), quote) = 0 then strpos(body, quote) - 1 end::bigint as place from q""")
def evidence_location(spark, d):
    turns = _table(spark, d, "conversations").groupBy("conv_id").agg(F.min("text").alias("quote"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    quoted = turns.select("conv_id", "quote", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("body"))
    return quoted.select("conv_id", spans.match_status(F.col("body"), F.col("quote")).alias("status"), spans.unique_place(F.col("body"), F.col("quote")).alias("place"))


@_query("select page_id, 'url:' || sha256(url) as file_key from pages")
def sha256_file_key(spark, d):
    return _table(spark, d, "pages").select("page_id", identity.file_key(F.lit(None).cast("string"), F.col("url")).alias("file_key"))


@_query(r"""with u as (select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path,
array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') as query from pages)
select page_id, host, 'https://' || host || path || case when query = '' then '' else '?' || query end as canonical from u""")
def url_normalise_host(spark, d):
    return _table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.canonical(F.col("url")).alias("canonical"))


@_query("""select doc_id, case when length(text) >= 12 then substr(text, 1, 3) || '[one]' || substr(text, 6, 4) || substr(text, 12) else text end as changed from documents""")
def change_application(spark, d):
    change = lambda a, b, r: F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(r).alias("replacement"))
    changes = F.when(F.length("text") >= 12, F.array(change(3, 5, "[one]"), change(9, 11, ""))).otherwise(F.array().cast("array<struct<start:long,end:long,replacement:string>>"))
    return _table(spark, d, "documents").select("doc_id", spans.apply_changes(F.col("text"), changes).alias("changed"))


@_query("""with cache as (select lang as word, source as conditions, count(*) filter (where quality = 1) as n, min(doc_id) as k from documents join labels using (doc_id) group by all),
c as (select user_id, case user_id % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' else 'xx' end as word, 'src' || (event_id % 25) as conditions from events),
j as (select user_id, case when n > 0 then 'found' when n = 0 then 'not_found' else 'unprocessed' end as state from c left join cache using (word, conditions))
select user_id, count(*) filter (where state in ('found', 'not_found')) as resolved, count(*) as n,
case when count(*) filter (where state in ('found', 'not_found')) = count(*) then 'complete' when count(*) filter (where state in ('found', 'not_found')) > 0 then 'partial' else 'unprocessed' end as status from j group by user_id""")
def dictionary_resolution(spark, d):
    never = F.lit(None).cast("timestamp")
    cache = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id").groupBy(F.col("lang").alias("word"), F.col("source").alias("conditions")).agg(F.count_if(F.col("quality") == 1).alias("n_entries"))
    cache = cache.withColumns({"lease_expires_at": never, "retry_after_at": never})
    word = F.when(F.col("user_id") % 4 == 0, "en").when(F.col("user_id") % 4 == 1, "de").when(F.col("user_id") % 4 == 2, "fr").otherwise("xx")
    asked = _table(spark, d, "events").select("user_id", word.alias("word"), F.concat(F.lit("src"), F.col("event_id") % 25).alias("conditions"))
    resolved = jobs.cache_status(asked, cache, ["word", "conditions"], F.lit(NOW).cast("timestamp"))
    grouped = resolved.groupBy("user_id").agg(F.collect_list("cache_state").alias("states"))
    return grouped.select("user_id", F.size(F.filter("states", lambda s: s.isin("found", "not_found"))).cast("long").alias("resolved"), F.size("states").cast("long").alias("n"), jobs.fold_status(F.col("states")).alias("status"))


@_query("""select conv_id, 'Conversation ' || conv_id || chr(10) || chr(10) || string_agg('Turn ' || turn || chr(10) || case when role = 'assistant' then '1. ' || text else text end, chr(10) || chr(10) order by turn, role, text) as flat from conversations group by conv_id""")
def flatten_sections(spark, d):
    section = F.struct("turn", "role", F.col("text").alias("t"), F.concat(F.lit("Turn "), "turn").alias("heading"), F.when(F.col("role") == "assistant", "steps").otherwise("paragraph").alias("style"), F.array("text").alias("sentences"))
    grouped = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    return grouped.select("conv_id", spans.flatten_sections(F.concat(F.lit("Conversation "), "conv_id"), F.array().cast("array<string>"), F.col("sections")).alias("flat"))


@_query("select doc_id as notice_id, 'summary' as feature, n_chars as size from documents union all select doc_id, 'easy_text', n_chars from documents where lang = 'en'")
def union_all_features(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("notice_id"), F.col("n_chars").alias("size"), "lang")
    return docs.withColumn("feature", F.lit("summary")).unionByName(docs.filter("lang = 'en'").withColumn("feature", F.lit("easy_text"))).select("notice_id", "feature", "size")


@_query("select event_type, count(*) as n, count(distinct user_id) as users, count(*) filter (where value > 20) as large from events group by event_type")
def report_counters(spark, d):
    return _table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 20).alias("large"))


@_query(f"with {VIEW_SQL} select (select count(*) from notices) as private_rows, (select count(*) from view) as public_rows, (select count(*) from notices) - (select count(*) from view) as hidden_rows")
def before_after_counts(spark, d):
    both = notices(spark, d).agg(F.count("*").alias("private_rows")).crossJoin(_view(spark, d).agg(F.count("*").alias("public_rows")))
    return both.withColumn("hidden_rows", F.col("private_rows") - F.col("public_rows"))


@_query("select event_id, (ts + interval 9 hour)::date as kst_day from events", ("kst_day",))
def kst_days(spark, d):
    return _table(spark, d, "events").select("event_id", text.kst_date(F.col("ts")).alias("kst_day"))


@_query("select doc_id, length(text) as code_points, (length(text) + length(regexp_replace(text, '[\\x00-\\x{FFFF}]', '', 'g')))::bigint as utf16_units from documents")
def utf16_offsets(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("code_points"), text.utf16_length(F.col("text")).alias("utf16_units"))


@_query("""select page_id, case when regexp_matches(url, '^https?://[^/?#@:]+(?:[/?][^#]*)?$') then true else false end as plain from pages""")
def url_allowlist(spark, d):
    return _table(spark, d, "pages").select("page_id", F.col("url").rlike(r"^https?://[^/?#@:]+(?:[/?][^#]*)?$").alias("plain"))
