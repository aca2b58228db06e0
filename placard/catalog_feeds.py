"""Queries of sources that are read in pages and of streams, and the SQL that checks them.

The driver's tables stand for what an API or a queue gives: parts for listed
posts (newest first, by key), events for what happens to a job or a notice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placard.catalog import _query, _table
from placard.sources import paged
from placard.sources.shared import fresh_path
from placard.streaming import fence, leases

SIZE, OVERLAP = 50, 5


def _row_xml(title) -> F.col:
    fields = {"ID": F.col("p_partkey").cast("string"), "TITLE": title, "LINK": F.lit("https://a.test/"), "PUBDATE": F.lit("2026-01-01"), "DEPARTMENT": F.col("p_brand")}
    return F.concat(F.lit("<row>"), *[F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>")) for k, v in fields.items()], F.lit("</row>"))


def _page_xml(total, rows) -> F.col:
    return F.concat(F.lit("<ROOT><list_total_count>"), total.cast("string"), F.lit("</list_total_count><RESULT><CODE>INFO-000</CODE><MESSAGE>m</MESSAGE></RESULT>"), rows, F.lit("</ROOT>"))


def _listed(spark, d, boards: int) -> DataFrame:
    """Parts as posts of so many boards: board, total, pos (1 for the newest)."""
    part = _table(spark, d, "part").withColumn("board", F.col("p_partkey") % boards)
    sizes = part.groupBy("board").agg(F.count("*").alias("total"), F.max("p_partkey").alias("top"))
    return part.join(F.broadcast(sizes), "board").withColumn("pos", ((F.col("top") - F.col("p_partkey")) / boards + 1).cast("long"))


def _recorded(spark, d) -> str:
    """Responses of four boards: one with errors that pass, one with refusals, one that moves by a row while it is read, one whose posts change between two pages."""
    step = SIZE - OVERLAP
    rows = _listed(spark, d, 4).withColumn("k", F.explode(F.expr(f"sequence(greatest(0, floor((pos - {SIZE} - 1) / {step})), floor(pos / {step}))")))
    rows = rows.withColumn("shift", F.expr("if(board = 2 and k >= 3, 1, 0)")).withColumn("first", F.expr(f"1 + {step} * k")).withColumn("last", F.expr(f"if(k = 0, {SIZE}, least(first + {SIZE - 1}, total))"))
    rows = rows.filter(f"pos + shift between first and last and (k = 0 or first <= total - {OVERLAP})")
    title = F.when(F.expr("board = 3 and k > 0 and k % 3 = 0 and pos = first"), F.concat("p_name", F.lit(" again"))).otherwise(F.col("p_name"))
    pages = rows.groupBy("board", "k", "first", "last", (F.col("total") + F.col("shift")).alias("total")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _row_xml(title).alias("x")))), lambda r: r["x"]), "").alias("x"))
    status = F.expr("case when board = 1 and k % 5 = 2 then array(429) when board = 0 and k % 4 = 1 then array(503, 200) else array(200) end")
    again = rows.filter("k = 0 and pos = 1").select("board", F.lit(0).cast("long").alias("k"), F.lit(1).cast("long").alias("first"), F.lit(1).cast("long").alias("last"), F.expr("total + if(board = 2, 1, 0)").alias("total"), F.when(F.col("board") == 2, F.regexp_replace(_row_xml(F.col("p_name")), "<ID>", "<ID>new")).otherwise(_row_xml(F.col("p_name"))).alias("x"))
    served = pages.unionByName(again).select("board", F.lit(1).alias("poll"), "first", "last", F.posexplode(status).alias("attempt", "status"), _page_xml(F.col("total"), F.col("x")).alias("xml"))
    path = fresh_path(spark, "responses")
    paged.record(served.withColumn("attempt", F.col("attempt") + 1), path)
    return path


_PAGES_SQL = f"""with b as (select *, p_partkey % 4 as board from part), t as (select board, count(*) as total, max(p_partkey) as top from b group by board),
r as (select b.*, total, (top - p_partkey) // 4 + 1 as pos from b join t using (board)),
p as (select board, total, k, 1 + {SIZE - OVERLAP} * k as first, case when k = 0 then {SIZE} else least({SIZE - OVERLAP} * k + {SIZE}, total) end as last, board = 1 and k % 5 = 2 as failed, case when board = 2 and k >= 3 then 1 else 0 end as shift
  from t, range(0, 1000000) u(k) where k = 0 or 1 + {SIZE - OVERLAP} * k <= total - {OVERLAP}),
s as (select p.board, k, p_partkey, case when p.board = 3 and k > 0 and k % 3 = 0 and pos = first then p_name || ' again' else p_name end as title from p join r on r.board = p.board and pos + shift between first and last where not failed),"""


@_query(f"""{_PAGES_SQL}
i as (select board, p_partkey, count(*) as n, count(distinct title) as contents from s group by all),
n as (select board, count(*) as n_rows, count(*) filter (n > 1) as n_duplicates, count(*) filter (contents > 1) as n_conflicts from i group by board),
q as (select board, any_value(total) as total, count(*) as n_pages, count(*) filter (failed) as n_failed, count(*) filter (board = 0 and k % 4 = 1) as n_retried from p group by board)
select board::varchar as board, total, n_pages, n_failed, n_retried, n_rows, n_duplicates, n_conflicts, board = 2 as moved, board <> 2 and n_failed = 0 and n_conflicts = 0 and n_rows = total as complete from q join n using (board)""")
def paged_lists(spark, d):
    return paged.list_status(paged.parsed_pages(paged.read_pages(spark, _recorded(spark, d), size=SIZE, overlap=OVERLAP)))


@_query(f"""{_PAGES_SQL}
q as (select board, total from t) select board::varchar as board, k, p_partkey::varchar as post_sn, title, (row_number() over (partition by board, k order by p_partkey desc) - 1) as pos from s join q using (board)""")
def paged_rows(spark, d):
    """Each row of each page that was served whole."""
    parsed = paged.parsed_pages(paged.read_pages(spark, _recorded(spark, d), size=SIZE, overlap=OVERLAP)).filter("error is null and not confirms")
    return parsed.select("board", F.expr(f"(start - 1) div {SIZE - OVERLAP}").cast("long").alias("k"), F.posexplode("rows").alias("pos", "r")).select("board", "k", F.col("r.ID").alias("post_sn"), F.col("r.TITLE").alias("title"), F.col("pos").cast("long").alias("pos"))


@_query("select (p_partkey % 4)::varchar as board, case when p_partkey % 4 = 2 then 'new' else '' end || max(p_partkey) as post_sn, count(*) + case when p_partkey % 4 = 2 then 1 else 0 end as total from part group by p_partkey % 4")
def paged_first(spark, d):
    """The newest post of each board, by a request for one row."""
    parsed = paged.parsed_pages(paged.read_pages(spark, _recorded(spark, d), size=SIZE, start=1, end=1))
    return parsed.select("board", F.get("rows", F.lit(0))["ID"].alias("post_sn"), "total")


def _run(stream: DataFrame, spark, name: str) -> str:
    """Runs a stream over all that is there now; the folder of its rows."""
    path = fresh_path(spark, name)
    _drain(stream, path, f"{path}-progress")
    return path


def _drain(stream: DataFrame, path: str, progress: str) -> StreamingQuery:
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _polls(spark, d) -> str:
    """One board as two polls see it: first without its newest fifth; then whole, but three more posts come on top once its first page is read."""
    rows = _listed(spark, d, 1)
    old = rows.withColumn("new", F.expr("cast(total div 5 as bigint)"))
    first = old.filter("pos > new").select(F.lit(1).alias("poll"), (F.col("pos") - F.col("new")).alias("at"), (F.col("total") - F.col("new")).alias("total"), "p_partkey", "p_name", "p_brand")
    second = old.select(F.lit(2).alias("poll"), F.expr(f"if(pos <= {SIZE}, pos, pos + 3)").alias("at"), F.expr(f"if(pos <= {SIZE}, total, total + 3)").alias("total"), "p_partkey", "p_name", "p_brand")
    plain = first.unionByName(second.filter(f"at <= {SIZE}")).withColumn("first", F.expr(f"(at - 1) div {SIZE} * {SIZE} + 1")).withColumn("last", F.expr(f"if(first = 1, {SIZE}, least(first + {SIZE - 1}, total))"))
    # What the moved list serves at the places asked for first, and then at those further down.
    later = old.filter(f"pos > {SIZE} - 3").select(F.lit(2).alias("poll"), (F.col("pos") + 3).alias("at"), (F.col("total") + 3).alias("total"), "p_partkey", "p_name", "p_brand", F.col("total").alias("n"))
    asked = [later.withColumn("first", F.expr(f"(at - 1 - {s}) div {SIZE} * {SIZE} + 1 + {s}")).withColumn("last", F.expr(f"least(first + {SIZE - 1}, n + {s})")).filter(f"first > {SIZE} and at between first and last").drop("n") for s in (0, 3)]
    served = plain.unionByName(asked[0]).unionByName(asked[1])
    pages = served.groupBy("poll", "first", "last", "total").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", _row_xml(F.col("p_name")).alias("x")))), lambda r: r["x"]), "").alias("x"))
    path = fresh_path(spark, "responses")
    paged.record(pages.select(F.lit(0).alias("board"), "poll", "first", "last", F.lit(1).alias("attempt"), F.lit(200).alias("status"), _page_xml(F.col("total"), F.col("x")).alias("xml")), path)
    return path


@_query("""select '0' as board, case when p_partkey > m - (n // 5) then 2 else 1 end as poll, p_partkey::varchar as post_sn, p_name as title from part, (select max(p_partkey) as m, count(*) as n from part)""")
def paged_stream(spark, d):
    """Each post once, with the poll that found it, over two runs of a stream and a list that moves."""
    path, out = _polls(spark, d), fresh_path(spark, "posts")
    for poll in (1, 2):
        _drain(paged.new_rows(paged.parsed_pages(paged.stream_pages(spark, path, "0", size=SIZE, upto=poll))), out, f"{out}-progress")
    return spark.read.parquet(out).select("board", "poll", "post_sn", "title")


def _job_events(spark, d) -> DataFrame:
    """A user's events as a job's: sign-ups enqueue, views and purchases claim, clicks and errors finish the last claim before (every seventh another's)."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    claims = F.col("event_type").isin("view", "purchase")
    last = F.last(F.when(claims, F.col("event_id")), ignorenulls=True).over(before)
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(claims, "claim").otherwise("finish")
    token = F.when(claims, F.col("event_id")).when(kind == "finish", F.when(F.col("event_id") % 7 == 0, -1).otherwise(last))
    return _table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.when(kind == "enqueue", (F.col("event_id") % 2).cast("string")).alias("version"), token.cast("string").alias("token"), F.when(F.col("event_type") == "error", "model_error").alias("failed"),
    )


RULES = leases.Rules(lease_seconds=36_000, most_attempts=3, retry_seconds=7_200, most_wait=86_400)

#: A fold over each key's events, in SQL: what time does before an event, then the event; a last row of no kind lets time pass to the end.
_FOLD_SQL = f"""with recursive e as (
  select user_id as key, ts as t, event_id as seq, case when event_type = 'signup' then 'enqueue' when event_type in ('view', 'purchase') then 'claim' else 'finish' end as kind, event_id % 2 as version,
    case when event_type in ('view', 'purchase') then event_id when event_type <> 'signup' then case when event_id % 7 = 0 then -1
      else last_value(case when event_type in ('view', 'purchase') then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) end end as token,
    case when event_type = 'error' then 'model_error' end as failed from events
  union all select distinct user_id, timestamp '9999-01-01', 0, 'end', null, null, null from events),
o as (select *, row_number() over (partition by key order by t, seq) as i from e),
f as (
  select key, 0::bigint as i, null::timestamp as t, null::bigint as seq, null::timestamp as passed_at, null::varchar as passed, null::varchar as passed_reason, null::int as passed_attempts, null::varchar as said,
    'none' as state, 0 as attempts, null::bigint as version, null::bigint as token, null::timestamp as until, null::varchar as reason from o where i = 1
  union all
  select key, i, t, seq, case when gone then until end, case when gone then p_state end, case when gone then p_reason end, case when gone then attempts end,
    case when kind = 'end' then null when act = 'none' and kind = 'finish' then 'superseded' when act = 'none' then 'ignored' else n_state end,
    case when act = 'none' then p_state else n_state end, case act when 'enqueue' then 0 when 'run' then attempts + 1 else attempts end, case when act = 'enqueue' then n_version else version end,
    case act when 'run' then n_token when 'none' then p_token end,
    case when act = 'run' then t + to_seconds({RULES.lease_seconds}) when n_state = 'retry_wait' and act = 'finish' then t + to_seconds(least({RULES.most_wait}, {RULES.retry_seconds} * (1 << least(attempts - 1, 10)))) when act = 'none' then p_until end,
    case act when 'enqueue' then null when 'finish' then failed when 'stop' then coalesce(p_reason, 'processing_attempts_exhausted') else p_reason end
  from (select *, case when act = 'none' then p_state when act = 'enqueue' then 'pending' when act = 'run' then 'running' when act = 'stop' then 'exhausted' when failed is null then 'succeeded' when attempts >= {RULES.most_attempts} then 'exhausted' else 'retry_wait' end as n_state
    from (select *, case when kind = 'enqueue' and (p_state in ('none', 'succeeded') or version is distinct from n_version) then 'enqueue'
        when kind = 'claim' and p_state in ('pending', 'due') then case when attempts >= {RULES.most_attempts} then 'stop' else 'run' end
        when kind = 'finish' and p_state = 'running' and p_token is not distinct from n_token then 'finish' else 'none' end as act
      from (select f.key, o.i, o.t, o.seq, o.kind, o.version as n_version, o.token as n_token, o.failed, f.attempts, f.version, f.until, coalesce(f.until <= o.t, false) as gone,
          case when coalesce(f.until <= o.t, false) then case when f.state = 'running' and f.attempts >= {RULES.most_attempts} then 'exhausted' else 'due' end else f.state end as p_state,
          case when coalesce(f.until <= o.t, false) then null else f.token end as p_token, case when coalesce(f.until <= o.t, false) then null else f.until end as p_until,
          case when coalesce(f.until <= o.t, false) and f.state = 'running' then 'processing_lease_expired' else f.reason end as p_reason
        from f join o on o.key = f.key and o.i = f.i + 1))))
select key::varchar as key, strftime(t, '%Y-%m-%d %H:%M:%S.%f') as changed_at, seq, said as state, attempts, case when said not in ('ignored', 'superseded') then reason end as reason from f where said is not null
union all select key::varchar, strftime(passed_at, '%Y-%m-%d %H:%M:%S.%f'), -1, passed, passed_attempts, passed_reason from f where passed is not null"""


@_query(_FOLD_SQL)
def lease_transitions(spark, d):
    """What becomes of each job, from a stream of its events with a timer for each lease and wait."""
    leases.use_state_store(spark)
    path = fresh_path(spark, "job-events")
    leases.closing(_job_events(spark, d), days=10).write.parquet(path)
    stream = leases.transitions(spark.readStream.schema(leases.EVENT).parquet(path), RULES)
    return spark.read.schema(leases.TRANSITION).parquet(_run(stream, spark, "transitions")).select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("changed_at"), "seq", "state", "attempts", "reason")


def _movements(spark, d) -> tuple[DataFrame, DataFrame]:
    """Views register executions and clicks move the revision; other events are results of what was read six hours before. Every tenth result comes twice."""
    e = _table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "view", "execution").when(F.col("event_type") == "click", "revision")
    seen = Window.partitionBy("user_id").orderBy(F.unix_micros("at")).rangeBetween(Window.unboundedPreceding, -6 * 3600 * 1_000_000)
    known = e.withColumn("kind", kind)
    latest = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("event_id"))).over(seen), F.lit(0).cast("long"))
    results = known.select("kind", F.col("event_id").alias("result_id"), F.col("user_id").alias("notice_id"), latest("execution").alias("execution_token"), latest("revision").alias("source_revision"), F.expr("at - interval 6 hours").alias("read_at"), F.col("at").alias("result_at")).filter("kind is null").drop("kind")
    moved = known.filter("kind is not null").select(F.col("user_id").alias("notice_id"), "kind", F.col("event_id").alias("value"), F.col("at").alias("moved_at"))
    end = e.agg((F.max("at") + F.expr("interval 3 days")).alias("at"))
    nobody = F.lit(-1).cast("long")
    results = results.unionByName(results.filter("result_id % 10 = 0")).unionByName(end.select(*[nobody.alias(c) for c in ("result_id", "notice_id", "execution_token", "source_revision")], F.col("at").alias("read_at"), F.col("at").alias("result_at")))
    return results, moved.unionByName(end.select(nobody.alias("notice_id"), F.lit("execution").alias("kind"), nobody.alias("value"), F.col("at").alias("moved_at")))


@_query("""with k as (select *, case event_type when 'view' then 'execution' when 'click' then 'revision' end as kind from events),
s as (select *, coalesce(max(event_id) filter (kind = 'execution') over w, 0) as token, coalesce(max(event_id) filter (kind = 'revision') over w, 0) as revision from k
  window w as (partition by user_id order by ts range between unbounded preceding and interval 6 hours preceding))
select event_id as result_id, not exists (select 1 from k m where m.user_id = s.user_id and m.ts <= s.ts and m.ts > s.ts - interval 6 hours and (m.kind = 'execution' and m.event_id > s.token or m.kind = 'revision' and m.event_id <> s.revision)) as accepted
from s where kind is null""")
def results_fenced(spark, d):
    """Whether each result is accepted or superseded, by a stream-stream join."""
    streams = []
    for name, rows, schema in zip(("results", "movements"), _movements(spark, d), (fence.RESULT, fence.MOVEMENT), strict=True):
        path = fresh_path(spark, name)
        rows.write.parquet(path)
        streams.append(spark.readStream.schema(schema).parquet(path))
    return spark.read.schema(f"{fence.RESULT}, accepted boolean").parquet(_run(fence.fenced_join(*streams), spark, "fenced")).select("result_id", "accepted")
