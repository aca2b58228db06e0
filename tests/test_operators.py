import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from placard.operators import collect, jobs, merge, review
from placard.sources import api_xml, html_files, replay
from placard.streaming.incremental import SnapshotTable, collect_stream

KEYED = "category string, source_board string, post_sn string, dong_group string, title string, department string, registered_on date, url string, body_html string, license_type string"
STORED = KEYED + ", is_modified boolean, is_visible boolean, content_revision long, content_updated_at timestamp, updated_at timestamp"
T0, T1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)


def notice(sn, title="t", board="b", department=None):
    return ("c", board, sn, None, title, department, dt.date(2026, 1, 1), "u", None, None)


def stored(sn, title="t", board="b", visible=True):
    return (*notice(sn, title, board), False, visible, 1, T0, T0)


def test_upsert_detects_changes_and_is_idempotent(spark):
    target = spark.createDataFrame([stored("1"), stored("2"), stored("3", visible=False), stored("1", board="other")], STORED)
    batch = spark.createDataFrame([notice("1"), notice("2", "new"), notice("3"), notice("4")], KEYED)
    once = merge.upsert_notices(target, batch, F.lit(T1))
    got = {(r.source_board, r.post_sn): (r.title, r.is_modified, r.is_visible, r.content_revision, r.content_updated_at == T1, r.updated_at == T1) for r in once.collect()}
    assert got == {
        ("b", "1"): ("t", False, True, 1, False, True), ("b", "2"): ("new", True, True, 2, True, True), ("b", "3"): ("t", False, True, 1, False, True),
        ("b", "4"): ("t", False, True, 1, True, True), ("other", "1"): ("t", False, True, 1, False, False),
    }
    again = merge.upsert_notices(once, batch, F.lit(T1))
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    other = spark.createDataFrame([notice("9")], KEYED)
    ab = merge.upsert_notices(merge.upsert_notices(target, batch, F.lit(T1)), other, F.lit(T1))
    ba = merge.upsert_notices(merge.upsert_notices(target, other, F.lit(T1)), batch, F.lit(T1))
    assert sorted(map(str, ab.collect())) == sorted(map(str, ba.collect()))


def test_batch_conflicts(spark):
    batch = spark.createDataFrame([notice("1"), notice("1"), notice("2"), notice("2", "x"), notice("3")], KEYED)
    assert {(r.post_sn, r.n_different) for r in merge.batch_conflicts(batch).collect()} == {("1", 1), ("2", 2)}


def test_file_sets_count_events(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "x")], "n long, k string")
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (4, "p"), (4, "q"), (4, "r")], "n long, k string")
    got = {r.n: (r.n_deleted, r.n_inserted, r.changed) for r in merge.child_set_diff(old, new, "n", ("k",)).collect()}
    assert got == {1: (0, 0, False), 2: (1, 1, True), 4: (0, 3, True)}
    changed = merge.child_set_diff(old, new, "n", ("k",)).filter("changed").select("n")
    assert sorted(map(tuple, merge.replace_children(old, new, changed, "n").collect())) == [(1, "a"), (1, "b"), (2, "c"), (3, "x"), (4, "p"), (4, "q"), (4, "r")]


def test_fencing(spark):
    runs = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "notice_id long, execution_token long")
    now = spark.createDataFrame([(1, 3), (2, 9)], "notice_id long, content_revision long")
    batch = spark.createDataFrame([(1, 5, 3), (1, 6, 3), (2, 7, 8), (3, 1, 1)], "notice_id long, execution_token long, source_revision long")
    good, late = merge.fenced(batch, runs, now)
    assert [tuple(r) for r in good.collect()] == [(1, 6, 3)] and late.count() == 3


def test_summary_merges(spark):
    schema = "notice_id long, status string, result string, source_hash string, attempt_count int, last_error_code string"
    now = spark.createDataFrame([(i, "summarized", "old", "h", 1, None, T0) for i in (1, 2, 3, 4)], schema + ", updated_at timestamp")
    batch = [(1, "summarized", "less", "h", 1, None, "result", True), (2, "summarized", "new", "h2", 1, None, "result", True), (3, None, None, "h", 1, "timeout", "failure", False), (4, None, None, "h9", 1, "timeout", "failure", False), (5, None, None, "h", 1, None, "pending", False)]
    out = merge.save_summaries(now, spark.createDataFrame(batch, schema + ", outcome string, loses boolean"), F.lit(T1))
    got = {r.notice_id: (r.status, r.result, r.attempt_count, r.last_error_code) for r in out.collect()}
    assert got == {1: ("summarized", "old", 2, "summary_information_loss"), 2: ("summarized", "new", 2, None), 3: ("summarized", "old", 2, "timeout"), 4: ("failed", None, 2, "timeout"), 5: ("pending", None, 1, None)}


def loop_scan(known, first, mode, baseline, refresh_stops):
    out = [i for i, k in enumerate(known[:first]) if baseline or mode == "refresh" or not k]
    if baseline or (mode == "refresh" and refresh_stops) or any(known[:first]):
        return out
    for i in range(first, len(known)):
        if known[i]:
            break
        out.append(i)
    return out


@pytest.mark.parametrize("mode", ["new", "refresh"])
@pytest.mark.parametrize(("baseline", "refresh_stops"), [(False, True), (True, True), (False, False)])
def test_boundary_scan_equals_the_loop(spark, mode, baseline, refresh_stops):
    rng = random.Random(f"{mode}{baseline}{refresh_stops}")
    lists = [[rng.random() < 0.1 for _ in range(rng.randint(0, 25))] for _ in range(60)]
    rows = spark.createDataFrame([(n, i + 1, k) for n, known in enumerate(lists) for i, k in enumerate(known)], "n int, rank long, known boolean")
    got = sorted((r.n, r.rank - 1) for r in collect.boundary_scan(rows, 5, mode, baseline, ("n",), refresh_stops).collect())
    assert got == [(n, i) for n, known in enumerate(lists) for i in loop_scan(known, 5, mode, baseline, refresh_stops)]


def test_pages_first_occurrence_and_proof(spark):
    rows = spark.createDataFrame([("a", 1, 0, "x"), ("b", 1, 1, "x"), ("b", 2, 0, "y"), ("c", 2, 1, "z"), ("c", 3, 0, "z")], "post_sn string, page int, pos int, title string")
    got = {r.post_sn: (r.title, r.n_seen, r.conflict) for r in collect.first_occurrences(rows, "post_sn", ("page", "pos")).collect()}
    assert got == {"a": ("x", 1, False), "b": ("x", 2, True), "c": ("z", 2, False)}
    done = collect.completeness(rows, F.lit(3)).first()
    assert (done.listed, done.distinct, done.conflicts, done.complete) == (5, 3, 1, False)
    pages = spark.createDataFrame([(1, 25, 10, 3, 10), (3, 25, 10, 3, 5), (2, 25, 10, 3, 9), (1, 25, 10, 4, 10)], "page int, total_count int, page_size int, total_pages int, n_regular int")
    assert [r.valid for r in collect.page_proof(pages).collect()] == [True, True, False, False]
    board = spark.createDataFrame([("1", True, "t", "d", "2026-01-01"), ("1", False, "t", "d", "2026-01-01"), ("2", False, "t", "d", "2026-01-01"), ("2", False, "u", "d", "2026-01-01")], "post_sn string, is_pinned boolean, title string, department string, registered_on string")
    assert {r.post_sn: (r.is_pinned, r.conflict) for r in collect.pinned_or_regular(board).collect()} == {"1": (True, False), "2": (False, True)}
    good, bad = collect.in_range(spark.createDataFrame([("2026-01-05",), ("2026-02-30",), ("2025-12-31",), ("26-1-1",)], "d string"), "d", "2026-01-01", "2026-01-31")
    assert [r.d for r in good.collect()] == ["2026-01-05"] and sorted(r.d for r in bad.collect()) == ["2026-02-30", "26-1-1"]
    tries = spark.createDataFrame([("r", 1, 200), ("r", 2, 429), ("r", 3, 200)], "run string, attempt int, status int")
    assert [r.outcome for r in collect.until_rate_limited(tries).orderBy("attempt").collect()] == ["saved", "rate_limited", "rate_limited_not_attempted"]


def test_queue(spark):
    now, past, soon = T1, T0, dt.datetime(2026, 1, 3)
    inputs = spark.createDataFrame([(i, "summary", "r1", "k", ready) for i, ready in enumerate([None, False, True, False, False, False, False, False])], "notice_id long, feature string, input_version string, contract_key string, ready boolean")
    held = [(1, "retry_wait", past, None, "r1"), (3, "retry_wait", soon, None, "r1"), (4, "running", None, past, "r1"), (5, "blocked", None, None, "r1"), (6, "blocked", None, None, "r0"), (7, "exhausted", None, None, "r1")]
    queue = spark.createDataFrame([(i, "summary", v, "k", s, 2, n, e, lease, T0) for i, s, n, lease, v in held for e in [None]], "notice_id long, feature string, input_version string, contract_key string, state string, attempts int, next_attempt_at timestamp, last_error_code string, lease_expires_at timestamp, updated_at timestamp")
    chosen = jobs.candidates(inputs, queue, F.lit(now))
    assert [r.notice_id for r in chosen.collect()] == [0, 1, 4, 6]
    after = {r.notice_id: (r.state, r.attempts) for r in jobs.enqueue(queue, chosen, F.lit(now)).collect()}
    assert after[0] == ("pending", 0) and after[6] == ("pending", 0) and after[1] == ("retry_wait", 2) and after[5] == ("blocked", 2)
    claimed = {r.notice_id: (r.state, r.attempts) for r in jobs.claim(queue, F.lit(now), 240, 3).collect()}
    assert claimed[1] == ("running", 3) and claimed[4] == ("running", 3) and claimed[3] == ("retry_wait", 2)
    assert {r.notice_id: r.state for r in jobs.claim(queue, F.lit(now), 240, 2).collect()}[1] == "exhausted"
    assert {r.state: r.n for r in jobs.state_counts(queue).collect()} == {"pending": 0, "running": 1, "succeeded": 0, "skipped": 0, "blocked": 2, "retry_wait": 2, "exhausted": 1}
    waits = spark.createDataFrame([(i,) for i in (1, 2, 7, 8, 50)], "n int").select(jobs.retry_seconds(F.col("n"))).collect()
    assert [r[0] for r in waits] == [30, 60, 1920, 3600, 3600]
    wait = spark.range(1).select(jobs.wait_seconds(F.lit(dt.datetime(2026, 1, 1, 0, 0, 1, 1)), F.lit(T0)).alias("a"), jobs.wait_seconds(F.lit(T0), F.lit(T1)).alias("b")).first()
    assert (wait.a, wait.b) == (2, 0)


def test_review_rules(spark):
    schema = "dates array<struct<kind:string,end_date:string>>, evidence array<struct<field:string,source_type:string,verification:string>>"
    df = spark.createDataFrame([([("application", "2026-01-05"), ("event", "2026-02-01"), ("payment", "2026-01-09")], [("summary", "text", "text_matched")]), ([], [("summary", "image", "none")])], schema)
    rows = df.select(
        review.deadline(F.col("dates")).alias("d"),
        review.requires_review(F.lit("edu"), F.lit(1), F.array().cast("array<string>"), F.lit("none"), F.col("evidence"), F.array(F.lit("summary"))).alias("r"),
    ).collect()
    assert [(r.d, r.r) for r in rows] == [("2026-01-09", False), (None, True)]
    counts = spark.createDataFrame([(0, 0), (2, 0), (2, 1), (2, 2)], "f int, r int").select(review.attachment_status(F.col("f"), F.col("r"))).collect()
    assert [r[0] for r in counts] == ["none", "unread", "partial", "all_read"]


XML = "<ROOT><list_total_count>{total}</list_total_count><RESULT><CODE>{code}</CODE><MESSAGE>m</MESSAGE></RESULT>{rows}</ROOT>"
ROW = "<row><ID>{id}</ID><TITLE>t</TITLE><LINK>https://x.kr/{id}</LINK><PUBDATE>{day}</PUBDATE><DEPARTMENT>d</DEPARTMENT><DESCRIPTION>{body}</DESCRIPTION></row>"


def test_api_pages(spark):
    row = lambda i, day="2026-01-02", body="&lt;p&gt;b&lt;/p&gt;": ROW.format(id=i, day=day, body=body)
    pages = [(1, 2, XML.format(total=3, code="INFO-000", rows=row(1) + row(2, "2026-02-30"))), (3, 4, XML.format(total=3, code="INFO-000", rows=row(3, body="&lt;p&gt; &lt;/p&gt;"))), (5, 6, XML.format(total=3, code="ERROR-500", rows="")), (7, 8, XML.format(total=9, code="INFO-000", rows=row(7))), (9, 9, "<!DOCTYPE a><ROOT/>"), (10, 10, XML.format(total=10, code="INFO-000", rows=row("")))]
    parsed = api_xml.parse_pages(spark.createDataFrame(pages, "start long, end long, xml string")).orderBy("start")
    assert [r.error for r in parsed.collect()] == [None, None, "server", "row_count", "entities", "blank_field"]
    rows = api_xml.notice_rows(parsed).orderBy("page", "pos").collect()
    assert [(r.post_sn, r.registered) for r in rows] == [("1", "2026-01-02"), ("2", "2026-02-30"), ("3", "2026-01-02")]
    twice = XML.format(total=1, code="INFO-000", rows=row(1).replace("<TITLE>", "<TITLE>a</TITLE><TITLE>", 1))
    assert api_xml.parse_pages(spark.createDataFrame([(1, 1, twice)], "start long, end long, xml string")).first().error == "duplicate_field"
    assert api_xml.ranges(25, 10, 2) == [(1, 10), (9, 18), (17, 25)] and api_xml.ranges(0) == [] and api_xml.ranges(9, sample=True) == [(1, 5)]
    assert api_xml.one(api_xml.notice_rows(parsed), "2").first().post_sn == "2"


def test_file_references(spark):
    link = "/component/file/ND_fileDownload.do?q_fileId=F&q_fileSn=1"
    html = f"<a href='{link}'> 공고 <b>문</b></a><a href='http://www.nowon.kr{link}&x=#y'>again</a><img src='/p.jpg'><img src='/webcontent/crosseditor/images/a.JPG'><a href='/page'>no</a><a href='mailto:a@b.kr'>m</a><a href='http://[x/'>bad</a>"
    df = spark.createDataFrame([(1, "https://www.nowon.kr/www/n", html), (2, "u", None)], "id long, url string, body_html string")
    got = html_files.district_files(df, "id").orderBy("pos").collect()
    assert [(r.kind, r.file_name, (r.file_key or "")[:4], r.error) for r in got] == [("attachment", "공고 문", "id:F", None), ("attachment", "again", "id:F", None), ("inline_image", None, "url:", None), ("attachment", "bad", "", "invalid_file_url")]
    assert got[0].url == "https://www.nowon.kr/component/file/ND_fileDownload.do?q_fileSn=1&q_fileId=F"
    once = html_files.unique_files(html_files.district_files(df, "id"), "id").collect()
    assert sorted((r.file_key[:4], r.conflict) for r in once) == [("id:F", True), ("url:", False)]


def test_replay(spark, tmp_path):
    (tmp_path / "list_1.html").write_text("<p>\nx</p>")
    assert [tuple(r) for r in replay.responses(spark, str(tmp_path)).collect()] == [("list_1", "<p>\nx</p>")]
    assert [r.error for r in replay.binaries(spark, str(tmp_path), 3).collect()] == ["too_large"]


def test_streamed_batches_make_snapshots(spark, tmp_path):
    source, table = str(tmp_path / "in"), SnapshotTable(spark, str(tmp_path / "table"), STORED)
    run = lambda: collect_stream(spark.readStream.schema(KEYED).parquet(source), table, str(tmp_path / "checkpoint")).awaitTermination()
    spark.createDataFrame([notice("1"), notice("2")], KEYED).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([notice("2", "new"), notice("3")], KEYED).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {r.post_sn: (r.title, r.content_revision) for r in table.at(1).collect()} == {"1": ("t", 1), "2": ("new", 2), "3": ("t", 1)}
    assert table.at(0).count() == 2
