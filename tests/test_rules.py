import datetime as dt
import json

from pyspark.sql import functions as F

from placard.operators import claims, dictionary, highlights, manifest, rewrite, validators

NOW = dt.datetime(2026, 1, 2)


def test_card_audit(spark):
    rows = [
        (1, "audience", "만 19세 이상", "만 20세 이상"), (2, "audience", "19세 이하", "만 19세 이상"), (3, "deadline", "2026년 5월 1일 18:00", "접수 2026년 5월 1일"),
        (4, "deadline", "2026년 5월 9일 ~ 5월 1일", "2026년 5월 1일 ~ 5월 9일"), (5, "notes", "무료, 1만원", "참가비 1만 5천원"), (6, "action", "신청하지 않아도 됩니다", "반드시 신청해야 합니다"), (7, "action", "신청", None), (8, "notes", "1만원", "10,000원"),
    ]
    got = {r.notice_id: r.reasons for r in claims.audit_cards(spark.createDataFrame(rows, "notice_id long, card string, card_text string, source_text string")).collect()}
    assert got == {
        1: ["card_audience_age_added", "card_audience_age_omitted"], 2: ["card_audience_age_bound_changed"], 3: ["card_deadline_time_added"], 4: ["card_deadline_range_reversed"],
        5: ["card_notes_amount_added", "card_notes_amount_omitted", "card_notes_false_free"], 6: ["card_action_required_weakened"], 7: ["card_action_source_missing"], 8: [],
    }


def test_grounded_dates_and_politeness(spark):
    rows = [("application", "2026-05-01", "2026-05-09", "접수: 2026. 5. 1. ~ 5. 9."), ("payment", "2026-05-01", None, "접수: 2026. 5. 1."), ("event", "2026-05-02", None, "행사 2026. 5. 1."), ("event", "2026-05-09", "2026-05-01", "2026. 5. 1. 2026. 5. 9."), ("event", "2026-05-01", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "notice_id long, kind string, start_date string, end_date string, block string")
    assert [r.verdict for r in claims.ground_dates(df).orderBy("notice_id").collect()] == ["ok", "kind_not_in_source", "date_not_in_source", "reversed", "date_not_in_source"]
    said = spark.createDataFrame([("신청하세요. 무료입니다.",), ("신청 바람.",), ("\"신청함\"이라고 적습니다",), ("",)], "t string")
    assert [r[0] for r in said.select(claims.is_polite(F.col("t"))).collect()] == [True, False, True, False]


def test_highlights(spark):
    body = "\U0001f600 신청은 5월입니다. 장소는\n구청. 신청"
    rows = [(1, "a", "5월입니다", "text"), (1, "a", "장소는 구청", "text"), (1, "b", "신청", "text"), (1, "c", "x", "document"), (1, "d", None, None), (1, "e", "없음", "text")]
    df = spark.createDataFrame([(*r, body) for r in rows], "notice_id long, card string, excerpt string, source_type string, body string")
    located = highlights.locate(df.filter("source_type is not null"))
    assert {(r.card, r.place_status) for r in located.collect()} == {("a", "matched"), ("a", "near"), ("b", "ambiguous"), ("c", "file_reference"), ("e", "not_found")}
    got = {r.card: (r.status, [tuple(s) for s in r.spans]) for r in highlights.card_status(located).collect()}
    assert got == {"a": ("ready", [(7, 12), (14, 20)]), "b": ("ambiguous", []), "c": ("file_only", []), "e": ("not_found", [])}
    spans = spark.createDataFrame([("abcdef", [(1, 3), (2, 5)]), ("", [])], "t string, s array<struct<start:long,end:long>>")
    cut = [[(p.text, p.highlighted) for p in r[0]] for r in spans.select(highlights.parts(F.col("t"), F.col("s"))).collect()]
    assert cut == [[("a", False), ("b", True), ("c", True), ("de", True), ("f", False)], []]
    assert spark.range(1).select(highlights.occurrences(F.lit("aaaa"), F.lit("aa"))).first()[0] == [0, 1, 2]
    assert spark.range(1).select(highlights.line_breaks(F.lit("합니다. 다음 ● 항목"))).first()[0] == "합니다.\n다음\n● 항목"


def test_line_breaks_know_lists_and_dates(spark):
    texts = ["1. 신청 2. 접수 3. 발표", "2026. 3. 1. 까지 2. 접수", "2. 둘 3. 셋", "(1) 가 (2) 나", "끝입니다.” 다음", "a.b@c.kr 1) 하나"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.b for r in df.select("i", highlights.line_breaks(F.col("t")).alias("b")).orderBy("i").collect()]
    assert got == ["1. 신청\n2. 접수\n3. 발표", texts[1], texts[2], "(1) 가\n(2) 나", "끝입니다.”\n다음", texts[5]]


def test_rewrite_checks_and_saves(spark):
    body = "접수는 6월 4일까지 구청 누리집에서 합니다. 자세한 내용은 누리집에 있습니다. " + "그 밖의 사항은 담당자에게 문의하시기 바랍니다. " * 4
    cases = [("4일까지 알려 주세요", "접수는 6월 4일까지"), ("5일까지", "접수는"), ("가 · 나", "없는 구절입니다"), ("접수는 6월 4일까지 구청 누리집에서 합니다", "접수는 6월 4일까지 구청")]
    df = spark.createDataFrame([(i, body, [(t, [q])]) for i, (t, q) in enumerate(cases)], "i int, b string, s array<struct<text:string,evidence:array<string>>>")
    got = [r.e for r in df.select("i", rewrite.rewrite_errors(F.col("b"), F.array(F.lit("제목 '가·나'")), F.col("s")).alias("e")).orderBy("i").collect()]
    assert got == [[], ["number_added", "quote_short"], ["quote_not_in_source", "symbol"], ["copied"]]
    schema = "intro array<string>, sections array<struct<heading:string,style:string,sentences:array<string>>>"
    shapes = spark.createDataFrame([(["a"], [("누가 받나요?", "steps", ["x"])]), (["a"] * 4, [("누가", "list", ["x" * 81])]), ([], [])], schema)
    assert [r[0] for r in shapes.select(rewrite.structure_errors(F.col("intro"), F.col("sections"))).collect()] == [[], ["heading", "intro", "sentence", "style"], ["sections"]]
    import hashlib

    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    easy = "notice_id long, notice_revision long, source_hash string, easy_text string, model string, prompt_version string, generated_at timestamp, token string"
    now = spark.createDataFrame([(i, 1, h(f"t{i}"), "old", "m", "p", NOW, f"k{i}") for i in (1, 2, 3, 5)], easy)
    notices = spark.createDataFrame([(1, 2, "t1"), (2, 1, "t2"), (3, 1, "t3"), (4, 1, "t4"), (5, 1, "t5")], "notice_id long, content_revision long, original_text string")
    later, sooner = NOW + dt.timedelta(1), NOW - dt.timedelta(1)
    batch = [(1, 2, h("t1"), "new", "m", "p", sooner, "n1", None), (2, 1, h("t2"), "new", "m", "p", sooner, "n2", "k2"), (3, 1, h("t3"), "new", "m", "p", later, "n3", None), (4, 1, h("x"), "new", "m", "p", NOW, "n4", None), (5, 1, h("t5"), "new", "m2", "p", sooner, "n5", "k5")]
    kept, refused = rewrite.save_easy_texts(now, spark.createDataFrame(batch, easy + ", expected_token string"), notices)
    assert {r.notice_id: r.easy_text for r in kept.collect()} == {1: "new", 2: "old", 3: "new", 5: "new"} and sorted(r.notice_id for r in refused.collect()) == [2, 4]
    old, new = (spark.createDataFrame(x, "id long, base string, derived string") for x in ([(1, "a", "d"), (2, "a", "d"), (3, "a", "d")], [(1, "a", "d"), (2, "b", "d"), (3, "b", "e")]))
    assert {r.id: r.derived for r in rewrite.clear_stale(old, new, "id", ("derived",), ("base",)).collect()} == {1: "d", 2: None, 3: "e"}


def test_dictionary(spark):
    view = {"channel": {"total": 1, "item": {"target_code": "7", "word_info": {"word": "공-고1", "pos_info": [{"pos_code": "1", "pos": "명사", "comm_pattern_info": [{"sense_info": [{"sense_code": "1", "definition": "널리 알림"}, {"sense_code": "2", "definition": "둘"}]}]}]}}}}
    rows = dictionary.entries(spark.createDataFrame([("공고", json.dumps(view)), ("다른", json.dumps(view)), ("깨짐", "{")], "query_word string, body string")).orderBy("sense_no").collect()
    assert [(r.target_code, r.pos, r.sense_code, r.definition) for r in rows] == [("7", "명사", "1", "널리 알림"), ("7", "명사", "2", "둘")]
    past, soon = NOW - dt.timedelta(1), NOW + dt.timedelta(1)
    schema = "cache_key string, result string, lease_token string, lease_expires_at timestamp, retry_after_at timestamp"
    cache = spark.createDataFrame([("a", "r", None, None, None), ("b", None, "t", soon, None), ("c", None, "t", past, None), ("d", None, None, None, soon)], schema)
    wanted = spark.createDataFrame([(k, f"new{k}") for k in "abcde"], "cache_key string, token string")
    held = dictionary.claim_lookups(cache, wanted, F.lit(NOW))
    assert {r.cache_key: r.lease_token for r in held.collect()} == {"a": None, "b": "t", "c": "newc", "d": None, "e": "newe"}
    done = spark.createDataFrame([("b", "stale", "x", None), ("c", "newc", "found", None), ("e", "newe", None, "permanent")], "cache_key string, token string, result string, error string")
    after = {r.cache_key: (r.result, r.lease_token, r.retry_after_at) for r in dictionary.finish_lookups(held, done, F.lit(NOW)).collect()}
    assert after["b"] == (None, "t", None) and after["c"] == ("found", None, None) and after["e"] == (None, None, NOW + dt.timedelta(seconds=60))
    stored = spark.createDataFrame([("a", 2, None, None), ("b", 0, None, None), ("c", None, soon, None)], "cache_key string, n_entries int, lease_expires_at timestamp, retry_after_at timestamp")
    links = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "c"), (3, 0, "c"), (4, 0, "z")], "notice_id long, ordinal int, cache_key string")
    got = {r.notice_id: r.status for r in dictionary.notice_dictionary(spark.range(1, 6).withColumnRenamed("id", "notice_id"), links, stored, F.lit(NOW)).collect()}
    assert got == {1: "complete", 2: "partial", 3: "pending", 4: "unprocessed", 5: "unprocessed"}


def test_rule_tables(spark):
    notices = spark.createDataFrame([(1, "nowon", "5", None, False, None, "t"), (2, "dong", " ", None, True, "X", ""), (3, "seoul", "5", "g", True, "KOGL-1", "t")], "id long, category string, post_sn string, dong_group string, is_pinned boolean, license_type string, title string")
    assert {r.id: r.broken for r in validators.violations(notices, "id", validators.notice_rules()).collect()} == {2: ["district", "key_blank", "license", "title_blank"], 3: ["district", "pinned"]}
    change = "id long, original_text string, changes array<struct<start:long,end:long,original:string,replacement:string>>"
    rows = spark.createDataFrame([(1, "가나다라", [(0, 1, "가", "x"), (2, 3, "다", "y")]), (2, "가나다라", [(1, 3, "나다", "나다"), (2, 4, "xx", "y")])], change)
    assert {r.id: r.broken for r in validators.violations(rows, "id", validators.change_rules()).collect()} == {2: ["order", "original", "unchanged"]}
    row = spark.range(1).select(validators.toggled(F.array(F.lit(1), F.lit(2)), F.lit(1)).alias("a"), validators.toggled(F.array(F.lit(1)), F.lit(2)).alias("b"), validators.unique(F.array(F.lit(1), F.lit(1))).alias("u")).first()
    assert (row.a, row.b, row.u) == ([2], [1, 2], False)


def test_required_and_free_as_the_rules_have_them(spark):
    rows = [
        ("action", "신청하지 않아도 됩니다", "반드시 신청해야 합니다", ["card_action_required_weakened"]), ("action", "신청 가능합니다", "반드시 신청해야 합니다", []), ("action", "필수가 아니에요", "의무입니다", []), ("action", "생략할 수 있어요", "의무입니다", ["card_action_required_weakened"]),
        ("action", "신분증은 선택이 아니에요", "신분증 필수", []), ("action", "반드시 오세요. 통장은 선택입니다", "반드시 신분증을 내세요", []), ("action", "반드시 오세요. 신분증은 선택입니다", "반드시 신분증을 내세요", ["card_action_required_weakened"]),
        ("notes", "참가비는 무료가 아니에요, 5천원", "참가비 5천원", []), ("notes", "비용이 없습니다", "참가비 5천원", ["card_notes_amount_omitted", "card_notes_false_free"]), ("notes", "무료", "참가비 5천원, 주민은 면제", ["card_notes_amount_omitted"]),
        ("notes", "무료", "참가비 0원", []), ("notes", "1만원", "상금", []), ("notes", "참가비 1만원", "상금", ["card_notes_amount_added"]),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "notice_id long, card string, card_text string, source_text string")
    assert {r.notice_id: r.reasons for r in claims.audit_cards(df).collect()} == {i: r[3] for i, r in enumerate(rows)}


def test_manifests_broadcast_no_notices(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "notice_id long, content_revision long, url string")
    files = spark.createDataFrame(
        [(1, 1, "k", "attachment", "u", "media", b"m", None), (1, 2, "l", "attachment", "v", "media", b"m", None), (1, 3, "n", "attachment", "w", "media", b"x", None), (2, 4, "k", "attachment", "u", "unread", None, "r")],
        "notice_id long, notice_file_id long, file_key string, kind string, url string, outcome string, content binary, reason_code string",
    )
    built = manifest.build(base, files)
    stored = files.selectExpr("notice_id", "notice_file_id as id", "file_key", "kind", "url")
    refs, checked = manifest.file_references(built), manifest.problems(built, base, stored)
    for df in (refs, checked):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.notice_id, [(x.source_id, [f.url for f in x.files]) for x in r.file_references]) for r in refs.collect()] == [(1, [("media_1", ["u", "v"]), ("media_2", ["w"])])]
    assert {r.notice_id: r.problem for r in checked.collect()} == {1: None, 2: None}


def test_html_sql_reads_references_without_semicolon():
    import duckdb

    from placard.catalog_rules import catalog
    from placard.functions.text import notice_text

    pages = ["<title>a&amp;&amp</title><p>b</p>", "<p>&lt&gt;&quot &#39 &#39;&copy&middot;</p>", "<p>x &amp;lt; y</p>"]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, html varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(pages)))
    assert dict(con.execute(catalog.ORACLE_SQL["html_to_text"]).fetchall()) == {i: notice_text(p) for i, p in enumerate(pages)}


def test_glossary_searches_a_long_text_once(spark):
    import time

    from placard.functions import spans

    text = spark.range(1).select(F.repeat(F.lit("the x"), 20_000).alias("t"))
    began = time.perf_counter()
    cut = text.select(spans.glossary_parts(F.col("t"), F.array(F.lit("the"))).alias("p")).first().p
    assert time.perf_counter() - began < 20
    assert len(cut) == 40_000 and [(p.text, p.is_term) for p in cut[:3]] == [("the", True), (" x", False), ("the", True)]


def test_elements_of_a_batch_are_not_python_objects(spark):
    import tracemalloc

    import pyarrow as pa

    from placard.sources.html_tree import elements

    pages = pa.array(['<table class="a b">' + '<tr><td class="c"><a href="x">y</a></td></tr>' * 20 + "</table>"] * 1000)
    run = elements("tr", "td", "a").func
    tracemalloc.start()
    try:
        found = run(pages)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6 and len(found[999]) == 60 and found[0].as_py()[2]["attrs"] == [("href", "x")]
