"""Places, schedules, shapes, budgets, carried columns and role views, on small made-up tables."""

import datetime as dt
import itertools
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placard.catalog_texts import _CARDS
from placard.functions import places, registry, shapes, spans
from placard.operators import budgets, highlights, merge, notes, rewrite, schedules
from placard.plans import views
from placard.sources import html_files


def brute_spaced(text, quote):
    """All (start, end) where the quote stands with other white space, by trying every start and end."""
    squeeze = lambda t: " ".join(t.split()) if not t[:1].isspace() and not t[-1:].isspace() else None
    want = " ".join(quote.split())
    return [(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if not text[a].isspace() and not text[b - 1].isspace() and squeeze(text[a:b]) == want]


def test_quote_places_equal_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice(["a", "b", "ab", " ", "  ", "\n", "　", "\U0001f600", "가"]) for _ in range(rng.randint(0, 14)))
        quote = "".join(rng.choice(["a", "b", " ", "\t ", "\U0001f600"]) for _ in range(rng.randint(1, 4)))
        assert places.all_places(text, quote) == [i for i in range(len(text)) if text.startswith(quote, i)]
        if quote.strip():
            assert places.spaced_places(text, quote) == brute_spaced(text, quote)
        at = list(range(len(text) + 1))
        assert places.utf16(text, at) == [len(text[:i].encode("utf-16-le")) // 2 for i in at]


def test_evidence_with_pattern_signs_and_long_texts(spark):
    body = r"x \E y \Q (a+b) $1 " + "long " * 40_000 + "end"
    rows = [(1, "a", q, "text", body) for q in (r"\E", r"\Q (a+b)", "$1   long", "(a+b)\n$1", "nowhere", "long")] + [(2, "a", "q", "text", None), (2, "b", "", "text", body)]
    got = [r.place_status for r in highlights.locate(spark.createDataFrame(rows, "notice_id long, card string, excerpt string, source_type string, body string").coalesce(1)).collect()]
    assert got == ["matched", "matched", "near", "near", "not_found", "ambiguous", "not_found", "invalid_reference"]
    cut = spark.createDataFrame([(r"a\Eb(c", [r"\E", "(c", r"\\"])], "t string, w array<string>").select(spans.glossary_parts(F.col("t"), F.col("w")).alias("p")).first().p
    assert [(p.text, p.is_term) for p in cut] == [("a", False), (r"\E", True), ("b", False), ("(c", True)]


@pytest.mark.parametrize("most", [100_000, 7])
def test_terms_are_the_longest_from_the_left_however_many_passes(spark, most):
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("ab가") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    texts = ["".join(rng.choice("ab가 ") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, ""]

    def brute(text):
        starts = {i: max(len(t) for t in terms if text.startswith(t, i)) for i in range(len(text)) if any(text.startswith(t, i) for t in terms)}
        out, at = [], 0
        for i in sorted(starts):
            if i >= at:
                at = i + starts[i]
                out.append((i, at))
        return len(starts), out

    df = places.mark_terms(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), spark.createDataFrame([(t,) for t in [*terms, " ", None]], "term string"), most=most)
    assert {r.id: (r.n_places, [tuple(s) for s in r.spans]) for r in df.collect()} == {i: brute(t or "") for i, t in enumerate(texts)}


def test_a_hundred_thousand_terms_take_one_pass(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("t"), "id", F.lit("x")).alias("term"))
    texts = spark.range(50).select(F.concat_ws(" ", *[F.concat(F.lit("t"), (F.col("id") * 1999 + k) % 120_000, F.lit("x")) for k in range(20)]).alias("text"), "id")
    got = {r.id: r.n_places for r in places.mark_terms(texts, terms).collect()}
    assert got == {i: sum((i * 1999 + k) % 120_000 < 100_000 for k in range(20)) for i in range(50)}


def test_no_terms(spark):
    assert places.mark_terms(spark.createDataFrame([("abc",)], "text string"), spark.createDataFrame([], "term string")).first().n_places == 0


# --- schedules


def test_blocks_and_kinds(spark):
    texts = [
        ("접수 기간: 2026. 3. 1. ~ 3. 5.\n행사 일시: 2026년 5월 2일 10:00", [("2026-03-01", "application"), ("2026-03-05", "application"), ("2026-05-02", "event")]),
        ("신청기간\n2026. 3. 1. ~ 3. 9.\n\n기간: 2026.4.1.", [("2026-03-01", "application"), ("2026-03-09", "application"), ("2026-04-01", None)]),
        ("행사 안내\n기간: 2026. 4. 1.", [("2026-04-01", "event")]),
        ("행사 안내\n납부 안내\n기간: 2026. 4. 1.", [("2026-04-01", None)]),
        ("2026. 4. 1. 접수합니다. 2026. 5. 1. 발표합니다.", [("2026-04-01", "application"), ("2026-05-01", "result")]),
        ("접수: 2026. 3. 1. 행사: 2026. 5. 1.", [("2026-03-01", "application"), ("2026-05-01", "event")]),
        ("신청 일시: 2026.3.2. / 납부 2026.3.3.", [("2026-03-02", "application"), ("2026-03-03", "payment")]),
        ("행사 참가자를 2026. 3. 2. 모집합니다", [("2026-03-02", "event")]), ("2026. 3. 2. 모집합니다", [("2026-03-02", "application")]),
        ("접수: 2026. 2. 30. 3. 1.", [("2026-03-01", "application")]), ("접수 3. 1.", []), ("", []), (None, []),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "id long, t string")
    found = {}
    for r in schedules.schedule_dates(rows, "id", "t").orderBy("id", "line", "block", "day").collect():
        found.setdefault(r.id, []).append((r.day, r.kind))
    assert found == {i: want for i, (_, want) in enumerate(texts) if want}


def test_grounding_needs_one_block(spark):
    source = "접수: 2026. 3. 1. ~ 3. 5.\n행사: 2026. 5. 1."
    rows = [("application", "2026-03-01", "2026-03-05"), ("application", "2026-03-01", "2026-05-01"), ("event", "2026-03-01", "2026-03-05"), ("event", None, "2026-05-01"), ("event", "2026-05-02", None), ("event", "2026-05-01", "2026-03-01"), ("event", None, None)]
    df = spark.createDataFrame([(i, *r, source) for i, r in enumerate(rows)], "id long, kind string, start_date string, end_date string, source string")
    assert [r.verdict for r in schedules.ground_in_text(df).orderBy("id").collect()] == ["ok", "date_not_in_source", "kind_not_in_source", "ok", "date_not_in_source", "reversed", "date_not_in_source"]


def test_lines_without_a_date_are_passed_over(spark):
    """The blocks with a date are the same, also below labels and headings; other lines aren't cut."""
    parts = ["접수 기간:", "plain words; of a line. more", "행사 안내", "기간: 2026. 5. 3.", "a 12 b. c", "x; 2026-03-04 / 신청 3.9. y! z", "납부 안내", "", "3/4 기간", "2025.1.2. 접수합니다. 기간:", "２０２６. 4. 5."]
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, "\n".join(rng.choices(parts, k=rng.randrange(1, 9)))) for i in range(300)], "id long, t string")
    all_blocks, dated = schedules.blocks(F.col("t")), schedules.blocks(F.col("t"), dated=True)
    got = rows.select(F.filter(all_blocks, lambda b: b["text"].rlike(schedules.DATE)).alias("x"), F.filter(dated, lambda b: b["text"].rlike(schedules.DATE)).alias("y"), F.size(all_blocks).alias("n"), F.size(dated).alias("m")).collect()
    assert all(r.x == r.y for r in got) and sum(r.m for r in got) < 0.6 * sum(r.n for r in got)


# --- shapes


def test_json_shapes(spark):
    ok = '{"audience": null, "deadline": "d", "action": null, "notes": "n"}'
    rows = [(ok, []), (None, []), ("", ["malformed"]), ("{", ["malformed"]), ("null", ["not_object"]), ("[]", ["not_object"]), ("{}", ["missing_key"]), (ok.replace('"d"', "3"), ["type"]), (ok.replace('"d"', '{"a": 1}'), ["type"]), (ok.replace('"d"', "true"), ["type"]), (ok.replace('"d"', '""'), ["blank"]), (ok.replace('"d"', '"\\u00a0"'), ["blank"]), (ok.replace('"d"', '"\\n"'), ["blank", "line_break"]), (ok.replace('"notes"', '"more"'), ["extra_key", "missing_key"])]
    got = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(rows)], "id long, j string").select("id", shapes.card_errors(F.col("j")).alias("e")).orderBy("id").collect()
    assert [r.e for r in got] == [want for _, want in rows] and len(_CARDS) == 4
    entries = [("[]", []), ('[{"word": "w", "senses": ["s"]}]', []), ('[{"word": "w", "senses": []}]', ["value"]), ('[{"word": " ", "senses": ["s"]}]', ["value"]), ('[{"word": "w", "senses": ["s", 1]}]', ["value"]), ('[{"word": "w"}]', ["missing_key"]), ('[{"word": "w", "senses": ["s"], "x": 1}]', ["extra_key"]), ("[1]", ["not_object"]), ("{}", ["not_array"]), ("[", ["malformed"])]
    got = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(entries)], "id long, j string").select("id", shapes.entry_errors(F.col("j"), ("word",), ("senses",)).alias("e")).orderBy("id").collect()
    assert [r.e for r in got] == [want for _, want in entries]


# --- budgets


def brute_budget(images, most_image, most_total):
    total, seen, digests, out = 0, {}, set(), []
    for pos, url, digest, size in images:
        if url in seen:
            out.append((pos, "again" if seen[url] in ("included", "same") else seen[url]))
            continue
        left = most_total - total
        if left <= 0:
            result = "total_size_limit"
        elif size is None:
            result = "fetch_failed"
        elif size > min(most_image, left):
            result = "total_size_limit" if left < most_image else "too_large"
        else:
            result = "same" if digest in digests else "included"
        if result == "included":
            total += size
            digests.add(digest)
        seen[url] = result
        out.append((pos, result))
    return out


def test_budgets_equal_brute_force(spark):
    rng = random.Random(3)
    pages = {n: [(i, f"u{rng.randrange(5)}", f"d{rng.randrange(4)}", rng.choice([None, 0, 3, 5, 8, 20])) for i in range(rng.randint(1, 9))] for n in range(60)}
    df = spark.createDataFrame([(n, *r) for n, rows in pages.items() for r in rows], "notice_id long, pos long, url string, digest string, bytes long")
    found = {}
    for r in budgets.within_budget(df, 8, 15).orderBy("notice_id", "pos").collect():
        found.setdefault(r.notice_id, []).append((r.pos, r.outcome))
    assert found == {n: brute_budget(rows, 8, 15) for n, rows in pages.items()}


def test_files_are_what_their_bytes_say(spark, tmp_path):
    files = {"a.png": b"\x89PNG\r\n\x1a\n1", "b.jpg": b"\xff\xd8\xff1", "c.gif": b"GIF89a1", "d.webp": b"RIFF1234WEBP", "e.pdf": b"%PDF-1", "f.hwpx": b"PK\x03\x04", "g.hwp": bytes.fromhex("D0CF11E0A1B11AE1"), "h.png": b"GIF89a", "i.txt": b"plain", "k.wav": b"RIFF1234WAVE"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = budgets.read_files(spark, str(tmp_path)).withColumn("error", budgets.file_error(F.col("content"), F.lit(None).cast("string"), F.col("suffix")))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.error) for r in read.select("path", "kind", "error").collect()}
    kinds = ["png", "jpeg", "gif", "webp", "pdf", "zip", "ole", "gif", None, None]
    assert got == {n: (k, {"h.png": "type_mismatch", "i.txt": "unknown_type", "k.wav": "unknown_type"}.get(n)) for n, k in zip(files, kinds, strict=True)}
    assert spark.range(1).select(budgets.file_error(F.lit(b""), F.lit(None).cast("string"), F.lit("png"))).first()[0] == "empty"


# --- merges, roles, SQL functions


def test_upsert_keeps_columns_that_are_no_content(spark):
    day, at = dt.date(2026, 1, 1), dt.datetime(2026, 1, 1)
    key = "category string, source_board string, post_sn string, dong_group string, title string, department string, registered_on date, url string, body_html string, license_type string"
    row = lambda sn, *more: ("c", "b", sn, None, "t", None, day, "u", "h", None, *more)
    target = spark.createDataFrame([row("1", False, "old", "x", False, True, 4, at, at), row("2", True, "two", "y", False, True, 1, at, at)], key + ", is_pinned boolean, body_text string, own string, is_modified boolean, is_visible boolean, content_revision long, content_updated_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([row("1", True, "new"), row("3", True, "three")], key + ", is_pinned boolean, body_text string")
    got = {r.post_sn: (r.is_pinned, r.body_text, r.own, r.content_revision, r.is_modified) for r in merge.upsert_notices(target, batch, F.lit(dt.datetime(2026, 2, 1))).collect()}
    assert got == {"1": (True, "new", "x", 4, False), "2": (True, "two", "y", 1, False), "3": (True, "three", None, 1, False)}


def test_readers_see_no_private_names_and_filters_refuse_other_codes(spark):
    columns = ["id", "title", "is_visible", "dong_group", "body_html", "content_revision", "claim_token", "manager_name", "source_board", "category_code"]
    df = spark.createDataFrame([(1, "t", True, None, "h", 1, "x", "m", "s", 3), (2, "t", False, None, "h", 1, "x", "m", "s", None), (3, "t", True, "other", "h", 1, "x", "m", "s", 3)], "id long, title string, is_visible boolean, dong_group string, body_html string, content_revision long, claim_token string, manager_name string, source_board string, category_code long")
    seen = views.for_role(df, "reader")
    assert set(seen.columns) <= set(views.ROLES["reader"]) and not {"claim_token", "manager_name", "content_revision", "body_html", "is_visible"} & set(seen.columns) and [r.id for r in seen.collect()] == [1]
    assert views.for_role(df, "service").columns == columns
    with pytest.raises(ValueError, match="role"):
        views.for_role(df, "guest")
    assert [r.id for r in views.filtered(df, code=None).collect()] == [2] and views.filtered(df, "s", 3, [1, 2]).count() == 1
    for wrong in ({"code": 8}, {"code": "3"}, {"ids": list(range(21))}):
        with pytest.raises(ValueError, match="allowed|at most"):
            views.filtered(df, **wrong)


def test_sql_and_column_functions_agree_on_titles(spark):
    registry.register(spark)
    texts = ["t\nx", "t\n", "t", "tt\nx", "t\n \n", None]
    rows = [(o, e, [(s,)] if s is not None else []) for o, e, s in itertools.product(texts, texts, [None, 0, 2])]
    df = spark.createDataFrame(rows, "o string, e string, c array<struct<start:int>>").withColumn("t", F.lit("t"))
    both = df.select(F.expr("preserves_title(t, o, e, c)").alias("a"), rewrite.preserves_title(F.col("t"), F.col("o"), F.col("e"), F.col("c")).alias("b")).collect()
    assert all(r.a == r.b for r in both) and {r.a for r in both} == {True, False}


def test_dictionary_table_functions(spark):
    links = spark.createDataFrame([(1, 0, "w", "k1"), (1, 1, "v", "k2"), (2, 0, "w", "k2"), (3, 0, "u", "k3")], "notice_id long, ordinal int, query_word string, cache_key string")
    later = dt.datetime(2026, 1, 1, 0, 0, 30)
    cache = spark.createDataFrame([("k1", "w", 2, None, None, None), ("k2", "v", None, later, None, None), ("k3", "u", None, None, dt.datetime(2026, 1, 1, 2), "dictionary_timeout")], "cache_key string, query_word string, n_entries int, lease_expires_at timestamp, retry_after_at timestamp, last_error_code string")
    registry.register_tables(links, cache, "2026-01-01 00:00:00")
    assert [tuple(r) for r in spark.sql("select * from notice_dictionary_entries(1) order by ordinal").collect()] == [(0, "w", "found", 0), (1, "v", "pending", 30)]
    got = spark.sql("select n.id, d.status, d.retry_after from (values (1L), (2L), (3L), (4L)) n(id) left join lateral notice_dictionary(n.id) d order by n.id").collect()
    assert [tuple(r) for r in got] == [(1, "pending", 30), (2, "unprocessed", 0), (3, "partial", 3600), (4, None, None)]


def test_addresses_have_one_form(spark):
    own, file_ = "https://www.nowon.kr", "https://www.nowon.kr/component/file/ND_fileDownload.do"
    base = "http://www.nowon.kr:80/a/b/list.do?x=1"
    district = {
        "c.do": f"{own}/a/b/c.do", "./c/../d": f"{own}/a/b/d", "../../../up/": f"{own}/up/", "..": f"{own}/a/", "/r#frag": f"{own}/r", "?y=2": f"{own}/a/b/list.do?y=2", "": f"{own}/a/b/list.do?x=1", "#only": f"{own}/a/b/list.do?x=1",
        " //www.nowon.kr/z ": f"{own}/z", "HTTP://WWW.NOWON.KR:443/z": f"{own}/z", "http://www.nowon.kr:8080/z#f": "http://www.nowon.kr:8080/z", "http://u@www.nowon.kr/z": "http://u@www.nowon.kr/z", "https://other.test/q?b=2&a=1#f": "https://other.test/q?b=2&a=1",
        "mailto:a@b": "", "javascript:x()": "", "http://[bad/": None, "http://h:99999/": None, "http://h:x/": None,
        "/component/file/ND_fileDownload.do?q_fileId=b&q_fileSn=1": f"{file_}?q_fileSn=1&q_fileId=b", "/component/file/ND_fileDownload.do?q_fileSn=2&b=&a&q_fileSn=1&&b=%20+x": f"{file_}?q_fileSn=1&q_fileSn=2&a=&b=&b=++x",
        "/component/file/ND_fileDownload.do?z=~*&y=%EA%B0%80&w=%zz": f"{file_}?w=%25zz&y=%EA%B0%80&z=~%2A", "/component/file/ND_fileDownload.do?": file_,
    }
    city = {"a%20b.hwp": "https://news.seoul.go.kr/p/a%20b.hwp", "https://u:p@news.seoul.go.kr/x": None, "http://news.seoul.go.kr:81/x": None, "mailto:x@y": None, "http://culture.seoul.go.kr/x?q=1#f": "http://culture.seoul.go.kr/x?q=1"}
    for is_city, at, want in ((False, base, district), (True, "http://news.seoul.go.kr/p/1", city)):
        df = spark.createDataFrame([(r, at) for r in want], "r string, b string")
        assert {x.r: x.url for x in html_files.addressed(df, F.col("b"), F.col("r"), is_city).select("r", "a.url").collect()} == want
    df = spark.createDataFrame([("a%20b+c/%EA%B0%80.hwp", base), (None, base), ("x%zz", None)], "r string, b string")
    got = [(x.a and (x.a.url, x.a.path, x.a.host)) for x in html_files.addressed(df, F.col("b"), F.col("r"), False).select("a").collect()]
    assert got == [(f"{own}/a/b/a%20b+c/%EA%B0%80.hwp", "/a/b/a b+c/가.hwp", "www.nowon.kr"), None, ("", None, None)]


# --- groups of notes


def test_rules_keep_their_exceptions(spark):
    texts = ["주차 금지. 다만 장애인은 가능\n안내", "취소 불가, 단, 재난은 예외", "접수 불가; 예외 없음", "환불 불가피한 경우 가능", "주차 금지\n\n다만 밤에는 가능", "주차 금지.\n다만 밤에는 가능. 끝", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").select("id", notes.rules(F.col("t")).alias("r")).orderBy("id").collect()
    assert [r.r for r in got] == [["주차 금지. 다만 장애인은 가능"], ["취소 불가, 단, 재난은 예외"], ["접수 불가; 예외 없음"], [], ["주차 금지\n\n다만 밤에는 가능"], ["주차 금지.\n다만 밤에는 가능"], []]


def test_what_a_note_permits(spark):
    said = ["취소 가능", "취소 불가, 환불 가능", "취소와 환불은 불가", "예외로 접수", "예외로 접수는 안 되고 등록 가능하지 않음", "안내"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id long, t string").select("id", notes.permitted(F.col("t")).alias("p")).orderBy("id").collect()
    assert [r.p for r in got] == [["취소"], ["환불"], [], ["접수"], ["접수"], []]


def test_note_groups_are_components_and_none_is_cut(spark):
    """Links pass from note to note through shared actions and rules; groups that don't fit are left out whole."""
    rule = "취소 불가. 다만 환불 가능하고 접수 불가, 등록 가능"
    rows = {
        1: (["취소 불가", "취소 가능, 환불 불가", "환불 가능", "안내 하나", "안내 둘", "안내 셋"], [rule]),
        # The rule's text holds the first, third and sixth.
        2: (["취소 불가", "취소 가능", "접수 불가", "접수 가능", "등록 불가", "등록 가능", "따로"], [rule]),
        3: (["취소 불가", "취소 가능"] * 3 + ["a", "b", "c"], [rule]),
        4: (["취소 불가", "취소 가능", "a", "b", "c", "d"], ["취소 불가"]),
        5: (["주차 금지", "다만 밤에는 됨", "a", "b", "c", "d", "e"], ["주차 금지. 다만 밤에는 됨"]),
        6: (["취소 불가", "취소 가능"], []),
    }
    flat = [(n, i, note) for n, (said, _) in rows.items() for i, note in enumerate(said)]
    told = [(n, t) for n, (_, texts) in rows.items() for t in texts]
    groups = notes.grouped(spark.createDataFrame(flat, "notice_id long, pos long, note string"), spark.createDataFrame(told, "notice_id long, text string"))
    found, kept = {}, {}
    for r in notes.chosen(groups).orderBy("notice_id", "pos").collect():
        found.setdefault(r.notice_id, []).append(r.note_group)
        kept.setdefault(r.notice_id, []).append(r.kept)
    assert found == {1: [0, 0, 0, 3, 4, 5], 2: [0] * 6 + [6], 3: [0] * 6 + [6, 7, 8], 4: [0, 1, 2, 3, 4, 5], 5: [0, 0, 2, 3, 4, 5, 6], 6: [0, 1]}
    assert kept == {1: [True] * 5 + [False], 2: [False] * 6 + [True], 3: [False] * 6 + [True] * 3, 4: [True] * 5 + [False], 5: [True] * 5 + [False] * 2, 6: [True, True]}


def test_choice_equals_brute_force(spark):
    rng = random.Random(5)
    groups = {n: [rng.randrange(8) for _ in range(rng.randint(1, 14))] for n in range(80)}
    rows = []
    for n, labels in groups.items():
        first = {}
        for i, g in enumerate(labels):
            first.setdefault(g, i)
        rows += [(n, i, "x", first[g]) for i, g in enumerate(labels)]
    want = {}
    for n in groups:
        own = [r for r in rows if r[0] == n]
        members = {}
        for _, i, _, g in own:
            members.setdefault(g, []).append(i)
        room, taken = 5, set()
        for g in sorted(members, key=lambda g: (len(members[g]) == 1, g)):
            if len(members[g]) <= room:
                room -= len(members[g])
                taken.add(g)
        want |= {(n, i): len(own) <= 5 or g in taken for _, i, _, g in own}
    df = spark.createDataFrame(rows, "notice_id long, pos long, note string, note_group long")
    assert {(r.notice_id, r.pos): r.kept for r in notes.chosen(df).collect()} == want


def _peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_term_places_of_a_batch_are_not_python_objects():
    class Shared:
        value = ["the", "then"]

    texts = pa.array(["the then " * 150] * 1000)
    found = places._term_marks(Shared).func(texts)
    assert found[0].as_py()["n_places"] == 300 and found[999].as_py()["spans"][1] == {"start": 4, "end": 8}
    assert _peak_mb(lambda: places._term_marks(Shared).func(texts)) < 20
    parts = [places._term_finder(type("One", (), {"value": [t]})).func(texts) for t in ("the", "then")]
    assert places._joined_marks.func(*parts).equals(found)


def test_quote_places_of_a_batch_are_not_python_objects():
    texts, quotes = pa.array(["the then " * 150] * 1000), pa.array(["the"] * 1000)
    found = places.quote_places.func(texts, quotes)
    assert found[999].as_py()["places"][1] == {"start": 4, "end": 7, "start16": 4, "end16": 7}
    assert _peak_mb(lambda: places.quote_places.func(texts, quotes)) < 30
