import hashlib
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from placard.functions import extract, identity, spans, text, urls


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>가 &amp;lt; 나</p>", "가 &lt; 나"),
        ("<table><tr><th>기간</th><td>5월 1일</td></tr><tr><th>장소</th><td><p>구청</p><p>강당</p></td></tr></table>", "기간: 5월 1일\n장소: 구청 강당"),
        ("<p>보임</p><p hidden>숨김</p><div style='display: none'>숨김<br></div><span aria-hidden='true'>x</span><p>끝</p>", "보임\n끝"),
        ("<p>첫 줄\n둘째 줄</p>", "첫 줄\n둘째 줄"),
        ("<p>자료 <a href='/f.do?q_fileSn=1&q_fileId=a'>공고문.hwp</a> 참고</p><a href='/x/form.PDF'>서식</a>", "자료 참고"),
        ("<img src='a.png'>", ""),
        ("<head><title>제목</title></head><script>var a='<p>';</script>본문<br>다음", "제목본문\n다음"),
        ("<p>a<s>b</s><del>c</del></p><svg>d</svg><iframe>e</iframe><object>f</object><center>g</center>h", "a\ng\nh"),
        ("<a href='/f.do?Q_FILESN=1'>x</a><a href='/%ED%8C%8C%EC%9D%BC.%77ebp'>y</a><a download>z</a><a href='/page'>w</a>", "w"),
        ("<table><tr><th>가</th><th>나</th><td>다<br>라</td><td> 마</td></tr></table>", "가 나: 다 라 마"),
        ("<input hidden>뒤", "뒤"),
        ("", ""),
        (None, ""),
    ],
)
def test_notice_text(html, want):
    assert text.notice_text(html) == want


def tokens(spark, find, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", find(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_dates_take_the_last_year(spark):
    said = ("2025. 7. 9.(수) ~ 7. 20. 또 2026년 8월 1일, 2월 30일, 7. 20.", "8월 2일부터", None, "2024-2-29/2025-2-29")
    assert tokens(spark, extract.date_tokens, *said) == [["2025-07-09", "2025-07-20", "2026-08-01", "2026-07-20"], [], None, ["2024-02-29"]]


def test_times_money_and_ages(spark):
    assert tokens(spark, extract.time_tokens, "08:15 ~ 오후 7시, 오전 12시 10분, 25:00, 오후 13시, 9시") == [["08:15", "19:00", "00:10"]]
    assert tokens(spark, lambda t: extract.time_tokens(t, bare=True), "9시 5분 또는 오후 0시, 21시") == [["09:05", "21:00"]]
    sums = tokens(spark, extract.money_tokens, "4만 5천원, 13,000원, 2만원, 3만2,500 원, 2만원")[0]
    assert sums == [Decimal(45000), Decimal(13000), Decimal(20000), Decimal(32500)]
    assert tokens(spark, extract.age_values, "만 18세 이상, 20-30세, 5에서 7세, 1234세") == [[18, 30, 7, 20, 5]]
    assert tokens(spark, extract.age_bounds, "만 18세 이상, 20～30세, 60세 미만, 40세") == [[">=18", "<60", ">=20", "<=30"]]


def test_numbers_of_any_length(spark):
    assert tokens(spark, text.number_tokens, "9" * 50 + " 007 12,345 7 10") == [["7", "10", "12345", "9" * 50]]


def test_terms_are_located_or_not_at_all(spark):
    rows = [("one alpha two", "one alpha", "alpha"), ("alphas", "alphas", "alpha"), ("a a", "a", "a"), ("3월 표", "3월 표", "표"), ("x 3월", "x 3월", "3월")]
    df = spark.createDataFrame(rows, "b string, c string, t string")
    found = df.select(spans.locate(F.col("b"), F.col("c"), F.col("t"), spans.protected_spans(F.col("b"))).alias("f")).collect()
    assert [(r.f.start, r.f.end, r.f.problem) for r in found] == [(4, 9, None), (None, None, "part_of_word"), (None, None, "not_unique"), (3, 4, None), (None, None, "protected")]
    cut = df.limit(1).select(spans.glossary_parts(F.lit("the there a.b"), F.array(F.lit("the"), F.lit("there"), F.lit("."), F.lit(""))).alias("p")).first().p
    assert [(p.text, p.is_term) for p in cut] == [("the", True), (" ", False), ("there", True), (" a", False), (".", True), ("b", False)]


def test_token_columns(spark):
    df = spark.createDataFrame([("값 1,200 그리고 034 www.a.kr/x. https://b.kr/(y) 12:30",), (None,)], "t string")
    row, none = df.select(text.number_tokens(F.col("t")).alias("n"), text.link_tokens(F.col("t")).alias("l"), extract.time_tokens(F.col("t")).alias("c")).collect()
    assert [int(x) for x in row.n] == [12, 30, 34, 1200] and row.l == ["https://b.kr/", "www.a.kr/x"] and row.c == ["12:30"]
    assert none.n is None and none.c is None


def test_places_are_never_guessed(spark):
    cases = [("abcabc", "abc", None, "ambiguous"), ("aaa", "aa", None, "ambiguous"), ("x가나다", "나", 2, "matched"), ("abc", "z", None, "not_found")]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, t string, q string")
    got = df.select("i", spans.unique_place(F.col("t"), F.col("q")).alias("p"), spans.match_status(F.col("t"), F.col("q")).alias("s")).orderBy("i").collect()
    assert [(r.p, r.s) for r in got] == [c[2:] for c in cases]


def test_changes_and_shifted_spans(spark):
    schema = "t string, c array<struct<start:long,end:long,replacement:string>>"
    df = spark.createDataFrame([("가\U0001f600나다라", [(1, 2, "xyz"), (3, 4, "")]), ("abc", [])], schema)
    assert [r[0] for r in df.select(spans.apply_changes(F.col("t"), F.col("c"))).collect()] == ["가xyz나라", "abc"]
    place = lambda a, b: spans.shifted(F.col("c"), F.lit(a).cast("long"), F.lit(b).cast("long"))
    row = df.limit(1).select(place(0, 1).alias("a"), place(1, 2).alias("b"), place(2, 4).alias("c"), place(4, 5).alias("d")).first()
    assert [tuple(x) for x in row] == [("unchanged", 0, 1), ("replaced", 1, 4), ("original_only", None, None), ("unchanged", 5, 6)]
    ok = df.select(spans.changes_in_order(F.col("c"), F.length("t")).alias("v")).collect()
    assert [r.v for r in ok] == [True, True]


def test_protected_spans(spark):
    df = spark.createDataFrame([("문의 a.b@c.kr, 02-123-4567, 월요일 10시 https://x.kr/a)",)], "t string")
    found = df.select("t", spans.protected_spans(F.col("t")).alias("p")).first()
    assert [found.t[s.start : s.end] for s in found.p] == ["a.b@c.kr,", "02-123-4567", "월요일", "10시", "https://x.kr/a)"]
    both = spark.createDataFrame([("https://a.kr/1\u3000x",)], "t string").select(spans.protected_spans(F.col("t")).alias("p")).first().p
    assert [tuple(s) for s in both] == [(0, 14), (13, 14)]


def test_revision_hash_equals_compact_json(spark):
    pairs = [("제목", "본문 \"q\" \\ /\n\t"), ("a\u001f\u000b", "b\u0000\u007f"), ("x", None), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.h for r in df.select("i", identity.revision_hash(F.col("a"), F.col("b")).alias("h")).orderBy("i").collect()]
    assert got == [hashlib.sha256(json.dumps(p, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for p in pairs]


def test_file_keys_and_urls(spark):
    df = spark.createDataFrame([("https://H.kr/a?q_fileSn=3&q_fileId=f9&z=1#t",), ("http://h.kr/a?q_fileSn=3",), ("http://u@h.kr/",)], "u string")
    rows = df.select(urls.file_identity(F.col("u")).alias("i"), urls.canonical(F.col("u"), "q_fileSn").alias("c"), urls.allowed(F.col("u"), "h.kr").alias("ok")).collect()
    assert tuple(rows[0].i) == ("3", "f9") and rows[1].i is None
    assert rows[0].c == "https://h.kr/a?q_fileSn=3&q_fileId=f9&z=1" and [r.ok for r in rows] == [False, True, False]
    kinds = spark.createDataFrame([("image/png", "x"), (None, "a.PDF"), ("application/octet-stream", "b.jpg"), ("text/html", "c.pdf")], "m string, n string")
    assert [r[0] for r in kinds.select(urls.preview_kind(F.col("m"), F.col("n"))).collect()] == ["image", "pdf", "image", "none"]


def test_words_are_normalised_and_filtered(spark):
    df = spark.createDataFrame([(" 가나 ",), ("가",), ("a​b",), ("  ",), ("x" * 101,), (None,)], "w string")
    assert [r[0] for r in df.select(text.nfc_word("w")).collect()] == ["가나", "가", None, None, None, None]
    assert spark.range(1).select(text.strip(F.lit("　가 \t"))).first()[0] == "가"
    assert spark.range(1).select(text.redact(F.lit("key=abc abc"), "abc", "")).first()[0] == "key=*** ***"
