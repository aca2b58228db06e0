"""Paged lists, keyed leases and the fence of results, run and run again in other cuts."""

import datetime as dt
import random

import pandas as pd
import pytest

from placard.sources import paged
from placard.streaming import fence, leases

T0 = dt.datetime(2024, 1, 1)


def page(total, ids, title="t"):
    rows = "".join(f"<row><ID>{i}</ID><TITLE>{title}</TITLE><LINK>l</LINK><PUBDATE>2026-01-01</PUBDATE><DEPARTMENT>d</DEPARTMENT></row>" for i in ids)
    return f"<ROOT><list_total_count>{total}</list_total_count><RESULT><CODE>INFO-000</CODE><MESSAGE>m</MESSAGE></RESULT>{rows}</ROOT>"


def recorded(spark, folder, rows):
    """rows: (board, poll, first, last, attempt, status, xml)."""
    paged.record(spark.createDataFrame(rows, "board string, poll int, first int, last int, attempt int, status int, xml string"), str(folder))
    return str(folder)


def test_ranges_overlap_and_end_with_the_list():
    assert paged.page_ranges(0, 10, 2) == [(1, 10)]
    assert paged.page_ranges(10, 10, 2) == [(1, 10)]
    assert paged.page_ranges(11, 10, 2) == [(1, 10), (9, 11)]
    assert paged.page_ranges(30, 10, 2) == [(1, 10), (9, 18), (17, 26), (25, 30)]
    assert paged.page_ranges(30, 10, 2, sample=True) == [(1, 5)]
    with pytest.raises(ValueError, match="overlap"):
        paged.page_ranges(5, 10, 10)


def test_each_range_is_a_partition_and_errors_are_tried_again(spark, tmp_path):
    ids = list(range(100, 80, -1))
    rows = [("a", 1, 1, 10, 1, 503, ""), ("a", 1, 1, 10, 2, 200, page(20, ids[:10])), ("a", 1, 9, 18, 1, 429, ""), ("a", 1, 17, 20, 1, 500, ""), ("a", 1, 17, 20, 2, 500, ""), ("a", 1, 17, 20, 3, 500, ""), ("a", 1, 1, 1, 1, 200, page(20, ids[:1])), ("b", 1, 1, 10, 1, 404, "")]
    pages = paged.read_pages(spark, recorded(spark, tmp_path / "r", rows), size=10, overlap=2)
    assert pages.rdd.getNumPartitions() == 5
    got = {(r.board, r.start, r.confirms): (r.attempts, r.status) for r in pages.collect()}
    assert got == {("a", 1, False): (2, 200), ("a", 9, False): (1, 429), ("a", 17, False): (3, 500), ("a", 1, True): (1, 200), ("b", 1, False): (1, 404)}
    parsed = paged.parsed_pages(pages)
    assert {r.start: r.error for r in parsed.filter("board = 'a' and not confirms").collect()} == {1: None, 9: "rate_limited", 17: "http"}
    status = {r.board: r for r in paged.list_status(parsed).collect()}
    assert (status["a"].n_failed, status["a"].n_rows, status["a"].complete) == (2, 10, False) and (status["b"].total, status["b"].complete) == (None, False)


def test_long_lists_are_read_in_runs_and_recorded_in_stretches(spark, tmp_path):
    """Neither a folder nor a task for each page, and the same pages all the same."""
    n, ids = 12_000, range(12_000, 0, -1)
    rows = [("a", 1, a, b, 1, 200, page(n, ids[a - 1 : b])) for a, b in paged.page_ranges(n, 10, 2)] + [("a", 1, 1, 1, 1, 200, page(n, ids[:1]))]
    folder = recorded(spark, tmp_path / "r", rows)
    assert len([p for p in (tmp_path / "r").rglob("*") if p.is_dir()]) == 4
    pages = paged.read_pages(spark, folder, size=10, overlap=2)
    assert pages.rdd.getNumPartitions() <= paged.FEW_RANGES
    assert sorted((r.start, r.end, r.attempts, r.status, r.xml) for r in pages.collect()) == sorted((r[2], r[3], 1, 200, r[6]) for r in rows)
    status = paged.list_status(paged.parsed_pages(pages)).first()
    assert (status.n_pages, status.n_rows, status.complete) == (len(rows) - 1, n, True)


@pytest.mark.parametrize(("change", "finds"), [("none", (0, False, True)), ("first", (0, True, False)), ("total", (0, True, False)), ("content", (1, False, False)), ("lost", (0, False, False))])
def test_a_list_is_complete_only_if_nothing_moved(spark, tmp_path, change, finds):
    ids = list(range(20, 8, -1))
    second = ids[8:] if change != "lost" else [*ids[8:11], ids[10]]
    rows = [("a", 1, 1, 10, 1, 200, page(12, ids[:10])), ("a", 1, 9, 12, 1, 200, page(13 if change == "total" else 12, second if change != "total" else ids[8:], "other" if change == "content" else "t")), ("a", 1, 1, 1, 1, 200, page(12, [99] if change == "first" else ids[:1]))]
    if change == "content":
        rows[1] = ("a", 1, 9, 12, 1, 200, page(12, ids[8:]).replace("<ID>12</ID><TITLE>t", "<ID>12</ID><TITLE>u"))
    r = paged.list_status(paged.parsed_pages(paged.read_pages(spark, recorded(spark, tmp_path / "r", rows), size=10, overlap=2))).first()
    assert (r.n_conflicts, r.moved, r.complete) == finds


def test_stream_offsets_replay_to_the_same_rows(spark, tmp_path):
    """Rows between two lengths of the list, whatever came on top; a range read again gives the same."""
    old = [f"o{i}" for i in range(7, 0, -1)]
    new = [f"n{i}" for i in range(25, 0, -1)]
    whole, moved = new + old, ["x2", "x1", *new, *old]
    rows = [("a", 1, 1, 10, 1, 200, page(7, old)), ("a", 2, 1, 10, 1, 200, page(32, whole[:10]))]
    rows += [("a", 2, 11, 20, 1, 200, page(34, moved[10:20])), ("a", 2, 13, 22, 1, 200, page(34, moved[12:22])), ("a", 2, 21, 30, 1, 503, ""), ("a", 2, 21, 30, 2, 200, page(34, moved[20:30])), ("a", 2, 23, 32, 1, 200, page(34, moved[22:32]))]
    folder = recorded(spark, tmp_path / "r", rows)
    reader = paged.PageStreamReader({"path": folder, "boards": "a", "size": "10"})
    assert reader.initialOffset() == {"poll": 0, "index": 0} and reader.latestOffset() == {"poll": 2, "index": 32}
    assert paged.PageStreamReader({"path": folder, "boards": "a", "size": "10", "baseline": "5"}).initialOffset() == {"poll": 0, "index": 2}
    ranges = reader.partitions({"poll": 1, "index": 7}, {"poll": 2, "index": 32})
    assert [(p.start, p.end, p.keep) for p in ranges] == [(1, 10, 10), (11, 20, 10), (21, 30, 5)]
    once, again = ([tuple(x) for p in ranges for x in reader.read(p)] for _ in range(2))
    assert once == again and [(r[2], r[3], r[5], r[6]) for r in once] == [(1, 10, 1, 200), (13, 22, 2, 200), (23, 32, 3, 200)]
    out, got = str(tmp_path / "out"), {}
    for upto in (1, 1, 2, 2):  # a run without anything new adds nothing
        stream = paged.new_rows(paged.parsed_pages(paged.stream_pages(spark, folder, "a", size=10, upto=upto)))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-p").trigger(availableNow=True).start().awaitTermination()
        got[upto] = sorted(r.post_sn for r in spark.read.parquet(out).collect())
    assert got == {1: sorted(old), 2: sorted(whole)}


def test_a_list_that_shrinks_stops_the_stream(spark, tmp_path):
    folder = recorded(spark, tmp_path / "r", [("a", 1, 1, 10, 1, 200, page(5, "abcde")), ("a", 2, 1, 10, 1, 200, page(3, "abc"))])
    reader = paged.PageStreamReader({"path": folder, "boards": "a", "size": "10"})
    (p,) = reader.partitions({"poll": 1, "index": 5}, {"poll": 2, "index": 3})
    assert next(iter(reader.read(p)))[6] == paged.SHRUNK
    assert paged.PageStreamReader({"path": str(tmp_path / "none"), "boards": "a"}).latestOffset() == {"poll": 0, "index": 0}


# --- leases

RULES = leases.Rules(lease_seconds=100, most_attempts=2, retry_seconds=30, most_wait=60)


def job_events(seed, n=400):
    rng, rows, last = random.Random(seed), [], {}
    for seq in range(n):
        key, at = f"k{rng.randrange(6)}", T0 + dt.timedelta(seconds=seq * 7 + rng.randrange(7), microseconds=rng.randrange(1000))
        kind = rng.choice(["enqueue", "claim", "claim", "finish", "finish"])
        token = f"t{seq}" if kind == "claim" else rng.choice([last.get(key), "other"]) if kind == "finish" else None
        last |= {key: token} if kind == "claim" else {}
        rows.append((key, at, seq, kind, f"v{rng.randrange(2)}" if kind == "enqueue" else None, token, rng.choice([None, "boom"]) if kind == "finish" else None))
    return rows


def folded(rows):
    out = []
    for key in {r[0] for r in rows}:
        job = leases.Job()

        def passing(now):
            if (passed := leases.passing(job, now, RULES)) is not None:
                out.append((key, T0 + dt.timedelta(microseconds=passed[0]), -1, job.state, job.attempts, passed[1]))

        for _, at, seq, kind, version, token, failed in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            now = round((at - T0).total_seconds() * 1e6)
            passing(now)
            state, reason = leases.applied(job, now, kind, version, token, failed, RULES)
            out.append((key, at, seq, state, job.attempts, reason))
        passing(1 << 60)
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 3])
def test_transitions_are_a_fold_however_events_are_cut(spark, tmp_path, batches):
    """Also where events come out of order within the delay, and over restarts."""
    leases.use_state_store(spark)
    rows = job_events(batches)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[] for _ in range(batches)]
    rng = random.Random(1)
    for i, r in enumerate(rows):  # some come one batch late
        parts[min(batches - 1, i * batches // len(rows) + (rng.random() < 0.05))].append(r)
    end = spark.createDataFrame(rows, leases.EVENT)
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, leases.EVENT)
        if i == batches - 1:
            df = df.unionByName(leases.closing(end).filter("kind = 'close'"))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = leases.transitions(spark.readStream.schema(leases.EVENT).parquet(folder), RULES, delay="1 hour")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-p").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(leases.TRANSITION).parquet(out).collect()
    assert sorted(map(tuple, got), key=str) == folded(rows)


def test_a_batch_sets_one_timer_for_a_key():
    """However many events a batch has; what the watermark isn't past yet gets the next timer."""
    timers, kept = [], []

    class State:
        value = None
        exists, get, update, clear = (lambda self: self.value is not None), (lambda self: self.value), (lambda self, v: setattr(self, "value", v)), (lambda self: None)

    job, waiting = State(), State()
    waiting.appendList, waiting.get, waiting.put = kept.extend, lambda: list(kept), lambda rows: kept.__setitem__(slice(None), rows)
    leased = leases.Leases(RULES)
    leased.handle = type("Handle", (), {"registerTimer": lambda self, at: timers.append(at)})()
    leased.job, leased.waiting = job, waiting
    rows = [(1_000_000 * i, i, "enqueue", f"v{i}", None, None) for i in range(1, 50)]
    assert list(leased.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["at_us", *leases.FIELDS[1:]])]), None)) == [] and timers == [1001] and kept == rows
    times = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 30_000})()
    fired = type("Fired", (), {"getExpiryTimeInMs": lambda self: 1001})()
    (out,) = leased.handleExpiredTimer(("k",), times, fired)
    assert len(out) == 30 and kept == rows[30:] and timers == [1001, 31_001]


def test_rules_of_a_job():
    job, s = leases.Job(), 1_000_000
    step = lambda at, kind, **x: leases.applied(job, at * s, kind, x.get("version"), x.get("token"), x.get("failed"), RULES)
    assert step(0, "claim", token="a") == ("ignored", None)
    assert step(0, "enqueue", version="1")[0] == "pending" and step(1, "enqueue", version="1")[0] == "ignored"
    assert step(2, "claim", token="a")[0] == "running" and step(3, "claim", token="b")[0] == "ignored" and step(4, "finish", token="b")[0] == "superseded"
    assert step(5, "finish", token="a", failed="boom") == ("retry_wait", "boom") and job.until == 35 * s
    assert step(6, "claim", token="c")[0] == "ignored" and leases.passing(job, 34 * s, RULES) is None and leases.passing(job, 36 * s, RULES) == (35 * s, "boom")
    assert step(36, "claim", token="c")[0] == "running" and leases.passing(job, 136 * s, RULES) == (136 * s, "processing_lease_expired") and job.state == "exhausted"
    assert step(137, "finish", token="c")[0] == "superseded" and step(138, "enqueue", version="2")[0] == "pending" and job.attempts == 0
    assert step(139, "claim", token="d")[0] == "running" and step(140, "finish", token="d")[0] == "succeeded" and step(141, "enqueue", version="2")[0] == "pending"


# --- fence


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


RESULTS = [(1, 7, 1, 10, at(0), at(30)), (1, 7, 1, 10, at(0), at(30)), (2, 7, 2, 10, at(10), at(40)), (3, 8, 1, 10, at(0), at(20)), (4, 8, 1, 10, at(0), at(50)), (5, 9, 5, 0, at(0), at(10)), (6, 9, 5, 0, at(0), at(60))]
MOVES = [(7, "execution", 2, at(5)), (7, "execution", 2, at(5)), (8, "revision", 11, at(30)), (9, "execution", 6, at(61)), (9, "execution", 4, at(1)), (9, "revision", 0, at(2))]
FENCED = {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}


@pytest.mark.parametrize("order", [("results", "movements"), ("movements", "results"), ("both",)])
def test_fence_in_any_order_of_arrival(spark, tmp_path, order):
    """Movements before and after the results that they supersede, results that come twice, and ones too late."""
    end = at(600)
    tables = {"results": (RESULTS, (-1, -1, -1, -1, end, end), fence.RESULT), "movements": (MOVES, (-1, "execution", -1, end), fence.MOVEMENT)}
    out = str(tmp_path / "out")
    for name, (_, _, schema) in tables.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))

    def run():
        streams = [spark.readStream.schema(schema).parquet(str(tmp_path / name)) for name, (_, _, schema) in tables.items()]
        q = fence.fenced_join(*streams).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-p").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    add = lambda name, rows: spark.createDataFrame(rows, tables[name][2]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    for name in order:
        for one in tables if name == "both" else (name,):
            add(one, tables[one][0])
        run()
    for name, (_, closing, _) in tables.items():
        add(name, [closing])
    run()
    got = spark.read.schema(f"{fence.RESULT}, accepted boolean").parquet(out).collect()
    assert sorted((r.result_id, r.accepted) for r in got) == sorted(FENCED.items())
    add("results", [(9, 7, 9, 9, at(1), at(2))])  # far behind the watermark
    late = run()
    assert any(int(o["numRowsDroppedByWatermark"]) for p in late.recentProgress for o in p["stateOperators"])
    assert spark.read.parquet(out).filter("result_id = 9").count() == 0


def test_fence_of_tables_is_the_same(spark):
    got = fence.fenced_join(spark.createDataFrame(RESULTS, fence.RESULT), spark.createDataFrame(MOVES, fence.MOVEMENT)).collect()
    assert {r.result_id: r.accepted for r in got} == FENCED and len(got) == len(FENCED)
