"""Lists that an API serves in pages of an index range, as a Spark data source over recorded responses.

    spark.dataSource.register(RecordedPages)
    spark.read.format("recorded_pages").option("path", folder).option("size", 50).load()

A list is newest first and indexed from 1. The first page tells how long it is,
and each index range is then asked for by itself, and tried again there after
errors that may pass; long lists have runs of ranges read by one task. Ranges overlap, so that a list
that moves while it is read shows: rows come twice, or other totals, or another
first row in the confirming read at the end. ``list_status`` finds all that.

As a stream, the offset is the list's length: how many rows there were, ever, so
the rows between two offsets are the first ones of the list, whatever came on
top since. A page that was served after the list moved on is asked for again,
shifted by as many rows. Replaying an offset range gives the same rows.

Recorded responses are Parquet files under board=/poll=/stretch=, a folder for
each stretch of ``STRETCH`` first indexes; ``record`` writes them, in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from placard.sources import api_xml
from placard.sources.shared import filesystem

PAGES = "board string, poll int, start int, end int, confirms boolean, attempts int, status int, keep int, xml string"
RESPONSE = ("board", "poll", "first", "last", "attempt", "status")
STRETCH = 10_000
#: A task of its own for each range up to so many; beyond that, runs of at most MOST_RANGES.
FEW_RANGES, MOST_RANGES = 64, 512
MOST_ATTEMPTS, RATE_LIMITED, RETRYABLE = 3, 429, (500, 502, 503, 504)
MISSING, SHRUNK = 404, 409


@dataclass
class PageRange(InputPartition):
    board: str
    poll: int
    start: int
    end: int
    confirms: bool = False
    #: For streams: the list's length that the range was planned for, and how many of its rows are new.
    total: int | None = None
    keep: int | None = None


@dataclass
class PageRun(InputPartition):
    ranges: list[PageRange]


def dealt(ranges: list[PageRange]) -> list[PageRange] | list[PageRun]:
    """Ranges as partitions: each by itself if they are few, else neighbours together."""
    run = min(MOST_RANGES, -(-len(ranges) // FEW_RANGES))
    return ranges if run <= 1 else [PageRun(ranges[i : i + run]) for i in range(0, len(ranges), run)]


Partition = TypeVar("Partition", PageRange, PageRun)


def _ranges(partition: Partition) -> list[PageRange]:
    return partition.ranges if isinstance(partition, PageRun) else [partition]


def page_ranges(total: int, size: int, overlap: int, sample: bool = False) -> list[tuple[int, int]]:
    """The index ranges of a list; the first has a page's full size, as it is asked for before the total is known."""
    if not 1 <= size <= api_xml.MOST_ROWS or not 0 <= overlap < size:
        raise ValueError("a page has 1 to 1000 rows, and its overlap fewer")
    if sample:
        return [(1, min(size, api_xml.SAMPLE_ROWS))]
    return [(1, size), *api_xml.ranges(total, size, overlap)[1:]]


class _Responses:
    """The recorded responses in a folder."""

    def __init__(self, options: dict[str, str]):
        self.path, self.near = options["path"], {}

    def _names(self, under: str, key: str) -> list[str]:
        from pyarrow import fs

        system, base = filesystem(f"{self.path}{under}")
        infos = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(i.base_name.split("=", 1)[1] for i in infos if i.type == fs.FileType.Directory and i.base_name.startswith(f"{key}="))

    def boards(self) -> list[str]:
        return self._names("", "board")

    def polls(self, board: str) -> list[int]:
        return sorted(map(int, self._names(f"/board={board}", "poll")))

    def get(self, board: str, poll: int, start: int, end: int, attempt: int) -> tuple[int, str | None]:
        """(status, body) of one attempt."""
        status, body = self._stretch(board, poll, start // STRETCH).get((start, end, attempt), (MISSING, None))
        return status, body if status == 200 else None

    def _stretch(self, board: str, poll: int, stretch: int) -> dict[tuple[int, int, int], tuple[int, str]]:
        """The responses of one stretch; the last two are kept, as a list that moves is read across their border."""
        from pyarrow import fs
        from pyarrow import parquet as pq

        if (place := (board, poll, stretch)) not in self.near:
            system, base = filesystem(f"{self.path}/board={board}/poll={poll}/stretch={stretch}")
            files = [i.path for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.base_name.startswith("part-")]
            found = {}
            for path in files:
                with system.open_input_file(path) as file:
                    columns = pq.read_table(file, columns=["first", "last", "attempt", "status", "xml"], partitioning=None).to_pydict()
                found |= {(f, t, n): (code, xml) for f, t, n, code, xml in zip(*columns.values(), strict=True)}
            for old in list(self.near)[:-1]:
                del self.near[old]
            self.near[place] = found
        return self.near[place]

    def tried(self, board: str, poll: int, start: int, end: int) -> tuple[int, int, str | None]:
        """(attempts, status, body): errors that may pass are tried again, a refusal for too many requests isn't."""
        for attempt in range(1, MOST_ATTEMPTS + 1):
            status, body = self.get(board, poll, start, end, attempt)
            if status not in RETRYABLE:
                break
        return attempt, status, body

    def total(self, board: str, poll: int, size: int) -> int | None:
        found = re.search(r"<list_total_count>\s*(\d+)\s*<", self.tried(board, poll, 1, size)[2] or "")
        return int(found[1]) if found else None


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.responses, self.options = _Responses(options), options
        self.size, self.overlap = int(options.get("size", api_xml.MOST_ROWS)), int(options.get("overlap", -1))
        if self.overlap < 0:
            self.overlap = min(10, self.size - 1)

    def partitions(self) -> list[PageRange] | list[PageRun]:
        """A range for each page of each board, in runs where there are many; one request for each board is made to learn its length."""
        poll, sample = int(self.options.get("poll", 1)), self.options.get("sample", "false") == "true"
        boards = [b for b in self.options.get("boards", "").split(",") if b] or self.responses.boards()
        if "start" in self.options:
            return [PageRange(b, poll, int(self.options["start"]), int(self.options["end"])) for b in boards]
        out = []
        for board in boards:
            total = self.responses.total(board, poll, self.size)
            out += [PageRange(board, poll, a, b) for a, b in page_ranges(total or 0, self.size, self.overlap, sample)]
            if total and not sample:
                out.append(PageRange(board, poll, 1, 1, True))
        return dealt(out)

    def read(self, partition: Partition) -> Iterator[tuple]:
        for p in _ranges(partition):
            attempts, status, body = self.responses.tried(p.board, p.poll, p.start, p.end)
            yield (p.board, p.poll, p.start, p.end, p.confirms, attempts, status, None, body)


class PageStreamReader(DataSourceStreamReader):
    """One board's new rows; an offset is the poll that saw it and the list's length then."""

    def __init__(self, options: dict[str, str]):
        self.responses, self.board, self.size = _Responses(options), options["boards"], int(options.get("size", api_xml.MOST_ROWS))
        #: With ``baseline``, the first run starts so many rows before the end of the list; ``upto`` is the last poll that a replay sees.
        self.baseline, self.upto = int(options.get("baseline", -1)), int(options.get("upto", 1 << 30))

    def _polls(self) -> list[int]:
        return [p for p in self.responses.polls(self.board) if p <= self.upto]

    def initialOffset(self) -> dict:
        polls = self._polls()
        total = self.responses.total(self.board, polls[0], self.size) if polls and self.baseline >= 0 else None
        return {"poll": 0, "index": max(0, (total or 0) - self.baseline) if total is not None else 0}

    def latestOffset(self) -> dict:
        for poll in reversed(self._polls()):
            if (total := self.responses.total(self.board, poll, self.size)) is not None:
                return {"poll": poll, "index": total}
        return {"poll": 0, "index": 0}

    def partitions(self, start: dict, end: dict) -> list[PageRange] | list[PageRun]:
        new = end["index"] - start["index"]
        if new < 0:
            return [PageRange(self.board, end["poll"], 1, 1, False, end["index"], -1)]
        return dealt([PageRange(self.board, end["poll"], a, min(a + self.size - 1, end["index"]), False, end["index"], min(self.size, new - a + 1)) for a in range(1, new + 1, self.size)])

    def read(self, partition: Partition) -> Iterator[tuple]:
        for p in _ranges(partition):
            yield self._page(p)

    def _page(self, p: PageRange) -> tuple:
        if p.keep is not None and p.keep < 0:
            return p.board, p.poll, p.start, p.end, False, 0, SHRUNK, 0, None
        shift, attempts = 0, 0
        while True:
            tries, status, body = self.responses.tried(p.board, p.poll, p.start + shift, p.end + shift if p.start + shift > 1 else max(p.end, self.size))
            attempts += tries
            found = re.search(r"<list_total_count>\s*(\d+)\s*<", body or "")
            moved = int(found[1]) - p.total - shift if found else 0
            if moved <= 0 or attempts >= 3 * MOST_ATTEMPTS:
                break
            shift += moved  # rows came on top since: the ones asked for are further down
        if status == 200 and moved:
            status, body = SHRUNK, None
        return p.board, p.poll, p.start + shift, p.end + shift, False, attempts, status, p.keep, body

    def commit(self, end: dict) -> None:
        pass


class RecordedPages(DataSource):
    """Options: path; boards (comma-separated; all by default, one for a stream); size, overlap, poll, sample, or start and end for one range; baseline and upto for a stream."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(dict(self.options))


def record(responses: DataFrame, path: str) -> None:
    """Writes responses (RESPONSE, xml) for the source to read."""
    folders = ("board", "poll", "stretch")
    placed = responses.select(*RESPONSE, F.coalesce("xml", F.lit("")).alias("xml")).withColumn("stretch", F.expr(f"first div {STRETCH}"))
    placed.repartition(*folders).sortWithinPartitions(*folders, "first", "last", "attempt").write.partitionBy(*folders).parquet(path)


def read_pages(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """PAGES of a folder of recorded responses."""
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").options(path=path, **options).load()


def stream_pages(spark: SparkSession, path: str, board: str, **options: object) -> DataFrame:
    """PAGES of one board's new rows, as a stream."""
    spark.dataSource.register(RecordedPages)
    return spark.readStream.format("recorded_pages").options(path=path, boards=board, **options).load()


def parsed_pages(pages: DataFrame, fields: tuple[str, ...] = api_xml.FIELDS, required: tuple[str, ...] = api_xml.REQUIRED) -> DataFrame:
    """PAGES with total, rows and error; a page that wasn't served has the error rate_limited, missing, shrunk or http."""
    parsed = api_xml.parse_pages(pages, fields, required, keep=("board", "poll", "confirms", "attempts", "status", "keep"))
    code = F.col("status")
    http = F.when(code == RATE_LIMITED, "rate_limited").when(code == MISSING, "missing").when(code == SHRUNK, "shrunk").when(code != 200, "http")
    return parsed.withColumn("error", F.coalesce(http, "error"))


def new_rows(parsed: DataFrame) -> DataFrame:
    """A stream's new rows: board, poll, post_sn, title, registered, department. A page in error stops the stream, so its rows aren't passed over."""
    checked = parsed.withColumn("rows", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("page not whole: "), "error")).cast(parsed.schema["rows"].dataType)).otherwise(F.col("rows")))
    return checked.select("board", "poll", F.explode(F.slice("rows", 1, F.greatest("keep", F.lit(0)))).alias("r")).select("board", "poll", F.col("r.ID").alias("post_sn"), F.col("r.TITLE").alias("title"), F.col("r.PUBDATE").alias("registered"), F.col("r.DEPARTMENT").alias("department"))


def list_status(parsed: DataFrame) -> DataFrame:
    """A row for each board of parsed pages: total, n_pages, n_failed, n_retried, n_rows, n_duplicates, n_conflicts, moved, complete.

    The rows of whole pages may be kept in any case; what isn't listed may only
    be taken for gone where the list is complete: each page whole, one total
    throughout, as many different posts as that, no post with two contents, and
    the same first post when asked again at the end.
    """
    pages = parsed.withColumn("ok", F.col("error").isNull()).withColumn("first_id", F.when(F.col("start") == 1, F.get("rows", F.lit(0))["ID"]))
    own = ~F.col("confirms")
    sums = pages.groupBy("board").agg(
        F.max(F.when(own & (F.col("start") == 1), F.col("total"))).alias("total"), F.count_if(own).alias("n_pages"), F.count_if(~F.col("ok")).alias("n_failed"), F.count_if(F.col("attempts") > 1).alias("n_retried"),
        (F.min("total") != F.max("total")).alias("_totals"), (F.min("first_id") != F.max("first_id")).alias("_firsts"), F.count_if(F.col("confirms") & F.col("ok")).alias("_confirmed"),
    )
    rows = pages.filter(own & F.col("ok")).select("board", F.explode("rows").alias("r")).select("board", F.col("r.ID").alias("id"), F.sha2(F.to_json("r"), 256).alias("content"))
    posts = rows.groupBy("board", "id").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("differs"))
    seen = posts.groupBy("board").agg(F.count("*").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_duplicates"), F.count_if("differs").alias("n_conflicts"))
    joined = sums.join(seen, "board", "left").na.fill(0, ["n_rows", "n_duplicates", "n_conflicts"])
    moved = F.coalesce(F.col("_totals"), F.lit(False)) | F.coalesce(F.col("_firsts"), F.lit(False))
    complete = (F.col("n_failed") == 0) & ~moved & (F.col("n_conflicts") == 0) & (F.col("_confirmed") == 1) & (F.coalesce("total", F.lit(0)) > 0) & (F.col("n_rows") == F.col("total"))
    return joined.select("board", "total", "n_pages", "n_failed", "n_retried", "n_rows", "n_duplicates", "n_conflicts", moved.alias("moved"), complete.alias("complete"))
