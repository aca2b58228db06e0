"""Fencing of results by stream-stream join: accepted, or superseded by what was registered meanwhile.

A result holds the token of the execution that made it and the revision of the
notice that it read. It is superseded if, by the time it comes, a later execution
of the notice is registered, or the notice has another revision. Both kinds of
movement are one stream. A left outer join of results with the movements that
supersede them emits a superseded row with the first such movement, and an
accepted one when the watermarks show that no such movement can come any more.

A result that comes twice counts once; movements and results may come in any
order within ``delay``. Later ones are dropped by the watermark and show in the
query's progress (numRowsDroppedByWatermark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A movement: kind is execution (value: its token) or revision (value: the notice's new content revision).
MOVEMENT = "notice_id long, kind string, value long, moved_at timestamp"
RESULT = "result_id long, notice_id long, execution_token long, source_revision long, read_at timestamp, result_at timestamp"


def fenced_join(results: DataFrame, movements: DataFrame, delay: str = "1 hour", longest: str = "1 day") -> DataFrame:
    """RESULT rows with accepted; results are made within ``longest`` of what they read, which bounds the join's state.

    Works on two streams, and on two tables with the same rows.
    """
    once = results.withWatermark("result_at", delay).dropDuplicatesWithinWatermark(["result_id"]) if results.isStreaming else results.dropDuplicates(["result_id"])
    moved = movements.withWatermark("moved_at", delay) if movements.isStreaming else movements
    r, m = once.alias("r"), moved.withColumnRenamed("notice_id", "of_notice").alias("m")
    supersedes = """r.notice_id = m.of_notice and m.moved_at <= r.result_at and m.moved_at > r.result_at - interval {longest} and m.moved_at > r.read_at
        and (m.kind = 'execution' and m.value > r.execution_token or m.kind = 'revision' and m.value <> r.source_revision)"""
    joined = r.join(m, F.expr(supersedes.format(longest=longest)), "left_outer")
    out = joined.select("r.*", F.col("m.of_notice").isNull().alias("accepted"))
    # Several movements may supersede one result.
    return out.dropDuplicatesWithinWatermark(["result_id"]) if out.isStreaming else out.dropDuplicates(["result_id"])
