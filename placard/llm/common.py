"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: What workers keep from task to task, as functions that let it go.
KEPT: list = []


def release() -> None:
    """Lets go of what earlier stages keep in this Python worker; called by tasks that need memory for other things."""
    for forget in KEPT:
        forget()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and
    all runs on one machine, as in tests, is a temporary folder made and set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="placard-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder after that."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Has the files of finished steps dropped: shuffles, and checkpoints if the cluster cleans them.

    Spark deletes them when the driver's JVM collects the objects that stand for
    them. An idle driver may not do that for the whole of a job of many small
    steps, whose files then add up on the executors' disks.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def drops_shuffles(step):
    """A step over a DataFrame whose jobs drop their shuffles as soon as each ends: for many jobs that each write what the next one reads."""

    @functools.wraps(step)
    def run(df: DataFrame, *args, **options):
        conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(name, None)
        conf.set(name, "true")
        try:
            return step(df, *args, **options)
        finally:
            conf.set(name, before) if before is not None else conf.unset(name)

    return run


@contextlib.contextmanager
def short_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run in this block hand Python workers batches of about so many bytes, which neither side has to hold more of."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name, None)
    conf.set(name, str(size))
    try:
        yield
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read again: for rows with texts, of which later steps read some columns."""
    path = fresh_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """df, a computed table of a few short columns, marked for a broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, key: str, *order: Column, name: str = "rank") -> DataFrame:
    """df with the rank of each row among the rows of its key, from 1.

    Rows are sorted by ranges of key and order, so the rows of one key may lie
    in many tasks. Each is numbered in its own; the rows of the key in the tasks
    before come on top, from a table of one row for each key and task. Equal
    rows are dealt by a number of their own, so they don't make one range either.
    """
    by = [F.col(f"`{key}`").asc_nulls_first(), *order, F.col("__row")]
    dealt = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = staged(dealt.drop("__row").withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.shiftright("__at", 33)))
    runs = placed.groupBy(key, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    runs = runs.withColumn("__before", F.expr(f"coalesce(sum(__n) over (partition by `{key}` order by __task rows between unbounded preceding and 1 preceding), 0)"))
    return placed.join(runs, [key, "__task"]).withColumn(name, (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("long")).drop("__at", "__task", "__first", "__n", "__before")


def running(df: DataFrame, key: str, at: str, sums: dict[str, str], stretch: int = 4096, backward: bool = False) -> DataFrame:
    """df (unique key and at, a number from 0 on without wide gaps) with running aggregates: name -> SQL aggregate, bit_xor or sum of a column, of the rows so far.

    A key's rows are taken in stretches of at; what comes before a stretch is
    found from one row for each stretch, so a key of any size is spread.
    """
    df = df.withColumn("__stretch", F.floor(F.col(at) / stretch))
    way, glue = ("desc" if backward else "asc"), {n: "^" if a.startswith("bit_xor") else "+" for n, a in sums.items()}
    each = df.groupBy(key, "__stretch").agg(*[F.expr(a).alias(f"__sum_{n}") for n, a in sums.items()])
    before = [f"coalesce({a.split('(')[0]}(__sum_{n}) over (partition by {key} order by __stretch {way} rows between unbounded preceding and 1 preceding), 0) as __sum_{n}" for n, a in sums.items()]
    some = " or ".join(f"__sum_{n} <> 0" for n in sums)
    offsets = small(staged(each.selectExpr(key, "__stretch", *before).filter(some)))
    inside = df.selectExpr("*", *[f"{a} over (partition by {key}, __stretch order by {at} {way} rows between unbounded preceding and current row) as {n}" for n, a in sums.items()])
    shifted = {n: F.expr(f"{n} {g} coalesce(__sum_{n}, 0)") for n, g in glue.items()}
    return inside.join(offsets, [key, "__stretch"], "left").withColumns(shifted).drop("__stretch", *[f"__sum_{n}" for n in sums])


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that further ones can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """row (all columns as a struct, whatever their names) and these columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`") for c in columns])
