"""Streams of messages: each once, scored, counted per window, folded into history."""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.policy import history

# Fixed value: the least time between two scans of a page.
SCAN_EVERY = "1200 milliseconds"


def once(messages: DataFrame, id: str = "msg_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Every message id once within the watermark."""
    return messages.withWatermark(time, late).dropDuplicatesWithinWatermark([id])


def latest(nodes: DataFrame, node: str = "node", time: str = "ts") -> DataFrame:
    """What each node of a recycled list shows now: the columns of its latest row. For update or complete mode."""
    others = [c for c in nodes.columns if c != node]
    return nodes.groupBy(node).agg(F.max_by(F.struct(*others), F.col(time)).alias("r")).select(node, "r.*")


def flag_rate(verdicts: DataFrame, every: str = "1 hour", time: str = "ts", late: str | None = None) -> DataFrame:
    """Scans and flagged scans per window (an extension)."""
    rows = verdicts.withWatermark(time, late) if late else verdicts
    counts = rows.groupBy(F.window(time, every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") != "safe").alias("flagged"))
    return counts.select(F.col("w.start").alias("start"), "n", "flagged")


def sessions(scans: DataFrame, by: str, gap: str = "30 minutes", time: str = "ts", late: str | None = None) -> DataFrame:
    """Runs of scans without a longer gap (an extension)."""
    rows = scans.withWatermark(time, late) if late else scans
    found = rows.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tab_counts(scans: DataFrame, tab: str = "tab", page: str = "page_seq") -> DataFrame:
    """Flagged messages of the page a tab shows now: a later page's rows replace an earlier one's."""
    pages = scans.groupBy(tab, page).agg(F.count_if(F.col("verdict") == "dangerous").alias("dangerous"), F.count_if(F.col("verdict") == "suspicious").alias("suspicious"))
    return pages.groupBy(tab).agg(F.max_by(F.struct("dangerous", "suspicious"), F.col(page)).alias("r")).select(tab, "r.*")


def settled(scans: DataFrame, page: str = "page", time: str = "ts", every: str = SCAN_EVERY, late: str = "1 minute") -> DataFrame:
    """One scan of a page for a burst of its changes: the last row of each run of changes without a pause of ``every``."""
    others = [c for c in scans.columns if c not in (page, time)]
    runs = scans.withWatermark(time, late).groupBy(page, F.session_window(time, every).alias("w")).agg(F.max_by(F.struct(time, *others), F.col(time)).alias("r"))
    return runs.select(page, "r.*")


def since_reset(marks: DataFrame, resets: DataFrame, by: str = "tab", time: str = "ts") -> DataFrame:
    """Marks (what a tab has seen) that are still valid: those not older than the last reset of their tab (a navigation, or a change of a list).

    Resets without a tab hold for all tabs; tabs without a reset keep all their marks.
    """
    own = resets.where(F.col(by).isNotNull()).groupBy(by).agg(F.max(time).alias("__own"))
    every = resets.where(F.col(by).isNull()).agg(F.max(time).alias("__every"))  # one row
    rows = marks.join(own, by, "left").join(F.broadcast(every))
    last = F.greatest("__own", "__every")
    return rows.where(last.isNull() | (F.col(time) >= last)).drop("__own", "__every")


def with_static(stream: DataFrame, read: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame], write: Callable[[DataFrame, int], None], folder: str) -> DataStreamWriter:
    """A writer that reads a table (a feed, a list) anew for every micro-batch.

    What was read is written to ``folder``, in which the last two good copies stay; a failed
    read is logged and the last good copy used, also after a restart.
    """

    def copies(spark: SparkSession) -> list[tuple[int, str]]:
        """Whole copies, oldest first."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [(int(n.getName().removeprefix("copy-")), n.toString()) for n in names if n.getName().startswith("copy-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS"))]
        return sorted(done)

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        try:
            read().write.mode("overwrite").parquet(f"{folder}/copy-{epoch}")
        except (PySparkException, Py4JJavaError, OSError) as e:
            logging.getLogger(__name__).warning("the table can't be read, the last good copy is used: %s", e)
            if not copies(spark):
                raise
        kept = copies(spark)
        write(apply(rows, spark.read.parquet(kept[-1][1])), epoch)
        for _, gone in kept[:-2]:
            path = spark._jvm.org.apache.hadoop.fs.Path(gone)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.trigger(processingTime=SCAN_EVERY).foreachBatch(batch)


def history_writer(verdicts: DataFrame, path: str, **options) -> DataStreamWriter:
    """Keeps the rolling history as a table: every micro-batch is folded into version ``epoch`` from the version before.

    An entry keeps the place of its first scan from batch to batch. A micro-batch that runs
    again rewrites its own version, so the result doesn't depend on retries.
    """

    def merge(rows: DataFrame, epoch: int) -> None:
        spark, old = rows.sparkSession, None
        if epoch > 0:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={epoch - 1}")
            if before.getFileSystem(spark._jsc.hadoopConfiguration()).exists(before):
                old = spark.read.parquet(f"{path}/epoch={epoch - 1}")
        history(rows, old=old, **options).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return verdicts.writeStream.foreachBatch(merge)
