"""Changes as streams: bursts gathered per root, ignored paths dropped, tool calls counted by the hour, files decided on.

debounced() and tool_windows() take batch and streaming frames alike; for streams they set the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex


def debounced(changes: DataFrame, *, root: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """root, started, ended, changes: one row for each burst, which a quiet gap ends."""
    own = changes.withWatermark(at, late) if changes.isStreaming else changes
    out = own.groupBy(F.session_window(at, gap).alias("_w"), F.col(root).alias("root")).agg(F.count(F.lit(1)).alias("changes"))
    return out.select("root", F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), "changes")


def kept_changes(changes: DataFrame, ignored: list[str], *, path: str = "path", unwatched: DataFrame | None = None) -> DataFrame:
    """Changes of paths that no pattern ignores, and not below a directory of `unwatched` (column dir)."""
    for pattern in ignored:
        changes = changes.where(~F.col(path).rlike(glob_regex(pattern)))
    if unwatched is not None:
        from ..functions.text import ancestors_of

        # a directory of n names can only equal a path's n-th ancestor: one equi-join a depth, which streams may do too
        named = unwatched.select("dir", F.size(F.split("dir", "/")).alias("depth"))
        below = changes.withColumn("_dirs", ancestors_of(path))
        for depth in sorted(r[0] for r in named.where("dir is not null").select("depth").distinct().collect()):
            dirs = named.where(F.col("depth") == depth).select(F.col("dir").alias("_dir"))
            below = below.join(dirs, F.get("_dirs", F.lit(depth - 1)) == F.col("_dir"), "left_anti")
        changes = below.drop("_dirs")
    return changes


def tool_windows(calls: DataFrame, *, at: str, tool: str, returned: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, end, tool, calls, empty for each window."""
    own = calls.withWatermark(at, late) if calls.isStreaming else calls
    out = own.groupBy(F.window(at, width).alias("_w"), tool).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col(returned) == 0).alias("empty"))
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), tool, "calls", "empty")


def run_on_changes(bursts: DataFrame, action: Callable[[list, int], None], checkpoint: str, *, once: bool = False):
    """Calls action(sorted roots, batch id) for each micro-batch; batch ids let an action that has been done be skipped.

    Only distinct roots, of which a workspace names a few, come to the driver."""

    def each(batch: DataFrame, number: int) -> None:
        roots = sorted(r[0] for r in batch.select("root").distinct().collect())
        if roots:
            action(roots, number)

    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str, *, order: str):
    """Keeps a Parquet table of the latest row of each key; a batch that is replayed changes nothing."""
    from ..operators.ledger import upsert
    from ..sources.tables import Table

    table = Table(rows.sparkSession, path)

    def each(batch: DataFrame, number: int) -> None:
        old = table.read() if table.exists() else batch.limit(0)
        table.replace(upsert(old, batch, keys, order=order), token=f"batch-{number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
