"""The file ledger: what to do with each file, what became of chunks, who is gone; counts over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRAKE_FILES, BRAKE_SHARE = 10, 0.5


def decide(candidates: DataFrame, files: DataFrame, spaces: DataFrame, keys: list[str], *, force: bool = False) -> DataFrame:
    """candidates (keys, size, mtime, chunker_version) with a decision from what stat tells."""
    old = files.select(*keys, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("chunker_version").alias("_version"), F.lit(True).alias("_known"))
    out = candidates.join(old, keys, "left").join(spaces.select(*keys, F.lit(True).alias("_embedded")).distinct(), keys, "left")
    decision = (
        F.when(F.lit(force), "FORCED").when(F.col("_known").isNull(), "NEW").when(~F.col("_version").eqNullSafe(F.col("chunker_version")), "RECHUNK_STRATEGY")
        .when(F.col("_embedded").isNull(), "BACKFILL_SPACE").when((F.col("_mtime") == F.col("mtime")) & (F.col("_size") == F.col("size")), "SKIP_UNCHANGED").otherwise("REINDEX")
    )
    return out.withColumn("decision", decision).drop("_size", "_mtime", "_version", "_known", "_embedded")


def decide_by_hash(read: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Files to be read again whose content is as recorded are skipped after all."""
    old = files.select(*keys, F.col("sha256").alias("_sha"))
    same = (F.col("decision") == "REINDEX") & F.col("_sha").eqNullSafe(F.col("sha256"))
    return read.join(old, keys, "left").withColumn("decision", F.when(same, "SKIP_SAME_CONTENT").otherwise(F.col("decision"))).drop("_sha")


def chunk_delta(produced: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Each chunk id with upsert, delete or unchanged."""
    a, b = produced.select(key).distinct().withColumn("_new", F.lit(1)), stored.select(key).distinct().withColumn("_old", F.lit(1))
    label = F.when(F.col("_old").isNull(), "upsert").when(F.col("_new").isNull(), "delete").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, label.alias("action"))


def orphans(files: DataFrame, seen: DataFrame, keys: list[str], *, scope: Column | None = None) -> DataFrame:
    """Recorded files that a walk hasn't seen."""
    own = files if scope is None else files.where(scope)
    return own.join(seen.select(*keys).distinct(), keys, "left_anti")


def deletion_brake(files: DataFrame, gone: DataFrame, root: str, unreadable: list[str] = ()) -> DataFrame:
    """For each root: recorded, orphaned, withheld. Many files and half of a root's at once aren't deleted without asking."""
    all_ = files.groupBy(root).agg(F.count(F.lit(1)).alias("recorded"))
    lost = gone.groupBy(root).agg(F.count(F.lit(1)).alias("orphaned"))
    out = all_.join(lost, root, "left").withColumn("orphaned", F.coalesce("orphaned", F.lit(0)).cast("long"))
    mass = (F.col("orphaned") >= BRAKE_FILES) & (F.col("orphaned") / F.col("recorded") >= BRAKE_SHARE)
    return out.withColumn("withheld", mass | F.col(root).isin(list(unreadable)) if unreadable else mass)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both, new ones in place of old ones with their keys; of several new ones the last by `order`."""
    if order is not None:
        w = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_owned(old: DataFrame, new: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the owners replaced by new ones, if only by none."""
    return old.join(owners.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Every table without the rows of files that are gone."""
    lost = gone.select(*keys).distinct()
    return {k: v.join(lost, keys, "left_anti") for k, v in tables.items()}


def complete_spaces(files: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Each file's number of chunks, 0 too: a file without chunks is done as well."""
    n = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return files.select(*keys).distinct().join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"))


def copy_space(rows: DataFrame, slug: str, new: str) -> DataFrame:
    return rows.where(F.col("space_slug") == slug).withColumn("space_slug", F.lit(new))


def forget_space(rows: DataFrame, slug: str) -> tuple[DataFrame, DataFrame]:
    """The rows of other spaces, and one row that counts those of this one."""
    gone = F.coalesce(F.col("space_slug") == F.lit(slug), F.lit(False))
    return rows.where(~gone), rows.agg(F.count_if(gone).alias("forgotten"))


def with_cached(rows: DataFrame, cache: DataFrame, version: int, computed: Column) -> DataFrame:
    """The recorded class of a content under the present classifier, else the computed one."""
    own = cache.where(F.col("classifier_version") == version).select("sha256", F.col("doc_type").alias("_held")).dropDuplicates(["sha256"])
    return rows.join(own, "sha256", "left").withColumn("doc_type", F.coalesce("_held", computed)).drop("_held")


def find_paths(files: DataFrame, needle: str, n: int = 8) -> DataFrame:
    """Files that are or end in /needle, shortest first."""
    from ..functions.text import suffix_match

    return files.where(suffix_match("rel_path", F.lit(needle))).orderBy(F.length("rel_path"), "root_label", "rel_path").limit(n)


def exact_else_suffix(rows: DataFrame, needle: str, path: str = "rel_path") -> DataFrame:
    """Rows at exactly this path; only if there are none, those whose path ends in it."""
    from ..functions.text import suffix_match

    near = rows.where(suffix_match(path, F.lit(needle), fold=False)).withColumn("_exact", F.col(path) == needle)
    any_exact = near.agg(F.coalesce(F.max("_exact"), F.lit(False)).alias("_any"))
    return near.crossJoin(F.broadcast(any_exact)).where(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any")


def unfinished_runs(events: DataFrame) -> DataFrame:
    """Runs by id from start and finish events; finished_at null while one is running."""
    return events.groupBy("run_id").agg(F.min_by("at", F.when(F.col("event") == "start", F.col("at"))).alias("started_at"), F.max(F.when(F.col("event") == "finish", F.col("at"))).alias("finished_at"))


def tool_call_stats(calls: DataFrame, tool: str, returned: str) -> DataFrame:
    return calls.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col(returned) == 0).alias("empty"))


def disappointing(calls: DataFrame, returned: str, dropped: str) -> DataFrame:
    return calls.where((F.col(returned) == 0) | (F.col(dropped) > 0))


def consistency(recorded: DataFrame, stored: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Spaces of the ledger against those of the store: missing on either side, differing counts, or ok."""
    a, b = recorded.select(key, F.col(n).alias("recorded")), stored.select(key, F.col(n).alias("stored"))
    state = F.when(F.col("stored").isNull(), "not stored").when(F.col("recorded").isNull(), "not recorded").when(F.col("recorded") != F.col("stored"), "count differs").otherwise("ok")
    return a.join(b, key, "full_outer").withColumn("state", state)


def diverged(recorded: DataFrame, stored: DataFrame, share: float = 0.9) -> DataFrame:
    """One row: recorded, stored, and whether less than the share is stored."""
    a, b = recorded.agg(F.count(F.lit(1)).alias("recorded")), stored.agg(F.count(F.lit(1)).alias("stored"))
    return a.crossJoin(b).withColumn("diverged", F.col("stored") < F.col("recorded") * share)


def unreliable_parses(chunks: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Files of which at least this share of chunks was cut without a parse."""
    out = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.count_if("parse_degraded").alias("degraded"))
    return out.where(F.col("degraded") >= F.col("chunks") * share)
