"""Packing ranked hits into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip

FLOOR = 64


def pack(hits: DataFrame, *, group: str, rank: str, cost: str, budget: int, floor: int = FLOOR) -> DataFrame:
    """Hits kept in order of rank: the first always, the next ones while at least `floor` remains; `spent` is what the earlier
    ones cost, and a hit that costs more than remains is `truncated` to `granted`."""
    w = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    spent = hits.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0)).cast("long"))
    left = F.lit(budget) - F.col("spent")
    kept = spent.where((F.col("spent") == 0) & (F.col(rank) == 1) | (left >= floor))
    return kept.withColumn("truncated", F.col(cost) > left).withColumn("granted", F.least(F.col(cost), F.greatest(left, F.lit(0))).cast("long"))


def pack_locations(hits: DataFrame, *, group: str, rank: str, cost: str, budget: int) -> DataFrame:
    """Only whole hits: the first always, others while the running cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("spent", F.sum(cost).over(w).cast("long")).where((F.col(rank) == 1) | (F.col("spent") <= budget))


def anchor_tokens(hits: DataFrame):
    """What a hit costs without its text: a third of the characters of its place as JSON."""
    place = [c for c in ("chunk_id", "root_label", "rel_path", "start_line", "end_line", "symbol_path", "doc_type") if c in hits.columns]
    return F.floor(F.length(F.to_json(F.struct(*place))) / 3).cast("int")


def clip_hits(packed: DataFrame, text: str, notice: str = "\n… truncated") -> DataFrame:
    return packed.withColumn(text, F.when(F.col("truncated"), F.concat(clip(text, "granted"), F.lit(notice))).otherwise(F.col(text)))


def envelope(hits: DataFrame, kept: DataFrame, group: str) -> DataFrame:
    """For each query: total, returned, dropped_for_budget."""
    every = hits.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    own = kept.groupBy(group).agg(F.count(F.lit(1)).alias("returned"))
    return every.join(own, group, "left").select(group, "total", F.coalesce("returned", F.lit(0)).alias("returned"), (F.col("total") - F.coalesce("returned", F.lit(0))).alias("dropped_for_budget"))
